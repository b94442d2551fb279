"""Ids of whole texts for tokenizers that drop white space."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyline.llm.common import gather, task_threads
from tallyline.llm.packing import ChunkEncoder
from tallyline.llm.words import WordStore, joined

#: What such a tokenizer's file says (fixed values of the format): its words never hold white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
#: Letters that one letter each stands for in lower case, and the stops behind them, which are a word of their own.
SIMPLE = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*$"


def drops_blanks(spec: dict) -> bool:
    """Whether a text's ids are those of its parts between blanks, one after another."""
    normaliser, before, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    split = (before.get("pretokenizers") or [{}])[0]
    return (
        normaliser.get("type") == "Sequence"
        and all(n in NORMALISERS for n in normaliser["normalizers"])
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": WORDS}, "Removed", True)
        and all(p.get("type") == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in before["pretokenizers"][1:])
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or not {" ", "\n"}.isdisjoint(t["content"]) for t in spec.get("added_tokens", []))
    )


class BlankEncoder:
    """Whole texts to ids, exactly the tokenizer's own: each distinct part between blanks or line ends is encoded once.

    Parts of plain letters are looked up in lower case and without the stops and commas that
    end them; all others are looked up as they are.
    """

    def __init__(self, spec: dict, max_bytes: int = 32_000_000):
        from tokenizers import Tokenizer

        task_threads()
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.store = WordStore(self._ids, max_bytes)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return joined([e.ids for e in encode(words.to_pylist(), add_special_tokens=False)])

    def encode(self, texts: list[str] | pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; ``end``, unless None, follows each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        parts = chunks.dictionary
        simple = pc.match_substring_regex(parts, SIMPLE)
        lower = pc.if_else(simple, pc.utf8_lower(parts), parts)
        cores = pc.if_else(simple, pc.utf8_rtrim(lower, ".,"), lower)
        over = pc.if_else(simple, pc.replace_substring_regex(lower, "^[^.,]+", ""), "")
        both = pa.chunked_array([cores, over]).combine_chunks().dictionary_encode()
        place = self.store.places(both.dictionary)[both.indices.to_numpy(zero_copy_only=False)]
        sizes = self.store.sizes.astype(np.int64)
        flat, each = gather(self.store.flat, np.cumsum(sizes) - sizes, sizes, place.reshape(2, -1).T.ravel())
        sizes = each.reshape(-1, 2).sum(axis=1)
        ids, own = gather(flat, np.cumsum(sizes) - sizes, sizes, chunks.indices.to_numpy(zero_copy_only=False))
        per_text = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        lengths = np.diff(np.concatenate([[0], np.cumsum(own)])[per_text], prepend=0)
        if end is None:
            return ids, lengths
        closed = np.full(len(ids) + len(lengths), end, dtype=np.uint32)
        inner = np.ones(len(closed), dtype=bool)
        inner[np.cumsum(lengths + 1) - 1] = False
        closed[inner] = ids
        return closed, lengths + 1


def encoder(path: str) -> BlankEncoder | ChunkEncoder:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return BlankEncoder(spec) if drops_blanks(spec) else ChunkEncoder(path)
