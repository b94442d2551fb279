"""SentencePiece models run by the tokenizers library.

The model file is parsed from its protobuf wire format. From it are rebuilt the
normaliser (compiled character map, extra white space, dummy prefix), the metaspace
marker, the scores (of a unigram model as they are, of a byte-pair model as the order of its
merges) and byte fallback. Batches are encoded and decoded by the library's threads.

Where pieces never hold the marker after another character (checked when a model is
loaded), a text's ids are those of its words, and each distinct word is encoded and decoded once;
with other models whole texts are encoded. Each text's ids are compared with those that the sentencepiece
library gives the whole text. The libraries use as many threads as a task has CPUs.

Defined results: null and empty texts have no ids and decode to an empty text. Texts
with white space other than single blanks and line ends are encoded whole. Repeated rows
are encoded one by one; the other columns are passed on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, gather, map_arrow, per_worker, ranges, task_threads, without_gc
from tallyline.llm.packing import IRREGULAR
from tallyline.llm.words import WordStore, joined

MARK = "▁"
#: Numbers of the protobuf's piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers of varints, bytes of all others."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        yield tag >> 3, value


class PieceModel:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"a SentencePiece model of type {self.kind} has no counterpart in tokenizers")

    def cuts_at_marks(self) -> bool:
        """Whether no piece goes on from another character to a marker, or over a line end.

        Without byte fallback unknown characters on both sides of a cut would be one piece.
        """
        return self.byte_fallback and not self.charsmap and self.escape and self.dummy_prefix and not any(MARK in p[0].lstrip(MARK) or "\n" in p[0] for p in self.pieces)

    def model(self):
        from tokenizers import models

        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        plain = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        merges = [(-plain[p], ids[p], i, (p[:i], p[i:])) for p in plain for i in range(1, len(p)) if p[:i] in plain and p[i:] in plain]
        return models.BPE(ids, [m[3] for m in sorted(merges)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, normalizers

        made = Tokenizer(self.model())
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        made.normalizer = normalizers.Sequence(steps)
        made.decoder = self.decoder(strip=True)
        return made

    def decoder(self, strip: bool):
        """Undoes the marker and byte fallback; strip takes the dummy prefix away again."""
        from tokenizers import decoders

        undo = [decoders.Replace(MARK, " ")] if self.escape else []
        undo += [decoders.ByteFallback()] if self.byte_fallback else []
        undo.append(decoders.Fuse())
        return decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if strip and self.dummy_prefix else []))


class PieceCodec:
    """Encodes and decodes batches; compares what it encodes with the sentencepiece library, if ``verify``."""

    def __init__(self, data: bytes, verify: bool = True, max_bytes: int = 16_000_000):
        from tokenizers import Tokenizer

        self.threads = task_threads()
        self.spec = PieceModel(data)
        self.whole, self.bare = self.spec.tokenizer(), Tokenizer(self.spec.model())
        self.bare.decoder = self.spec.decoder(strip=False)
        self.cut = self.spec.cuts_at_marks()
        self.store = WordStore(self._ids_of_words, max_bytes)
        self.said = pa.array([], pa.string())  # what the ids of each word in the store decode to
        self.judge = None
        if verify:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """words: as they follow the marker, or a line end with what follows it."""
        encode = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        found = [e.ids for e in encode([w if w[:1] == "\n" else MARK + w for w in words.to_pylist()], add_special_tokens=False)]
        self.new.append(pa.array(self.bare.decode_batch(found, skip_special_tokens=False), pa.string()))
        return joined(found)

    def _places(self, words: pa.Array) -> np.ndarray:
        self.new: list[pa.Array] = []
        places = self.store.places(words)
        self.said = pa.concat_arrays([self.said.slice(0, len(self.store.words) - sum(map(len, self.new))), *self.new])
        return places

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids, their number by text and the decoded texts, by words.

        Bytes of one character never lie in two words, so the words' decoded texts make up the text's.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        chunks = lists.flatten().dictionary_encode()
        index = self._places(chunks.dictionary)[chunks.indices.to_numpy(zero_copy_only=False)]
        sizes = self.store.sizes.astype(np.int64)
        ids, each = gather(self.store.flat, np.cumsum(sizes) - sizes, sizes, index)
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        lengths = np.diff(np.concatenate([[0], np.cumsum(each)])[stops], prepend=0)
        words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), self.said.take(pa.array(index)))
        decoded = pc.binary_join(words, "")
        return ids, lengths, pc.if_else(pc.starts_with(decoded, " "), pc.utf8_slice_codeunits(decoded, 1), decoded)

    def agrees(self, texts: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """By text, whether the sentencepiece library gives it the same ids."""
        if not self.judge or not len(texts):
            return np.ones(len(texts), dtype=bool)
        others, counts = joined(self.judge.encode(texts.to_pylist(), num_threads=self.threads))
        same = counts == lengths
        if same.all():
            wrong = np.concatenate([[0], np.cumsum(others != ids)])
            stops = np.cumsum(lengths)
            return wrong[stops] == wrong[stops - lengths]
        stops, own = np.cumsum(counts), np.cumsum(lengths)
        return np.array([s and np.array_equal(others[i - n : i], ids[j - n : j]) for s, n, i, j in zip(same, counts, stops, own, strict=True)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """All ids, the number of each text's, by text whether sentencepiece agrees, and what its ids decode to."""
        regular = pc.invert(pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(texts, ""))) if self.cut else pa.array(np.zeros(len(texts), dtype=bool))
        own, rest = texts.filter(regular), texts.filter(pc.invert(regular))
        ids, sizes, decoded = self._regular(own) if len(own) else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), own)
        if len(rest):
            plain = rest.to_pylist()
            found = [e.ids if t else [] for t, e in zip(plain, self.whole.encode_batch(plain, add_special_tokens=False), strict=True)]
            more, counts = joined(found)
            at = regular.to_numpy(zero_copy_only=False)
            back = np.empty(len(at), dtype=np.int64)
            back[np.concatenate([np.flatnonzero(at), np.flatnonzero(~at)])] = np.arange(len(at))
            sizes = np.concatenate([sizes, counts])
            decoded = pa.concat_arrays([decoded, pa.array(self.decode(found), pa.string())]).take(pa.array(back))
            ids, sizes = gather(np.concatenate([ids, more]), np.cumsum(sizes) - sizes, sizes, back)
        return ids, sizes, self.agrees(texts, ids, sizes), decoded

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


def encode(docs: DataFrame, model: str, text: str = "text", verify: bool = True) -> DataFrame:
    """docs with piece_ids (little-endian unsigned 32-bit ids), n_pieces, decoded (the ids' text) and parity added."""
    data = open(model, "rb").read()
    at, width = docs.columns.index(text), len(docs.columns)
    if clash := {"piece_ids", "n_pieces", "decoded", "parity"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has columns named {', '.join(sorted(clash))}")
    schema = docs.select("*", F.lit(b"").alias("piece_ids"), F.lit(0).cast("long").alias("n_pieces"), F.lit("").alias("decoded"), F.lit(True).alias("parity")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker("pieces", (hash(data), verify), lambda: PieceCodec(data, verify))
        with without_gc():
            for batch in batches:
                texts = arrow_texts(batch.column(at))
                for low, high in ranges(texts, 2_000_000):
                    ids, lengths, same, decoded = codec.encode(texts.slice(low, high - low))
                    ends = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                    added = [packed, pa.array(lengths), decoded, pa.array(same)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in range(width)), *added], names=[*batch.schema.names, "piece_ids", "n_pieces", "decoded", "parity"])

    return map_arrow(docs, run, schema)
