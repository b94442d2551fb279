"""Sum-of-squares online packing of token sequences.

Every task packs the documents it reads. A document is cut into full windows and a
tail; the tail goes to the fill level that makes the sum of squared counts of
partially filled windows smallest, a full window counting nothing. Counts by level
are kept in one array. When a task's documents are placed, its partly filled windows
are topped up from the emptiest ones, and the last one is cut into windows whose
lengths are powers of two, which need no padding.

Defined results: a null text is empty and still ends with the separator, so it has
one token. Repeated rows are packed once each. An equal cost goes to the fullest
level. A task without rows packs nothing. Of the input only the key and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, gather, map_arrow, per_worker, ranges, task_threads, without_gc
from tallyline.llm.words import WordStore, joined

#: Blanks and line ends cut a text where each stands alone between other characters; other texts are encoded whole.
IRREGULAR = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x85\xa0\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FIRST, LINE, PLAIN = "\x01", "\n", " "


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in same else chr(next(rest)) for b in range(256)}


def _cuts_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer's file says what the cuts at blanks, line ends, stops and commas rely on."""
    before = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex") is True
        and before.get("add_prefix_space") is False
        and spec.get("normalizer") is None
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", []))
    )


class ChunkEncoder:
    """Whole texts to ids, exactly the tokenizer's own, most of them by distinct words.

    The byte-level pre-tokenizer puts a border before each single blank, on both sides
    of a single line end, and between letters and the stops and commas that end a
    word. So the ids of a text are those of its words, found in Arrow's dictionary, and
    the tokenizer is called once for each distinct word. Words of letters alone are one pre-token
    each and skip the pre-tokenizer. Texts with other white space or with an added token of the
    tokenizer are encoded whole, as are all texts if the tokenizer's file names another
    pre-tokenizer, a normaliser, or a post-processor.
    """

    def __init__(self, path: str, max_bytes: int = 16_000_000):
        from tokenizers import Tokenizer

        self.threads = task_threads()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.bare = Tokenizer(self.tokenizer.model)
        self.letters = byte_letters()
        self.by_words = _cuts_at_blanks(spec)
        self.odd = "|".join([IRREGULAR, *(re.escape(t["content"]) for t in spec["added_tokens"])])
        self.store = WordStore(self._ids_of_words, max_bytes)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """words: each with the blank before it where it has one."""
        plain = pc.utf8_is_alpha(pc.utf8_ltrim(words, " ")).to_numpy(zero_copy_only=False)
        mapped = "\n".join(words.filter(pa.array(plain)).to_pylist()).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        encode = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        letters = [e.ids for e in encode(mapped, add_special_tokens=False)] if plain.any() else []
        flat, sizes = joined(letters + self._whole(words.filter(pa.array(~plain)).to_pylist()))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return gather(flat, np.cumsum(sizes) - sizes, sizes, back)

    def encode(self, texts: list[str] | pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; ``end``, unless None, follows each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lengths = np.zeros(len(texts), dtype=np.int64)
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(texts, "")).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), dtype=bool)
        own, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, sizes = self._regular(texts.take(pa.array(own))) if len(own) else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        lengths[own] = sizes
        if len(rest):
            others, lengths[rest] = joined(self._whole(texts.take(pa.array(rest)).to_pylist()))
            starts = np.zeros(len(texts), dtype=np.int64)
            starts[own] = np.cumsum(sizes) - sizes
            starts[rest] = len(ids) + np.cumsum(lengths[rest]) - lengths[rest]
            ids, _ = gather(np.concatenate([ids, others]), starts, lengths, np.arange(len(texts)))
        if end is None:
            return ids, lengths
        closed = np.full(len(ids) + len(lengths), end, dtype=np.uint32)
        inner = np.ones(len(closed), dtype=bool)
        inner[np.cumsum(lengths + 1) - 1] = False
        closed[inner] = ids
        return closed, lengths + 1

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        chunks = lists.flatten().dictionary_encode()
        words = chunks.dictionary
        lead, text = pc.utf8_slice_codeunits(words, 0, 1), pc.utf8_slice_codeunits(words, 1)
        line = pc.equal(lead, LINE)
        blank = pc.invert(pc.or_(line, pc.equal(lead, FIRST)))
        text = pc.if_else(blank, words, text)
        trimmed = pc.utf8_rtrim(text, ".,")
        core = pc.if_else(pc.utf8_is_alpha(trimmed), trimmed, text)
        over = (pc.binary_length(text).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)).astype(np.int64)
        stops = [LINE, "", ".", ","]
        tail = np.where(over == 0, 1, 2 + pc.ends_with(text, ",").to_numpy(zero_copy_only=False))
        for k in np.flatnonzero(over > 1):  # runs of stops and commas are rare
            tail[k] = len(stops)
            stops.append(text[int(k)].as_py()[-int(over[k]) :])
        cores = pc.if_else(blank, pc.binary_join_element_wise(" ", core, ""), core).dictionary_encode()
        unit = self.store.places(pa.concat_arrays([cores.dictionary, pa.array(stops, pa.string())]))
        stop = unit[len(cores.dictionary) :]
        parts = np.stack([np.where(line.to_numpy(zero_copy_only=False), stop[0], stop[1]), unit[cores.indices.to_numpy(zero_copy_only=False)], stop[tail]], axis=1)
        sizes = self.store.sizes.astype(np.int64)
        flat, each = gather(self.store.flat, np.cumsum(sizes) - sizes, sizes, parts.ravel())
        sizes = each.reshape(-1, 3).sum(axis=1)
        ids, own = gather(flat, np.cumsum(sizes) - sizes, sizes, chunks.indices.to_numpy(zero_copy_only=False))
        per_text = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return ids, np.diff(np.concatenate([[0], np.cumsum(own)])[per_text], prepend=0)


class Packer:
    """One task's windows: closed ones are handed over, open ones are found by their level."""

    def __init__(self, size: int = 1024):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.closed: list[list] = []

    def level(self, tail: int) -> int:
        """The level to fill up, 0 for a new window."""
        n, size = self.counts, self.size
        low = n[1 : size - tail + 1]
        if not low.any():
            return 0
        cost = 2 * (n[1 + tail : size + 1] - low + 1)
        cost[-1] = 1 - 2 * low[-1]
        cost = np.where(low > 0, cost, np.iinfo(np.int64).max)
        best = len(cost) - 1 - int(cost[::-1].argmin())
        return best + 1 if cost[best] <= 2 * n[tail] + 1 else 0

    def add(self, key, ids: np.ndarray) -> None:
        """ids: all of a document's."""
        n, size = len(ids), self.size
        full = n - n % size
        for k in range(0, full, size):
            self.closed.append([(key, k, ids[k : k + size], n)])
        if full < n:
            self._place((key, full, ids[full:].copy(), n))

    def _place(self, piece: tuple) -> None:
        tail = len(piece[2])
        level = self.level(tail)
        window = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        window.append(piece)
        if level + tail == self.size:
            self.closed.append(window)
        else:
            self.counts[level + tail] += 1
            self.open[level + tail].append(window)

    def finish(self) -> None:
        """Tops up the fullest open windows with what the emptiest hold; the last is cut by powers of two."""
        left = [[w, level] for level in range(self.size, 0, -1) for w in self.open[level]]
        i, j = 0, len(left) - 1
        while i < j:
            room = self.size - left[i][1]
            if not room:
                self.closed.append(left[i][0])
                i += 1
                continue
            key, start, ids, n = left[j][0].pop()
            take = min(room, len(ids))
            left[i][0].append((key, start, ids[:take], n))
            if take < len(ids):
                left[j][0].append((key, start + take, ids[take:], n))
            left[i][1] += take
            left[j][1] -= take
            j -= not left[j][1]
        for window, level in left[i : i + 1]:
            if level == self.size:
                self.closed.append(window)
                continue
            pieces = window[::-1]
            for part in (1 << b for b in range(self.size.bit_length() - 1, -1, -1) if level >> b & 1):
                out, need = [], part
                while need:
                    key, start, ids, n = pieces.pop()
                    take = min(need, len(ids))
                    out.append((key, start, ids[:take], n))
                    if take < len(ids):
                        pieces.append((key, start + take, ids[take:], n))
                    need -= take
                self.closed.append(out)
        self.counts[:] = 0
        self.open = [[] for _ in range(self.size + 1)]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 1024, end: int = 0, max_bytes: int = 4_000_000) -> DataFrame:
    """A row per piece: key, start, length, doc_tokens, sequence_id, offset, padded_to, ids (little-endian, unsigned, 32 bits each).

    padded_to is the sequence's length in the output: its own where that is a power
    of two, else ``size``. sequence_id holds the task's number in its upper 31 bits.
    """

    def rows(windows: list[list], first: int, kind: pa.DataType) -> pa.RecordBatch:
        """The pieces of closed windows, which are numbered from ``first`` on."""
        pieces = [p for window in windows for p in window]
        number = np.repeat(np.arange(first, first + len(windows)), [len(w) for w in windows])
        length = np.fromiter((len(p[2]) for p in pieces), dtype=np.int64, count=len(pieces))
        before = np.cumsum(length) - length
        opens = np.flatnonzero(np.diff(number, prepend=first - 1))
        filled = np.add.reduceat(length, opens)[number - first]
        padded = np.where(filled & (filled - 1), size, filled)
        data = np.concatenate([p[2] for p in pieces]).astype("<u4")
        ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        start, tokens = (np.fromiter((p[k] for p in pieces), dtype=np.int64, count=len(pieces)) for k in (1, 3))
        columns = [pa.array([p[0] for p in pieces], kind), *map(pa.array, (start, length, tokens, number, before - before[opens][number - first], padded)), ids]
        return pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_to", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = per_worker("packing", tokenizer, lambda: ChunkEncoder(tokenizer)), Packer(size)
        at, kind = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal at
            while packer.closed:
                some, packer.closed = packer.closed[:512], packer.closed[512:]
                yield rows(some, at, kind)
                at += len(some)

        with without_gc():
            for batch in batches:
                kind = batch.column(0).type
                keys, texts = batch.column(0).to_pylist(), arrow_texts(batch.column(1))
                for low, high in ranges(texts, max_bytes):
                    ids, lengths = encoder.encode(texts.slice(low, high - low), end)
                    stop = np.cumsum(lengths)
                    for k in range(low, high):
                        packer.add(keys[k], ids[stop[k - low] - lengths[k - low] : stop[k - low]])
                    yield from closed()
            packer.finish()
            yield from closed()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, padded_to long, ids binary"
    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema).withColumnRenamed("key", key)
