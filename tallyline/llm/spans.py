"""Substring deduplication by sliding spans of sentences.

A sentence ends after a stop or at a line's end. One of more than ``LONG`` words is cut
further after words picked by a checksum, so that a long passage without stops has parts that
stand in every copy of it; a part counts as a sentence below. A run may also begin
at a capitalised word, as passages are often pasted behind an unfinished sentence. The shortest run of two or
more sentences with ``least_words`` words from each beginning, and the shortest to each
end, are hashed; together they cover every longer run. Equal hashes of all documents meet in one aggregate,
which keeps the first occurrence (smallest key, then place); every other one is joined
back and the words that it covers are removed. Case and white space don't count.

Defined results: a null text stays null, an empty one empty. Rows with equal keys (or null ones)
and equal texts count as one document, so a repeated row keeps what the first keeps; other texts
under that key are documents of their own. Null keys come after all others. Text without
blanks counts a word for every six characters. All columns are passed on; one that has the name of the count raises
ValueError. Removal may leave an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, free_name, map_arrow, materialise, ranges, without_gc

#: A repeated passage of 50 words whose first LONG run on from the text before it still has LEAST_WORDS in whole sentences.
LEAST_WORDS = 30
#: Words of a sentence above which it is cut further, after one word in CUT.
LONG, CUT = 20, 8
#: A sentence in a script without blanks ends a token.
TOKEN = re.compile(r"[^ \t\r\n。！？]*[。！？]|[^ \t\r\n。！？]+")
STOPS = (".", "!", "?", "…", "。", "！", "？")
CLOSERS = "\"'”’»)]"
#: Powers of an odd number and of its inverse modulo 2 ** 64: a run's hash is a difference of prefix sums, moved to the front.
FACTOR = 0x9E3779B97F4A7C15


class Tokens:
    """The tokens of a slice of texts, one after another, as arrays."""

    def __init__(self, texts: pa.Array):
        for mark, to in (("\t", " "), ("\r", " "), ("\n", " \n ")):
            texts = pc.replace_substring(texts, mark, to)
        if pc.any(pc.match_substring_regex(texts, "[。！？]")).as_py():
            texts = pc.replace_substring_regex(texts, "([。！？])", "\\1 ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        kept = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[index]
        index, text = index[kept], text[kept]
        line = pc.equal(distinct, "\n").to_numpy(zero_copy_only=False)[index]
        self.index, self.text = index[~line], text[~line]
        self.first = np.searchsorted(self.text, np.arange(len(lists) + 1))  # of each text, and the end
        # A line's end and a text's end close a sentence, as does a stop.
        last = np.zeros(len(index) + 1, dtype=bool)
        last[np.flatnonzero(line)] = True
        last[np.flatnonzero(np.diff(text, append=-1)) + 1] = True
        bare = pc.utf8_rtrim(distinct, CLOSERS)
        stops = np.any([pc.ends_with(bare, stop).to_numpy(zero_copy_only=False) for stop in STOPS], axis=0)
        self.closed = stops[self.index] | last[1:][~line]
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, pc.utf8_lower(distinct).to_pylist()), dtype=np.uint64, count=len(distinct))
        length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = np.maximum(1, length // 6 * (length > 40))
        self.capital = pc.utf8_is_upper(pc.utf8_slice_codeunits(distinct, 0, 1)).to_numpy(zero_copy_only=False)

    def sentences(self) -> np.ndarray:
        """The number of each token's sentence."""
        return np.cumsum(self.closed) - self.closed

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs may begin and where they may end, as flags by token: a run is [begin, end]."""
        sentence = self.sentences()
        words = np.bincount(sentence, weights=self.weight[self.index], minlength=1)
        picked = (self.hash >> np.uint64(7)) % np.uint64(CUT) == 0
        end = self.closed | picked[self.index] & (words[sentence] > LONG)
        begin = np.ones(len(end), dtype=bool)
        begin[1:] = end[:-1]
        return begin | self.capital[self.index], end

    def runs(self, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, token after the last, hash) of the shortest long enough run from each beginning and to each end."""
        if not len(self.index):
            return (np.zeros(0, dtype=np.int64),) * 3
        begin, end = (np.flatnonzero(x) for x in self.bounds())
        weight = self.weight[self.index]
        before = np.cumsum(weight) - weight  # words before each token
        upto = before[end] + weight[end]  # words up to each end
        # from each beginning: two ends at least, and the words
        nth = np.maximum(np.searchsorted(end, begin) + 1, np.searchsorted(upto, before[begin] + least_words))
        fits = nth < len(end)
        a, b = begin[fits], end[nth[fits]]
        # to each end: a beginning with another end between, and the words
        inner = np.searchsorted(end, end) - 1  # the end before this one
        nearest = np.searchsorted(begin, np.where(inner >= 0, end[inner], -1), side="right") - 1
        nth = np.minimum(nearest, np.searchsorted(before[begin], upto - least_words, side="right") - 1)
        fits = nth >= 0
        a, b = np.concatenate([a, begin[nth[fits]]]), np.concatenate([b, end[fits]])
        inside = self.text[a] == self.text[b]
        pairs = np.unique((a[inside] << 32) | (b[inside] + 1))
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        return a, b, self._hashes(a, b)

    def _hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of token runs [a, b)."""
        own = self.hash[self.index]
        power, back = (np.full(len(own), f, dtype=np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        power[0] = back[0] = 1
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(own * np.cumprod(power))])
        x = (sums[b] - sums[a]) * np.cumprod(back)[a]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def _unique(docs: DataFrame, key: str, text: str) -> bool:
    """Whether the key is a whole number, never null, and stands for one text."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    sums = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("sum")).groupBy("key").agg(F.min("sum").alias("least"), F.max("sum").alias("most"))
    return not sums.filter("key is null or least <> most").limit(1).count()


def _identity(key: str, text: str, unique: bool) -> dict[str, Column]:
    """What tells rows apart and puts them in order: the key alone if that suffices, else with a hash of key and text as ``row``."""
    if unique:
        return {"row": F.col(key).cast("long")}
    return {"row": F.xxhash64(F.col(key).isNull(), F.col(text).isNull(), F.col(key), F.col(text)), "no_key": F.col(key).isNull(), "key": F.col(key)}


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, unique: bool = False) -> DataFrame:
    """(row, [no_key, key,] first, size, hash) of every run of every text, in tokens; row is the identity of the input's row."""
    named = docs.select(*[c.alias(n) for n, c in _identity(key, text, unique).items()], F.col(text).alias("text"))
    schema = named.select(*named.columns[:-1], F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash")).schema
    width = len(named.columns) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in batches:
                texts = arrow_texts(batch.column(width))
                for low, high in ranges(texts, 2_000_000):
                    tokens = Tokens(texts.slice(low, high - low))
                    a, b, hashes = tokens.runs(least_words)
                    own = tokens.text[a]
                    at, start = pa.array(low + own), tokens.first[own]
                    columns = [*(c.take(at) for c in batch.columns[:width]), pa.array((a - start).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(hashes)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(named, run, schema)


def _common(drawn: DataFrame, most: int = 1000) -> DataFrame:
    """(hash, hot) of hashes that make up more than 1 / most of the runs of some documents, so fewer than ``most`` rows."""
    counts = materialise(drawn.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "span-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * most > total).orderBy(F.desc("n"), "hash").limit(most).select("hash", F.lit(True).alias("hot"))


def repeated(found: DataFrame, drawn: DataFrame, salts: int = 64) -> DataFrame:
    """(row, first, size) of the spans that aren't the first of their kind.

    Runs meet by hash. Those of hashes that are very common in ``drawn`` are dealt to ``salts`` groups, and
    only the first of each group goes on to a second comparison; the result is the same whatever was drawn.
    """
    place = [F.col(c) for c in ("no_key", "key", "row", "first") if c in found.columns]
    dealt = found.join(F.broadcast(_common(drawn)), "hash", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).otherwise(0))
    ranked = dealt.withColumn("n", F.dense_rank().over(Window.partitionBy("hash", "salt").orderBy(*place))).filter("n > 1 or hot").drop("salt")
    ranked = materialise(ranked, "span-ranks")
    heads = ranked.filter("n = 1").withColumn("n", F.dense_rank().over(Window.partitionBy("hash").orderBy(*place)))
    return ranked.filter("n > 1").unionByName(heads.filter("n > 1")).select("row", "first", "size")


def without(text: str, gone: np.ndarray) -> str:
    """The text without the tokens that are flagged."""
    starts = [m.start() for m in TOKEN.finditer(text)]
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    starts.append(len(text))
    left, at = [], 0
    for first, stop in zip(edges[::2], edges[1::2], strict=True):
        left.append(text[at : starts[first]])
        at = starts[stop]
    left.append(text[at:])
    return "".join(left).strip()


def _removed(texts: pa.Array, cover: pa.ListArray) -> tuple[list[str], np.ndarray]:
    """The texts without the tokens of their ranges (first, size), and how many sentences lost any."""
    tokens, ranges_ = Tokens(texts), cover.flatten()
    first, size = (ranges_.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("first", "size"))
    first += np.repeat(tokens.first[:-1], pc.list_value_length(cover).to_numpy(zero_copy_only=False))
    marks = np.bincount(first, minlength=len(tokens.index) + 1) - np.bincount(first + size, minlength=len(tokens.index) + 1)
    gone = np.cumsum(marks)[:-1] > 0
    left = [without(text, gone[low:high]) for text, low, high in zip(texts.to_pylist(), tokens.first[:-1], tokens.first[1:], strict=True)]
    sentence = tokens.sentences()
    hit = np.unique(sentence[gone])
    return left, np.bincount(tokens.text[np.searchsorted(sentence, hit)], minlength=len(texts))


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, removed_name: str | None = None) -> DataFrame:
    """docs with repeated spans taken out of the text; removed_name adds a column with the number of sentences removed, as a whole or in part."""
    if removed_name and removed_name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column named {removed_name}; give another name")
    unique = _unique(docs, key, text)
    drop, mark = free_name(docs.columns, "_drop"), free_name(docs.columns, "_row")
    row = _identity(key, text, unique)["row"]
    some = docs.filter(F.pmod(F.xxhash64(row), F.lit(64)) == 0)
    bits = repeated(spans(docs, key, text, least_words, unique), spans(some, key, text, least_words, unique))
    cover = bits.groupBy(F.col("row").alias(mark)).agg(F.collect_set(F.struct("first", "size")).alias(drop))
    joined = docs.withColumn(mark, row).join(cover, mark, "left").select(*docs.columns, drop)
    at, width = docs.columns.index(text), len(docs.columns)
    taken = removed_name or free_name(docs.columns, "_removed")
    schema = docs.select("*", F.lit(0).alias(taken)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at), np.zeros(batch.num_rows, dtype=np.int32)
            hit = np.flatnonzero(batch.column(width).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                values, rows = texts.to_pylist(), pa.array(hit)
                own, cover = arrow_texts(texts).take(rows), batch.column(width).take(rows)
                for low, high in ranges(own, 2_000_000):
                    left, gone[hit[low:high]] = _removed(own.slice(low, high - low), cover.slice(low, high - low))
                    for k, value in zip(hit[low:high].tolist(), left, strict=True):
                        values[k] = value
                texts = pa.array(values, texts.type)
            columns = [*batch.columns[:at], texts, *batch.columns[at + 1 : width], pa.array(gone)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], taken])

    out = map_arrow(joined, run, schema)
    return out if removed_name else out.drop(taken)
