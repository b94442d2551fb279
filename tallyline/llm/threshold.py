"""Ranked lexical search by Fagin's threshold algorithm over shards of documents.

One pass reads every text and keeps, for each document, its number of terms and its postings: the query
terms it holds and how often. From these come the counts that weights depend on. A second pass
cuts the postings into shards that fit a task's memory, each a forward index. In a shard every query term has
a list of its documents, sorted by impact. Queries read their lists in turn, from the top and equally deep, look up the
full score of each document met in the forward index, and stop once the threshold, the sum of the
impacts last read, falls strictly below the lowest of the best scores so far. These carry over from shard to
shard of a task, so later shards stop earlier. The tasks' best are merged by a window that
drops all but the best of each query before the shuffle.

Nothing but counts of query terms reaches the driver. Queries are taken in blocks of up to ``block_terms``
terms, so these counts and what tasks are sent are bounded.

Defined results: null texts and texts without a term count nowhere and are never found. Repeated rows are
documents of their own. Equal scores are ordered by ascending key, null last. Rows that share an item's key (null
is one too) are one item with the terms of all; items without a term, and empty tables, have no rows.
Of the inputs only keys and texts are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, gather, map_arrow, materialise, ranges, without_gc, word_ids

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SLICE_BYTES = 4_000_000


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, terms): a row per item, its distinct terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, words = word_ids(arrow_texts(batch.column(1)), TERM, ascii_only=True)
            terms = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(words, pa.string()).take(pa.array(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], names=["item", "terms"])

    kind = items.schema[key].dataType.simpleString()
    found = map_arrow(items.select(F.col(key).alias("item"), F.col(text).alias("text")), run, f"item {kind}, terms array<string>")
    return found.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("terms")))).alias("terms")).filter("size(terms) > 0")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """Items in blocks of up to that many terms; one with more has a block of its own."""
    block, held = [], 0
    for item, terms in items.toLocalIterator(prefetchPartitions=True):
        if block and held + len(terms) > block_terms:
            yield block
            block, held = [], 0
        block.append((item, terms))
        held += len(terms)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: list[str], key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs): a row per document with a term; which of the vocabulary's terms it has, by place, ascending, and how often."""
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in batches:
                texts = arrow_texts(batch.column(1))
                for low, high in ranges(texts, SLICE_BYTES):
                    yield of(batch.column(0).slice(low, high - low), texts.slice(low, high - low))

    def of(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, counts, words = word_ids(texts, TERM, ascii_only=True)
        place = pc.index_in(pa.array(words, pa.string()), value_set=known)
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)[ids] if len(words) else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)[place >= 0]
        pair, tf = np.unique(doc * len(known) + place[place >= 0], return_counts=True)
        ends = np.searchsorted(pair, np.arange(len(counts) + 1) * len(known)).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % len(known), tf)]
        return pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int64)), *columns], names=["key", "n", "terms", "tfs"]).filter(pa.array(counts > 0))

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n long, terms array<int>, tfs array<int>")


class Shard:
    """Some documents: a forward index, and by term a list of them, the highest impact first."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.starts, self.sizes, self.terms, self.impacts = ends[:-1], np.diff(ends), terms, impacts
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((-impacts, terms))
        self.listed, self.sorted = doc[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(self.sizes), dtype=bool)

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Random access: the documents' full scores for a query; asked: by term, 1 for its own and 0 for others."""
        at, sizes = gather(np.arange(len(self.terms)), self.starts, self.sizes, docs)
        return np.add.reduceat(asked[self.terms[at]] * self.impacts[at], np.cumsum(sizes) - sizes)

    def search(self, query: np.ndarray, asked: np.ndarray, k: int, floor: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among a query's k best, and their scores; floor: a score that k documents elsewhere reach (0: none).

        Lists are read ``step`` entries at a time, then as many again as before.
        """
        low, high = self.lists[query], self.lists[query + 1]
        docs, scores, depth = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        self.seen[:] = False
        while True:
            begin, depth = depth, max(step, depth * 2)
            ends = np.minimum(low + depth, high)
            sizes = np.maximum(ends - np.minimum(low + begin, high), 0)
            met, _ = gather(self.listed, low + begin, sizes, np.flatnonzero(sizes))
            met = np.unique(met[~self.seen[met]])
            self.seen[met] = True
            if len(met):
                docs, scores = np.concatenate([docs, met]), np.concatenate([scores, self.scores(met, asked)])
            open_ = low + depth < high
            if not open_.any():
                break
            kth = max(floor, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0)
            if int(self.sorted[low[open_] + depth - 1].sum()) < kth:
                break
            keep = scores >= kth  # kth only rises
            docs, scores = docs[keep], scores[keep]
        return docs, scores


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows with about ``most`` postings together; no row is split."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(ends):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + most - size, side="right")))
            held.append(batch.slice(low, high - low))
            size += int(ends[high - 1]) - before
            low = high
            if size >= most or low < len(ends):
                yield held
                held, size = [], 0
    if held:
        yield held


def _best(forward: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_postings: int) -> DataFrame:
    """(query, key, score): of each task and query, the rows that may be among the k best."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]  # (-score, null last, key), sorted, k at most
        kind = None
        asked = np.zeros(len(weights), dtype=np.int64)
        for rows in _shards(batches, shard_postings):
            kind = rows[0].column(0).type
            keys = pa.chunked_array([b.column(0) for b in rows])
            n, terms, tfs = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in own]).astype(np.int64) for own in ([b.column(1) for b in rows], [b.column(2).flatten() for b in rows], [b.column(3).flatten() for b in rows]))
            ends = np.concatenate([[0], np.cumsum(np.concatenate([pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False) for b in rows]))]).astype(np.int64)
            m = np.repeat(10 + (90 * n * n_docs) // n_terms, np.diff(ends))
            shard = Shard(ends, terms, weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m)), len(weights))
            for q, query in enumerate(queries):
                asked[query] = 1
                floor = -best[q][-1][0] if len(best[q]) == k else 0
                docs, scores = shard.search(query, asked, k, floor)
                asked[query] = 0
                good = scores > 0
                docs, scores = docs[good], scores[good]
                if len(docs) > k:
                    good = scores >= max(np.partition(scores, -k)[-k], floor)
                    docs, scores = docs[good], scores[good]
                found = [(-int(s), x is None, x) for s, x in zip(scores, keys.take(pa.array(docs)).to_pylist(), strict=True)]
                if found:
                    best[q] = sorted(best[q] + found, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
        flat = [(q, x, -s) for q, own in enumerate(best) for s, _, x in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], kind), pa.array([r[2] for r in flat], pa.int64())], names=["query", "key", "score"])

    return map_arrow(forward, run, f"query int, key {forward.schema['key'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10, block_terms: int = 200_000, shard_postings: int = 2_000_000) -> DataFrame:
    """(item, rank, key, score): each item's k best documents with a score above 0, best first.

    A task holds ``shard_postings`` postings at a time, more only where one document has more.
    """
    spark = docs.sparkSession
    kinds = items.schema[item].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    found: DataFrame | None = None
    for block in _blocks(item_terms(items, item, item_text), block_terms):
        vocabulary = sorted({t for _, terms in block for t in terms})
        at = {t: i for i, t in enumerate(vocabulary)}
        queries = [np.array(sorted(at[t] for t in terms), dtype=np.int64) for _, terms in block]
        forward = materialise(postings(docs, vocabulary, key, text), "postings")
        n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for term, own in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as the block has terms
            df[term] = own
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item {kinds[0]}")
        best = _best(forward, queries, weights, n_docs, n_terms, k, shard_postings).join(F.broadcast(names), "query").drop("query")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"`{item}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last()))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
