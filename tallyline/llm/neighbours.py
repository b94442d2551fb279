"""Approximate nearest neighbours by score-aware quantisation.

Unit vectors are cut into pairs of components, each coded with four bits. Codebooks
and codes minimise an anisotropic loss that weighs the residual parallel to the
vector more than the rest, since that part moves large inner products. A query
makes a table of its products with all codewords; table look-ups rank the whole
index, and the best of every batch are ranked again by exact cosines in double precision.

The codebooks are fitted on a bounded sample; every usable row is in the index.
The index is dealt to blocks of bounded size, and queries meet them by a shuffle.

Defined results: vectors that are null, zero, of another length than most, or that hold null
or non-finite components take no part. Equal vectors share one code and one score, and
ties go to the smaller id. A query isn't its own neighbour, nor are rows that repeat its id.
Fewer rows than asked for give fewer neighbours. Rows with a null id are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import map_arrow, materialise, unit_hash


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as float64 rows, and their places."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((sizes == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    if not len(rows):
        return np.zeros((0, dim)), rows
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(dim)]
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return vectors[good], rows[good]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, which are exact and leave no square to overflow or vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / _norms(vectors)[:, None]


class AnisotropicQuantiser:
    """Sixteen codewords for every two components; two codes to a byte."""

    def __init__(self, dim: int, threshold: float = 0.2, seed: int = 3):
        self.dim, self.parts = dim, -(-dim // 4) * 2
        self.weight = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1)  # of the squared parallel residual, beyond 1
        self.seed = seed
        self.words = np.zeros((self.parts, 16, 2))

    def _split(self, unit: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(unit), self.parts * 2))
        padded[:, : self.dim] = unit
        return padded.reshape(len(unit), self.parts, 2)

    def _choose(self, parts: np.ndarray, sweeps: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Codes by coordinate descent, and each part's parallel residual."""
        away = parts[:, :, None, :] - self.words
        error, along = (away * away).sum(axis=3), (away * parts[:, :, None, :]).sum(axis=3)
        codes = error.argmin(axis=2)
        rows = np.arange(len(parts))
        own = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0]
        total = own.sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - own[:, m]
                codes[:, m] = (error[:, m] + self.weight * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                own[:, m] = along[rows, m, codes[:, m]]
                total = rest + own[:, m]
        return codes, own

    def fit(self, vectors: np.ndarray, rounds: int = 6) -> AnisotropicQuantiser:
        parts = self._split(_unit(vectors))
        rng = np.random.default_rng(self.seed)
        pick = rng.choice(len(parts), 16, replace=len(parts) < 16)
        self.words = parts[pick].transpose(1, 0, 2).copy()
        for _ in range(rounds):
            blocks = [self._choose(parts[k : k + 2000], 1) for k in range(0, len(parts), 2000)]  # bounds the tables' memory
            codes, own = (np.concatenate(x) for x in zip(*blocks, strict=True))
            total = own.sum(axis=1)
            for m in range(self.parts):
                x, rest = parts[:, m], total - own[:, m]
                aim = x * (1 + self.weight * (rest + (x * x).sum(axis=1)))[:, None]
                for k in range(16):
                    at = codes[:, m] == k
                    if at.any():
                        self.words[m, k] = np.linalg.lstsq(at.sum() * np.eye(2) + self.weight * x[at].T @ x[at], aim[at].sum(axis=0), rcond=None)[0]
        return self

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, bytes) of packed codes."""
        out = [self._choose(self._split(_unit(vectors[k : k + 2000])))[0] for k in range(0, len(vectors), 2000)]
        codes = np.concatenate(out) if out else np.zeros((0, self.parts), dtype=np.int64)
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): products of the queries with both codewords of a byte."""
        four = np.einsum("qmd,mkd->qmk", self._split(_unit(queries)), self.words)
        low, high = four[:, ::2], four[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


class Block:
    """Rows of the index that are searched together; equal vectors are looked at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors, codes = ids[order], vectors[order], codes[order]
        raw = np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * 8}").ravel()
        _, self.first, group = np.unique(raw, return_index=True, return_inverse=True)
        self.members = np.argsort(group, kind="stable")
        self.starts = np.searchsorted(group[self.members], np.arange(len(self.first) + 1))
        self.vectors, self.codes = _scaled(vectors[self.first]), codes[self.first]
        self.norms = _norms(self.vectors)

    def nearest(self, query_id: int, query: np.ndarray, table: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best; query: scaled; table: its products with the codewords."""
        near = table[0][self.codes[:, 0]]
        for b in range(1, self.codes.shape[1]):
            near = near + table[b][self.codes[:, b]]
        some = np.argpartition(-near, depth)[:depth] if len(near) > depth else np.arange(len(near))
        exact = (self.vectors[some] * query).sum(axis=1) / (self.norms[some] * np.sqrt((query * query).sum()))
        own, scores = [], []
        for at in np.lexsort((self.first[some], -exact))[: k + 1]:
            g = some[at]
            ids = np.unique(self.ids[self.members[self.starts[g] : self.starts[g + 1]]])[: k + 1]
            ids = ids[ids != query_id][:k]
            own.append(ids)
            scores.append(np.full(len(ids), exact[at]))
        own, scores = np.concatenate(own), np.concatenate(scores)
        best = np.lexsort((own, -scores))[:k]
        return own[best], scores[best]


def fit(vectors: DataFrame, key: str, vector: str, sample: int = 20_000) -> AnisotropicQuantiser | None:
    """Codebooks from about ``sample`` rows chosen by a hash of the key; None if there is nothing to fit on."""
    usable = vectors.filter(F.col(key).isNotNull() & (F.size(vector) > 0))
    sizes = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    n, dim = sizes[0]["count"], sizes[0]["d"]
    rows = usable.filter((F.size(vector) == dim) & (unit_hash(key) < min(1.0, sample / n))).select(F.col(vector).cast("array<double>")).toArrow()
    chosen = _matrix(rows.column(0).combine_chunks(), dim)[0] if rows.num_rows else np.zeros((0, dim))
    return AnisotropicQuantiser(dim).fit(chosen) if len(chosen) else AnisotropicQuantiser(dim)


def build(vectors: DataFrame, model: AnisotropicQuantiser, key: str, vector: str) -> DataFrame:
    """The index, written to the shared folder: id, vector, code of every usable row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = _matrix(batch.column(1), model.dim)
            codes = model.encode(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vector", "code"])

    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    named = usable.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return materialise(map_arrow(named, run, "id long, vector array<double>, code binary"), "vectors")


def search(index: DataFrame, model: AnisotropicQuantiser, chosen, k: int = 5, depth: int = 500, block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest to each indexed row that the condition ``chosen`` (on id) picks.

    The index is dealt by hash to blocks of about ``block`` rows (fewer where there are more CPUs than blocks), and
    every query is sent to every block, where it meets the rows in one task; the best of all blocks are ranked.
    """
    rows = index.count()
    blocks = max(1, -(-rows // block), min(index.sparkSession.sparkContext.defaultParallelism, -(-rows // 4096)))
    deal = F.pmod(F.xxhash64("id", "code"), F.lit(blocks)).cast("int")
    held = index.select(deal.alias("block"), F.lit(False).alias("query"), "id", "vector", "code")
    asked = index.filter(chosen).dropDuplicates(["id", "code"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "id", "vector", "code")
    dealt = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "query")
    found = map_arrow(dealt, _searcher(model, k, depth), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(model: AnisotropicQuantiser, k: int, depth: int):
    """Of rows sorted by block, queries last: keeps a block's rows and answers the queries that follow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, made = None, [], None
        for batch in batches:
            blocks, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                ids = batch.column(2).to_numpy()[low:high]
                vectors = _matrix(batch.column(3).slice(low, high - low), model.dim)[0]
                if blocks[low] != number:
                    number, parts, made = blocks[low], [], None
                if not asks[low]:
                    codes = np.frombuffer(b"".join(batch.column(4).slice(low, high - low).to_pylist()), dtype=np.uint8).reshape(high - low, -1)
                    parts.append((ids, vectors, codes))
                    continue
                if made is None and parts:
                    made, parts = Block(*map(np.concatenate, zip(*parts, strict=True))), []
                if made is not None:
                    yield from _answers(model, made, ids, _scaled(vectors), k, depth)

    return run


def _answers(model: AnisotropicQuantiser, block: Block, ids: np.ndarray, queries: np.ndarray, k: int, depth: int, step: int = 256) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(ids), step):
        some, tables = ids[low : low + step], model.tables(queries[low : low + step])
        found = [block.nearest(int(i), q, t, k, depth) for i, q, t in zip(some, queries[low : low + step], tables, strict=True)]
        columns = [np.repeat(some, [len(f[0]) for f in found]), *(np.concatenate([f[c] for f in found]) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, **options) -> DataFrame:
    """The k nearest rows by cosine of every row whose key is divisible by ``every``."""
    model = fit(vectors, key, vector)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(build(vectors, model, key, vector), model, F.col("id") % every == 0, k, **options)
