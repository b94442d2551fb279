"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its runs of five words. Equal sets are one node. A
node carries a MinHash sketch; the token with the smallest hash under a coordinate is a
sampled token of its set, so sets that share it are split into one bucket. A run starts
from one coordinate and splits any bucket larger than ``bucket`` again on further
coordinates, chosen by the bucket itself, two children for each set, which keeps the
expected number of similar sets that stay together above one. Small buckets, and
those whose sets are similar on average, are compared by brute force in tiles of bounded size.
Runs are repeated until a pair at the threshold is missed with a probability of less
than 1 - recall. A pair stays together in fewer runs the lower the threshold and the deeper
the splits, so where too many runs would be needed, fewer levels are split: buckets are larger, tiles as
small as ever. No threshold is refused. Sketches only choose; every link is confirmed on whole sets.

A pair that meets in several buckets counts in the first one alone, so tiles need not
send pairs: they send each set's number of links and a star that connects what is
linked. Stars are joined to classes by labels and pointer jumping.

Defined results: a text of one to four words is a single run; null and wordless
texts have no set, no links and a class of their own. Copies are one node; links
count documents. A class is named by its smallest key; a null key names none unless all
keys are null. Rows with equal keys are separate documents. Only key and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, discard_frames, join_split, map_arrow, materialise, ranges, without_gc, word_ids

WORD = re.compile(r"\w+")
#: Of a sketch, at least; more runs than that take as many.
COORDINATES = 64
#: Runs of which splitting takes as many levels as were asked for; where more would be needed, buckets are split less often.
MOST_RUNS = 255
#: An estimate from 64 coordinates is this far below the truth in one of some ten thousand pairs.
SLACK = 0.2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word runs of all texts, and the number of each text's; a text's are sorted."""
    import xxhash

    ids, counts, words = word_ids(texts, WORD)
    if not len(ids):
        return np.zeros(0, dtype=np.uint64), counts
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)[ids]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(ids))  # words up to the text's end
    text = np.repeat(np.arange(len(counts)), counts)
    run = np.zeros(len(ids), dtype=np.uint64)
    for j in range(size):
        later = np.zeros(len(ids), dtype=np.uint64)
        later[: len(ids) - j] = hashes[j:]
        run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(left > j, later, np.uint64(0))
    own = (left >= size) | (left == counts[text]) & (counts[text] < size)
    run, text = _mix(run[own]), text[own]
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    return run[new], np.bincount(text[new], minlength=len(counts))


def _sketches(shingles: np.ndarray, starts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """(sets, coordinates) of smallest hashes, 32 bits each; starts: of sets that aren't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    high = shingles.astype(np.uint32)
    out = np.empty((len(starts), coordinates), dtype=np.uint32)
    rng = np.random.default_rng(17)
    for c in range(coordinates):
        a, b = (int(x) for x in rng.integers(1, 1 << 32, 2))
        x = low * np.uint32(a | 1) + high * np.uint32(b | 1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, c] = np.minimum.reduceat(x, starts)
    return out


def _hash_sets(texts: pa.Array, sketch: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """By text: node (a hash of its set), set size, and a sketch of that many coordinates or for 0 the set, as bytes; nulls without words."""
    shingles, counts = shingle_sets(texts)
    rows, ends = np.flatnonzero(counts), np.cumsum(counts)
    nodes, payload = [None] * len(texts), [None] * len(texts)
    if len(rows):
        starts = (ends - counts)[rows]
        mixed = np.add.reduceat(_mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts) + np.add.reduceat(shingles, starts) * np.uint64(3)
        names = _mix(mixed ^ counts[rows].astype(np.uint64)).astype(np.int64)
        held = _sketches(shingles, starts, sketch) if sketch else None
        for k, row in enumerate(rows):
            nodes[row] = int(names[k])
            payload[row] = held[k].tobytes() if sketch else shingles[starts[k] : ends[row]].tobytes()
    return pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(payload, pa.binary())


def _hasher(sketch: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in batches:
                texts = arrow_texts(batch.column(1))
                for low, high in ranges(texts, 4_000_000):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *_hash_sets(texts.slice(low, high - low), sketch)], names=["key", "node", "size", "data"])

    return run


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first columns; rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for low, high in zip([0, *change], [*change, batch.num_rows], strict=True):
            part = batch.slice(low, high - low)
            if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _dense(members: DataFrame, sketch: DataFrame, share: float = 0.5, coordinates: int = 16) -> DataFrame:
    """(path, dense) of buckets: dense if the members agree with one of them, drawn by hash, in half of the coordinates on average.

    Such a bucket holds near-copies, which further splitting would only multiply.
    """
    held = members.select("node", "path").join(sketch, "node").select("path", F.xxhash64("node", "path").alias("lot"), F.substring("sketch", 1, 4 * coordinates).alias("part"))
    drawn = materialise(held.groupBy("path").agg(F.min(F.struct("lot", "part")).alias("drawn")), "drawn")
    alike = sum(((F.substring("part", 4 * c + 1, 4) == F.substring("drawn.part", 4 * c + 1, 4)).cast("int") for c in range(coordinates)), F.lit(0))
    return held.join(drawn, "path").groupBy("path").agg((F.avg(alike) >= share * coordinates).alias("dense"))


def plan_runs(threshold: float, recall: float, depth: int) -> tuple[int, int]:
    """(runs, depth): as many runs as the recall needs, with the deepest splitting up to ``depth`` that takes at most MOST_RUNS, or none.

    A pair at the threshold shares the first token of a run, then one of two in every split.
    """
    def needed(levels: int) -> int:
        stays = threshold * (1 - (1 - threshold) ** 2) ** levels
        return 1 if stays >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-stays)))

    levels = next((d for d in range(depth, 0, -1) if needed(d) <= MOST_RUNS), 0)
    return needed(levels), levels


def _paths(sketch: DataFrame, runs: int, bucket: int, depth: int, coordinates: int) -> DataFrame:
    """(node, leaf, n): leaf buckets with n >= 2 nodes; leaf holds the run's number in its upper bits."""
    low = 64 - max(8, runs.bit_length())  # bits of a bucket's name below the run's number

    def word(coordinate):
        return F.substring(F.col("sketch"), coordinate * 4 + 1, 4)

    def named(key, *parts):
        return F.xxhash64(*parts).bitwiseAND(F.lit((1 << low) - 1)).bitwiseOR(F.shiftleft(key, low))

    starts = [F.struct(named(F.lit(r).cast("long"), F.lit(r), word(F.lit(r))).alias("path")) for r in range(runs)]
    level = sketch.select("node", F.explode(F.array(*starts)).alias("p")).select("node", "p.path")
    leaves = None
    for d in range(depth + 1):
        counts = level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        level = materialise(level.join(counts, "path").select("node", "path", "n"), "paths")
        big = level.filter(F.col("n") > bucket)
        if d == depth or not big.limit(1).count():
            leaves = level if leaves is None else leaves.unionByName(level)
            break
        big = materialise(big.join(_dense(big, sketch), "path", "left").withColumn("dense", F.coalesce("dense", F.lit(False))), "paths")
        done = level.filter(F.col("n") <= bucket).unionByName(big.filter("dense").select("node", "path", "n"))
        leaves = done if leaves is None else leaves.unionByName(done)
        big = big.filter("not dense")
        first = F.pmod(F.xxhash64("path", F.lit(d)), F.lit(coordinates)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(-1 - d)), F.lit(coordinates - 1)).cast("int"), F.lit(coordinates)).cast("int")
        run = F.shiftrightunsigned("path", low)
        children = F.array(*[named(run, F.col("path"), c, word(c)) for c in (first, second)])
        level = big.select("node", "path").join(sketch, "node").select("node", F.explode(children).alias("path")).distinct()
    return leaves.select("node", F.col("path").alias("leaf"), "n")


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """members (leaf, n, node, ...) dealt to tiles (leaf, a, b) of at most about two blocks of ``tile`` nodes; own: its block."""
    blocks = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return members.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))}).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "n")


def _earlier(leaf: int, leaves: list[np.ndarray]) -> np.ndarray:
    """By node, a bitmap of its leaves before this one."""
    before = [x[x < leaf] for x in leaves]
    codes = {v: k for k, v in enumerate(sorted({int(v) for x in before for v in x}))}
    words = np.zeros((len(leaves), -(-len(codes) // 8)), dtype=np.uint8)
    for r, x in enumerate(before):
        for v in x:
            k = codes[int(v)]
            words[r, k >> 3] |= 1 << (k & 7)
    return words


def _first_here(earlier: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether no earlier leaf holds both nodes of the pair."""
    parts = [~(earlier[i[low : low + 200_000]] & earlier[j[low : low + 200_000]]).any(axis=1) for low in range(0, len(i), 200_000)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _pairs_of_tile(a: int, b: int, own: np.ndarray, passes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j within a block, or across the two blocks) for which passes(rows, columns) holds."""
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    for low in range(0, len(left), 128):
        rows = left[low : low + 128]
        hit = passes(rows, right)
        if a == b:
            hit &= rows[:, None] < right[None, :]
        i, j = np.nonzero(hit)
        yield rows[i], right[j]


def _candidates(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            leaf, a, b = (t.column(i)[0].as_py() for i in range(3))
            node, own, size = (t.column(n).to_numpy() for n in ("node", "own", "size"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint32).reshape(len(node), -1)[:, :COORDINATES]
            low_bits = np.ascontiguousarray(sketch.astype(np.uint16).T)
            earlier = _earlier(leaf, [np.array(x, dtype=np.int64) for x in t.column("leaves").to_pylist()])

            def passes(rows, columns, size=size, low_bits=low_bits):
                equal = np.zeros((len(rows), len(columns)), dtype=np.uint8)
                for c in range(COORDINATES):
                    equal += low_bits[c][rows][:, None] == low_bits[c][columns][None, :]
                small, large = np.minimum(size[rows][:, None], size[columns]), np.maximum(size[rows][:, None], size[columns])
                return (equal >= (threshold - SLACK) * COORDINATES) & (small >= threshold * large)

            some = np.zeros(len(node), dtype=bool)
            for i, j in _pairs_of_tile(a, b, own, passes):
                first = _first_here(earlier, i, j)
                some[i[first]] = some[j[first]] = True
            k = int(some.sum())
            if k:
                yield pa.RecordBatch.from_arrays([pa.array([leaf] * k), pa.array([a] * k, pa.int32()), pa.array([b] * k, pa.int32()), pa.array(node[some]), pa.array(own[some], pa.int32())], names=["leaf", "a", "b", "node", "own"])

    return run


def _intersections(sets: list[np.ndarray]):
    """passes-style function of the sizes of intersections, by products of incidence matrices over shared tokens."""
    size = np.array([len(s) for s in sets])
    tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    values, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    keep = shared[code]
    row, column = row[keep], new[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))

    def count(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        total = np.zeros((len(rows), len(columns)), dtype=np.float32)
        place = np.full(len(sets), -1)
        other = np.full(len(sets), -1)
        place[rows], other[columns] = np.arange(len(rows)), np.arange(len(columns))
        for k in range(len(cuts) - 1):
            r, c = row[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * width
            x, y = place[r] >= 0, other[r] >= 0
            if not x.any():
                continue
            left, right = np.zeros((len(rows), width), dtype=np.float32), np.zeros((len(columns), width), dtype=np.float32)
            left[place[r[x]], c[x]] = 1
            right[other[r[y]], c[y]] = 1
            total += left @ right.T
        return total

    return size, count


def _verified(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            leaf, a, b = (t.column(i)[0].as_py() for i in range(3))
            node, own, copies = (t.column(n).to_numpy() for n in ("node", "own", "copies"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("data").to_pylist()]
            earlier = _earlier(leaf, [np.array(x, dtype=np.int64) for x in t.column("leaves").to_pylist()])
            size, count = _intersections(sets)

            def passes(rows, columns, size=size, count=count):
                both = count(rows, columns)
                return both >= threshold * (size[rows][:, None] + size[columns] - both) - 1e-6

            links = np.zeros(len(node), dtype=np.int64)
            root = np.arange(len(node))
            for i, j in _pairs_of_tile(a, b, own, passes):
                first = _first_here(earlier, i, j)
                np.add.at(links, i[first], copies[j[first]])
                np.add.at(links, j[first], copies[i[first]])
                while True:  # least label of either end, until no edge disagrees
                    least = np.minimum(root[i], root[j])
                    before = root.copy()
                    np.minimum.at(root, i, least)
                    np.minimum.at(root, j, least)
                    root = root[root]
                    if (before == root).all():
                        break
            while not (root == root[root]).all():
                root = root[root]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root]), pa.array(links)], names=["node", "root", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (node, root): each component's smallest node, by labels and pointer jumping."""
    both = materialise(edges.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("seen"))
        least = materialise(labels.join(near, "node").select("node", "root", F.least("root", "seen").alias("new")), "labels")
        up = least.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = least.join(up, "new", "left").select("node", F.col("root").alias("old"), F.least("new", "up").alias("root"))
        after = materialise(jumped, "labels")
        changed = after.filter("old <> root").limit(1).count()
        discard_frames(labels, least)
        labels = after.select("node", "root")
        if not changed:
            return labels


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.999, bucket: int = 200, depth: int = 4, tile: int = 1000) -> DataFrame:
    """A row per input row: key, node, class_id (the class's smallest key) and links (other documents at the threshold or above)."""
    kind = docs.schema[key].dataType.simpleString()
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError(f"a threshold in (0, 1] and a recall in (0, 1) are needed, not {threshold} and {recall}")
    runs, depth = plan_runs(threshold, recall, depth)
    coordinates = max(COORDINATES, runs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = f"key {kind}, node long, size long, data binary"
    base = materialise(map_arrow(rows, _hasher(coordinates), hashed).withColumnRenamed("data", "sketch"), "sketches")
    nodes = base.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "nodes")
    leaves = _paths(nodes.select("node", "sketch"), runs, bucket, depth, coordinates)
    held = leaves.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    facts = materialise(nodes.join(held, "node"), "leaves")
    tiles = _tiled(leaves.join(facts.select("node", "size", "sketch", "leaves"), "node").select("leaf", "n", "node", "size", "sketch", "leaves"), tile).select("leaf", "a", "b", "node", "own", "size", "sketch", "leaves")
    some = map_arrow(tiles.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b"), _candidates(threshold), "leaf long, a int, b int, node long, own int")
    some = materialise(some, "candidates")
    wanted = some.select("node").distinct()
    # Only rows with the key of a wanted set are hashed again.
    keys = nodes.join(wanted, "node", "left_semi").select("key").distinct()
    sets = map_arrow(rows.join(keys, rows["key"].eqNullSafe(keys["key"]), "left_semi"), _hasher(0), hashed)
    sets = sets.filter("node is not null").join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "data")
    tiled = some.join(sets, "node").join(facts.select("node", "copies", "leaves"), "node").select("leaf", "a", "b", "node", "own", "copies", "leaves", "data")
    found = map_arrow(tiled.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b"), _verified(threshold), "node long, root long, links long")
    found = materialise(found, "links")
    roots = components(found.select("node", "root"))
    counted = found.groupBy("node").agg(F.sum("links").alias("near")).join(roots, "node", "left")
    classes = nodes.select("node", "copies", "key").join(counted, "node", "left").select("node", "copies", "key", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    classes = materialise(classes, "classes")
    names = materialise(classes.groupBy("root").agg(F.min("key").alias("class_id"), F.count("*").alias("n")), "names")
    named = materialise(join_split(classes.drop("key"), names, "root", "n").select("node", "copies", "class_id", "links"), "named")
    placed = join_split(base.filter("node is not null").select("key", "node"), named, "node", "copies").select("key", "node", "class_id", "links")
    alone = base.filter("node is null").select("key", "node", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("links"))
    discard_frames(nodes, facts, some, found, roots, classes, names)
    return placed.unionByName(alone).withColumnRenamed("key", key)
