"""A trie of conversations by preorder intervals.

A node is a distinct sequence of the first d turns of conversations. Its identity is its depth and two
64-bit values, the exclusive or of hashes of (depth, role, text) along the sequence, so a turn's row has its
node by a running aggregate and its parent by taking its own hash out again. Every node is owned by its
smallest conversation.

A node begins a segment if its parent has other children too; the nodes below it belong to its segment up to
the next branching. The beginnings on a path are a segment's key. Sorting the distinct keys ranks the
segments so that a segment comes before all below it, and (rank, depth) orders the nodes as a walk in preorder
does, each node's subtree an interval. The interval ends with the last segment whose key holds the
node's own. Running sums in that order, over ranges of it first and then over the ranges' totals,
give leaves and savings of every subtree as the difference of two of them.

A key is as long as its path has branchings, each of which takes another conversation at least as long, so all keys
together are no longer than the input. Long conversations are numbered and summed in blocks of
turns; facts of conversations, nodes and segments with many rows are broadcast to them and not shuffled, few as they are.

Defined results: null roles and texts are empty. Turns are ordered by turn, null first, then role, then text; repeated rows
are turns of their own. Rows without a conversation are left out. Without conversations there is no node,
not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import join_split, map_arrow, materialise, numbered

#: Turns of a conversation that one window takes.
BLOCK = 4096
ID = ["depth", "x1", "x2"]
WORDS = r"[^\x20\x09-\x0D]+"


def read(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, position, role, text): turns numbered from 0 in every conversation."""
    raw = messages.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    return numbered(raw, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select("conv", "position", "role", "text")


def regrouped(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv, length) in which a conversation begins as the first of its family does.

    Conversation c begins with the first h turns of c - c % family, h being crc32 of c as text modulo ``most``, and
    goes on with its own turns after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % family
    own = materialise(turns.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = own.withColumns({"h": h, "base": base}).join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = materialise(known.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "heads")
    starts = turns.filter(F.col("position") < most - 1).withColumnRenamed("conv", "base")  # up to that many of each conversation
    heads = known.filter("head > 0").select("conv", "base", "h", "length").join(starts, "base").filter("position < h").select("conv", (F.col("position") + 1).alias("depth"), "role", "text", "length")
    tails = join_split(turns, known.select("conv", "h", "head", "length", "n"), "conv", "n").filter("position >= h")
    tails = tails.select("conv", (F.col("position") + 1 - F.col("h") + F.col("head")).alias("depth"), "role", "text", "length")
    return heads.unionByName(tails), known.select("conv", "length")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as they are."""
    convs = materialise(turns.groupBy("conv").agg(F.count("*").alias("length")), "conversations")
    rows = join_split(turns, convs, "conv", "length")
    return rows.select("conv", (F.col("position") + 1).alias("depth"), "role", "text", "length"), convs


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, z1, z2, words, last): a row for every turn and for the root of every conversation."""
    digest = F.md5(F.concat_ws(":", F.col("depth"), F.length("role"), F.col("role"), F.col("text")).cast("binary"))
    hashed = turns.select("conv", "depth", digest.alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), (F.col("depth") == F.col("length")).alias("last"))
    hashed = hashed.select("conv", "depth", F.xxhash64("digest", F.lit(1)).alias("z1"), F.xxhash64("digest", F.lit(2)).alias("z2"), "words", "last", F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    hashed = materialise(hashed, "turn-hashes")
    running = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hashed.withColumns({"x1": F.bit_xor("z1").over(running), "x2": F.bit_xor("z2").over(running)})
    if hashed.filter("block > 0").limit(1).count():
        totals = hashed.groupBy("conv", "block").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"), F.count("*").alias("n"))
        before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        offsets = totals.select("conv", "block", F.bit_xor("t1").over(before).alias("o1"), F.bit_xor("t2").over(before).alias("o2")).filter("block > 0")
        rows = rows.join(offsets, ["conv", "block"], "left").withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in (1, 2)})
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", *[zero.alias(c) for c in (*ID, "z1", "z2", "words")], (F.col("length") == 0).alias("last"))
    return materialise(rows.select("conv", *ID, "z1", "z2", "words", "last").unionByName(roots), "prefixes")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """A row per node: owner, members, children, parent's owner, and whether it begins a segment."""
    nodes = materialise(prefixes.groupBy(*ID).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), *[F.any_value(c).alias(c) for c in ("z1", "z2", "words")]), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("x1").bitwiseXOR(F.col("z1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("z2")).alias("x2")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*ID).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, ID, "left").fillna(0, ["n_children"]), "families")
    above = ["p0", "p1", "p2"]
    parents = nodes.filter("n_children > 0").select(*[F.col(a).alias(b) for a, b in zip(ID, above, strict=True)], F.col("owner").alias("parent_owner"), F.col("n_children").alias("siblings"))
    below = nodes.filter("depth > 0").select("*", *[c.alias(a) for c, a in zip(parent, above, strict=True)])
    known = join_split(below, parents, above, "siblings").withColumn("begins", F.col("siblings") > 1)
    root = nodes.filter("depth = 0").withColumns({"parent_owner": F.lit(None).cast("long"), "begins": F.lit(True)})
    columns = [*ID, "owner", "parent_owner", "n_convs", "n_children", "words", "begins"]
    return materialise(known.select(*columns).unionByName(root.select(*columns)), "nodes")


def running_sums(rows: DataFrame, order: Sequence[Column | str], sums: Sequence[str]) -> DataFrame:
    """Adds run_<column>: the sum of the column, no value below 0, over all rows up to this one in that order.

    Rows are sorted over ranges; a task sums its range, and the ranges' totals, a row for each task, are summed once more.
    """
    names = [f"run_{c}" for c in sums]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    at = [ranged.columns.index(c) for c in sums]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = [0] * len(at)
        for batch in batches:
            if batch.num_rows:
                found = [np.cumsum(batch.column(k).to_numpy(zero_copy_only=False)) + d for k, d in zip(at, done, strict=True)]
                done = [int(x[-1]) for x in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, *names])

    schema = ranged.select("*", *[F.lit(0).cast("long").alias(n) for n in names]).schema
    own = materialise(map_arrow(ranged, run, schema), "ranges")
    parts = own.groupBy("part").agg(*[F.max(n).alias(f"total_{n}") for n in names])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", *[F.coalesce(F.sum(f"total_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in names])
    return own.join(F.broadcast(offsets), "part").withColumns({n: F.col(n) + F.col(f"before_{n}") for n in names}).drop("part", *[f"before_{n}" for n in names])


def _segments(prefixes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their segment's beginning (s0, s1, s2), and the segments: beginning, rank, last (rank of the last one below)."""
    begins = nodes.filter("begins").select(*ID, "owner", "n_convs")
    marked = join_split(prefixes.select("conv", *ID), begins, ID, "n_convs").filter("owner is not null")
    paths = materialise(marked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*ID, "owner"))).alias("path")), "paths")
    own = F.filter(F.transform("path", lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: x["e"]["owner"] == F.col("conv"))
    keyed = paths.select("path", F.explode(own).alias("x")).select(F.transform(F.slice("path", 1, F.col("x.i") + 1), lambda e: F.struct(*[e[c].alias(c) for c in ID])).alias("key"), F.lit(1).cast("long").alias("one"))
    ranked = materialise(running_sums(keyed, ["key"], ["one"]).select("key", F.col("run_one").alias("rank")), "segments")
    last = ranked.select(F.explode("key").alias("s"), "rank").groupBy("s").agg(F.max("rank").alias("last"))
    ends = ranked.select(F.element_at("key", -1).alias("s"), "rank").join(last, "s").select(*[F.col(f"s.{c}").alias(f"s{i}") for i, c in enumerate(ID)], "rank", "last")
    owned = nodes.groupBy("owner").agg(F.count("*").alias("owned")).join(paths.withColumnRenamed("conv", "owner"), "owner")
    placed = join_split(nodes, materialise(owned, "owners"), "owner", "owned")
    segment = F.element_at(F.filter("path", lambda e: e["depth"] <= F.col("depth")), -1)
    placed = placed.withColumn("s", segment).select(*nodes.columns, *[F.col(f"s.{c}").alias(f"s{i}") for i, c in enumerate(ID)])
    return materialise(placed, "placed"), ends


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends): SHA-256 of the comma-joined conversations that end with a node, ascending.

    Tasks join ranges of (node, conversation) to texts of up to 65,536 numbers; these, in order, pass through one hash a node.
    """
    order = [*ID, "conv"]
    rows = prefixes.filter("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            new = np.flatnonzero(np.any([np.diff(x) != 0 for x in ids], axis=0)) + 1
            starts = np.union1d(np.concatenate([[0], new]), np.arange(0, batch.num_rows, 65_536)).astype(int)
            texts = pc.cast(batch.column(3), pa.string()).to_pylist()
            joined = [",".join(texts[a:b]) for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(starts)) for k in range(4)], pa.array(joined)], names=[*order, "text"])

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *own, text in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)], strict=True):
                if own == node:
                    digest.update(b",")
                else:
                    out += [(*node, digest.hexdigest())] if node else []
                    node, digest = own, hashlib.sha256()
                digest.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*ID, "ends"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=[*ID, "ends"])

    joined = map_arrow(rows, pieces, "depth long, x1 long, x2 long, conv long, text string")
    return map_arrow(joined.repartition(*ID).sortWithinPartitions(*order), hashes, "depth long, x1 long, x2 long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of conversations given as regrouped() or plain() return them.

    owner (smallest member), depth, parent_owner, n_convs, n_children, preorder (from 0), subtree_end (preorder of
    the last node below), n_leaves, saved (tokens that members share, over the subtree), ends.
    """
    prefixes = _prefixes(turns, convs)
    placed, segments = _segments(prefixes, _nodes(prefixes))
    on = ["s0", "s1", "s2"]
    sizes = placed.groupBy(*on).agg(F.count("*").alias("size"))
    segments = materialise(segments.join(sizes, on), "segments")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    ranked = join_split(placed, segments.drop("last"), on, "size").select(*ID, "owner", "parent_owner", "n_convs", "n_children", "rank", leaf.alias("leaf"), saved.alias("saved"), F.lit(1).cast("long").alias("one"))
    summed = materialise(running_sums(ranked, ["rank", "depth"], ["one", "leaf", "saved"]), "preorder")
    upto = summed.groupBy("rank").agg(*[F.max(f"run_{c}").alias(f"end_{c}") for c in ("one", "leaf", "saved")])
    ends = materialise(segments.select("rank", "last", "size").join(upto.withColumnRenamed("rank", "last"), "last").drop("last"), "subtrees")
    below = join_split(summed, ends, "rank", "size")
    empty = F.lit(hashlib.sha256().hexdigest())
    return below.join(_ends(prefixes), ID, "left").select(
        "owner", "depth", "parent_owner", "n_convs", "n_children", (F.col("run_one") - 1).alias("preorder"), (F.col("end_one") - 1).alias("subtree_end"),
        *[(F.col(f"end_{c}") - F.col(f"run_{c}") + F.col(c)).alias(a) for c, a in (("leaf", "n_leaves"), ("saved", "saved_tokens"))], F.coalesce("ends", empty).alias("ends_sha256"),
    )
