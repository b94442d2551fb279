"""A content hash by ranges: a tree whose leaves are hashed by tasks, beside the sequential semantic hash.

Rows are ordered by keys and, where these are equal, by their canonical JSON. Equal rows are one entry with a
number. An entry begins a new leaf if the SHA-256 of its row ends in ``leaf`` hexadecimal zeros, and a new node of
level k if it ends in ``fan`` more for every level, so borders depend on rows alone: equal tables have equal trees, however
they are partitioned, and a changed row moves one leaf and the nodes above it. A node's digest is
the SHA-256 of its entries' digests in order. Two trees are compared from the top, and only what
differs is followed down to ranges of keys, which a filter on the keys then reads.

Defined results: null keys come first; an empty table has a tree without nodes and the root None. Rows are compared in
canonical form, so trees agree for tables of equal canonical rows and keys of equal order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import headers
from tallyline.operators.canonical import canonical_columns, kinds, row_json
from tallyline.session import pin, written

#: The declared kind of such a hash in receipts.
KIND = "tree-sha256"
NODE = ["at", "digest", "zeros", "rows", "low", "first", "n"]


def entries(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(low, row, digest, zeros, rows): distinct canonical rows; low: a struct of their keys, of the table's own types."""
    pin(df.sparkSession)
    named = headers.merge(df)
    low = F.struct(*[F.col(f"`{headers.normalise(k)}`").alias(headers.normalise(k)) for k in keys])
    canon = named.select(low.alias("low"), F.struct(*canonical_columns(named)).alias("cells"))
    cells = canon.select("cells.*")  # names and kinds alone
    row = row_json(cells, kinds(named), lambda n: F.col("cells")[n])
    counted = canon.select("low", row.alias("row")).groupBy("low", "row").agg(F.count("*").alias("rows"))
    own = F.sha2("row", 256)
    return counted.withColumns({"digest": F.sha2(F.concat("row", F.lit(" "), F.col("rows").cast("string")), 256), "zeros": F.length(own) - F.length(F.rtrim(own, F.lit("0")))})


def _pieces(digits: int):
    """Runs of entries of one node inside a partition: whole ones are hashed, the first and the last keep their digests' text, as other partitions may hold the rest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seq, held, digests = 0, 0, None, []

        def close(last: bool) -> dict:
            text = "".join(digests)
            whole = not last and held["starts"]
            return held | {"seq": seq, "text": None if whole else text, "digest": hashlib.sha256(text.encode()).hexdigest() if whole else None, "n": len(digests)}

        for batch in batches:
            out = []
            columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names) if n != "low"}
            for i, (part, digest, zeros, rows, first) in enumerate(zip(columns["part"], columns["digest"], columns["zeros"], columns["rows"], columns["first"], strict=True)):
                starts = zeros >= digits
                if held is None or starts:
                    if held is not None:
                        out.append(close(False))
                        seq += 1
                    count += starts
                    held = {"part": part, "local": count, "starts": starts, "zeros": zeros, "rows": 0, "low": batch.column("low")[i], "first": first}
                    digests = []
                held["rows"] += rows
                digests.append(digest)
            if out:
                yield batch_of(out, batch.schema.field("low").type)
        if held is not None:
            yield batch_of([close(True)], held["low"].type)

    def batch_of(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        types = {"part": pa.int32(), "seq": pa.int64(), "local": pa.int64(), "text": pa.string(), "digest": pa.string(), "zeros": pa.int32(), "rows": pa.int64(), "low": kind, "first": pa.int64(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c].as_py() if c == "low" else r[c] for r in rows], t) for c, t in types.items()], names=list(types))

    return run


def _level(given: DataFrame, order: Sequence[Column], digits: int) -> DataFrame:
    """The nodes over entries (low, digest, zeros, rows, first) in that order, numbered from 0 or 1; first and n tell which entries they hold."""
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "digest", F.col("zeros").cast("int").alias("zeros"), "rows", "first", "low")
    schema = f"part int, seq long, local long, text string, digest string, zeros int, rows long, low {given.schema['low'].dataType.simpleString()}, first long, n long"
    pieces = written(ranged.mapInArrow(_pieces(digits), schema), "tree-pieces")
    parts = pieces.groupBy("part").agg(F.max("local").alias("starts"))  # a row a task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("local"))
    place = F.struct("part", "seq")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "text"))), lambda x: x["text"]), "")
    nodes = placed.groupBy("at").agg(texts.alias("text"), F.count("*").alias("pieces"), F.max("digest").alias("whole"), *[F.min_by(c, place).alias(c) for c in ("zeros", "low", "first")], F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    digest = F.when((F.col("pieces") == 1) & F.col("whole").isNotNull(), F.col("whole")).otherwise(F.sha2("text", 256))
    return written(nodes.select("at", digest.alias("digest"), "zeros", "rows", "low", "first", "n"), "tree-level")


def tree(df: DataFrame, keys: Sequence[str], leaf: int = 3, fan: int = 2) -> DataFrame:
    """(level, at, digest, zeros, rows, low, first, n): nodes of all levels, leaves at 0, the root alone at the last one.

    A node's children are the n nodes from ``first`` on, one level below. leaf, fan: hexadecimal digits: 16 ** leaf entries
    a leaf and 16 ** fan nodes a node, on average.
    """
    given = entries(df, keys).withColumn("first", F.lit(None).cast("long"))
    levels = [_level(given, [F.col("low").asc_nulls_first(), F.col("row")], leaf)]
    while levels[-1].limit(2).count() > 1:
        below = levels[-1].withColumn("first", F.col("at"))
        levels.append(_level(below.select("low", "digest", "zeros", "rows", "first", "at"), [F.col("at")], leaf + fan * len(levels)))
    return reduce(DataFrame.unionByName, [nodes.select(F.lit(k).alias("level"), *NODE) for k, nodes in enumerate(levels)])


def root(nodes: DataFrame) -> str | None:
    """The digest of the highest node."""
    top = nodes.orderBy(F.desc("level")).select("digest").first()
    return top and top[0]


def _height(nodes: DataFrame) -> int:
    return nodes.agg(F.max("level")).first()[0] or 0


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, low, high, rows): leaves of either tree that the other lacks; high: where the next leaf begins, null at the end.

    Level by level from the lower tree's top; of each only the children of nodes that differ are read on.
    """
    top = min(_height(a), _height(b))
    sides = [x.filter(F.col("level") == top) for x in (a, b)]
    for level in range(top, -1, -1):
        apart = [written(own.join(other.select("digest"), "digest", "left_anti").select(*own.columns), "tree-apart") for own, other in (sides, sides[::-1])]
        if not level:
            break
        below = [x.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at")) for x in apart]
        sides = [x.filter(F.col("level") == level - 1).join(at, "at", "left_semi") for x, at in zip((a, b), below, strict=True)]
    out = []
    for name, own, nodes in zip("ab", apart, (a, b), strict=True):
        after = nodes.filter("level = 0").select((F.col("at") - 1).alias("at"), F.col("low").alias("high"))
        out.append(own.join(after, "at", "left").select(F.lit(name).alias("side"), "low", "high", "rows"))
    return out[0].unionByName(out[1])


def rows_of(df: DataFrame, key: str, ranges: DataFrame, most: int = 256) -> DataFrame:
    """The table's rows whose key lies in one of the ranges, both ends included: a filter that reaches the scan.

    key: the trees' first key. Beyond ``most`` ranges the driver joins neighbours to that many; rows between them are then read, too.
    """
    name = headers.normalise(key)
    spans = ranges.select(F.col("low")[name].alias("low"), F.col("high")[name].alias("high")).distinct()
    order = Window.orderBy(F.col("low").asc_nulls_first())  # leaves that differ alone
    merged = spans.withColumn("g", F.ntile(most).over(order)).groupBy("g").agg(F.min(F.struct(F.col("low").isNotNull().alias("some"), "low")).alias("low"), F.max(F.struct(F.col("high").isNull().alias("none"), "high")).alias("high")).collect()
    own = F.col(f"`{key}`")
    kept = F.lit(False)
    for r in merged:
        from_ = F.lit(True) if r["low"]["low"] is None else own >= F.lit(r["low"]["low"])
        upto = F.lit(True) if r["high"]["high"] is None else (own <= F.lit(r["high"]["high"])) | (own.isNull() if r["low"]["low"] is None else F.lit(False))
        kept = kept | (from_ & upto)
    return df.filter(kept)
