"""Canonical tables and their hashes."""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import cells, headers
from tallyline.session import discard, pin, written


def python_paths(df: DataFrame) -> tuple[set[str], set[str]]:
    """Text columns with cells that need the exact slow path for numbers, and those that need NFC; one aggregate, all in the JVM."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return set(), set()
    # Each cell is stripped once; one that is ASCII within white space needs no NFC.
    bare = df.select(*[cells.strip(F.col(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(text)])
    flags = [x for i in range(len(text)) for x in (F.bool_or(cells.needs_python(F.col(f"t{i}"), True)).alias(f"s{i}"), F.bool_or(cells.needs_nfc(F.col(f"t{i}"))).alias(f"n{i}"))]
    row = bare.agg(*flags).first()
    return {c for i, c in enumerate(text) if row[f"s{i}"]}, {c for i, c in enumerate(text) if row[f"n{i}"]}


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def canonical_cells(df: DataFrame) -> DataFrame:
    """The table with normalised names in code-point order, every cell in canonical text (booleans stay booleans)."""
    pin(df.sparkSession)
    df = headers.merge(df)
    slow, nfc = python_paths(df)
    # A projection strips text, the next one reads it, so that a cell is stripped once.
    bare = {n for n, kind in kinds(df).items() if isinstance(kind, T.StringType)} - slow - nfc
    first = df.select(*[(cells.strip(F.col(f"`{n}`")) if n in bare else F.col(f"`{n}`")).alias(n) for n in df.columns])
    return first.select(*_columns(first, slow, nfc, bare))


def canonical_columns(df: DataFrame) -> list[Column]:
    """The columns of canonical_cells() over a table with normalised names."""
    return _columns(df, *python_paths(df), set())


def _columns(df: DataFrame, slow: set[str], nfc: set[str], bare: set[str]) -> list[Column]:
    """bare: text columns that are stripped already and need no Python path."""
    out = []
    for name, kind in sorted(kinds(df).items()):
        col = F.col(f"`{name}`")
        cell = cells.canonical_text(col) if name in bare else col if isinstance(kind, T.BooleanType) else cells.canonical(col, kind, name in slow, name in nfc)
        out.append(cell.alias(name))
    return out


def row_json(canon: DataFrame, source: dict[str, T.DataType] | None = None, cell: Callable[[str], Column] | None = None) -> Column:
    """A canonical row as a JSON array; source: the kinds that the columns had, as numbers and times need no escapes; cell: where a column's cell is, if not under its name."""
    held = kinds(canon)
    at = cell or (lambda n: F.col(f"`{n}`"))
    parts = [cells.json_leaf(at(n).cast("string"), (source or held).get(n, k)) for n, k in held.items()]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")) if parts else F.lit("[]")


def ordered(canon: DataFrame) -> DataFrame:
    """Rows in canonical order: nulls first, then code points, column by column."""
    return canon.orderBy(*[F.col(f"`{n}`").asc_nulls_first() for n in canon.columns])


def _pack(limit: int):
    """Rows joined by commas inside Arrow, a cell for each batch or for about ``limit`` bytes of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, side="right")))
                rows = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), texts.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([pc.binary_join(rows, ",").cast(pa.binary())], names=["part"])
                low = high

    return run


#: Rows are sorted and packed to cells of about so many bytes.
CELL_BYTES = 1_000_000


@contextlib.contextmanager
def _cells(df: DataFrame, cell_bytes: int) -> Iterator[tuple[bytes, DataFrame]]:
    """The canonical document's head, and its rows as cells (range, place, part), by which they are in order; all tasks sort and pack."""
    canon = canonical_cells(df)
    names = json.dumps(canon.columns, ensure_ascii=False, separators=(",", ":")).encode()
    at = [f"c{i}" for i in range(len(canon.columns))]
    # Written once: a sort by ranges reads its input twice, to sample it and to sort it.
    made = written(canon.toDF(*at).withColumn("row", row_json(canon, kinds(headers.merge(df)), lambda n: F.col(at[canon.columns.index(n)]))), "canonical-rows")
    try:
        order = [F.col(c).asc_nulls_first() for c in at]
        # With their number given, partitions stay as many, so that a sorted one is never more than its share.
        sorted_ = made.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order) if order else made
        packed = sorted_.select("row").mapInArrow(_pack(cell_bytes), "part binary")
        number = F.monotonically_increasing_id()  # partition and place in it
        yield b'{"headers":' + names + b',"rows":[', packed.select(F.shiftright(number, 33).cast("int").alias("range"), number.bitwiseAND((1 << 33) - 1).alias("place"), "part")
    finally:
        discard(made)


def document_parts(df: DataFrame, cell_bytes: int = 16_000_000) -> Iterator[bytes]:
    """The canonical document's bytes in order, for files that the driver writes. Cells are kept on executors' disks; the driver holds one partition's."""
    with _cells(df, cell_bytes) as (head, found):
        yield head
        packed = found.select("part").persist(StorageLevel.DISK_ONLY)
        try:
            packed.count()
            first = True
            for row in packed.toLocalIterator(prefetchPartitions=True):
                yield (b"" if first else b",") + bytes(row[0])
                first = False
        finally:
            packed.unpersist()
        yield b"]}"


def _digest(head: bytes):
    """SHA-256 of a document's head, its parts as they come, and its end, in hexadecimal."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, between = hashlib.sha256(head), b""
        for batch in batches:
            for part in batch.column(batch.schema.get_field_index("part")):
                found.update(between)
                found.update(part.as_buffer())
                between = b","
        if between:
            found.update(b"]}")
            yield pa.RecordBatch.from_arrays([pa.array([found.hexdigest()])], names=["digest"])

    return run


def semantic_hash(df: DataFrame) -> str:
    """SHA-256 of the canonical document: equal for equal tables in any format and row order.

    SHA-256 takes its bytes one after another. A task takes the sorted cells, as a stream that it doesn't hold, and the driver gets the digest alone.
    """
    with _cells(df, CELL_BYTES) as (head, found):
        row = found.repartition(1).sortWithinPartitions("range", "place").mapInArrow(_digest(head), "digest string").first()
    return row[0] if row else hashlib.sha256(head + b"]}").hexdigest()


def semantic_hash_row(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The hash as a one-row DataFrame, for small tables: the whole document is one value of one task. More than ``most_rows`` rows raise an error."""
    canon = canonical_cells(df).limit(most_rows + 1)
    key = F.struct(*[F.coalesce(F.concat(F.lit("1"), F.col(f"`{n}`").cast("string")), F.lit("0")) for n in canon.columns])
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), row_json(canon).alias("r")))), lambda x: x["r"]), ",")
    names = json.dumps(canon.columns, ensure_ascii=False, separators=(",", ":"))
    document = F.sha2(F.concat(F.lit(f'{{"headers":{names},"rows":['), rows, F.lit("]}")), 256)
    small = F.count(F.lit(1)) <= most_rows
    return canon.agg(F.when(small, document).otherwise(F.raise_error(F.lit(f"more than {most_rows} rows: use semantic_hash or a content tree"))).alias("semantic_hash"))


def row_fingerprint(df: DataFrame) -> DataFrame:
    """An order-free fingerprint in one pass: row count and two sums of row-hash parts. Beside the semantic hash, never instead of it."""
    canon = canonical_cells(df)
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    parts = canon.select(F.sha2(row_json(canon, kinds(headers.merge(df))), 256).alias("digest")).select(half(1).alias("a"), half(16).alias("b"))
    low = (1 << 30) - 1  # halves of 60 bits add up in longs, whatever the number of rows below 2 ** 33

    def total(name: str) -> Column:
        high = F.sum(F.shiftright(name, 30)).cast("decimal(38,0)")
        return F.coalesce(high * F.lit(1 << 30).cast("decimal(12,0)") + F.sum(F.col(name).bitwiseAND(low)), F.lit(None)).cast("decimal(38,0)").cast("string")

    return parts.agg(F.count("*").alias("row_count"), total("a").alias("sum_a"), total("b").alias("sum_b"))


def evidence_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, byte_size, evidence_hash) of files as they are."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("evidence_hash"))


def union_ragged(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames under normalised names, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(headers.merge, frames))
