"""What the operators share: slices of texts, stable samples, shared folders."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranges(texts, max_bytes: int = 16_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow string array that hold about max_bytes each; a longer text has a range of its own."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield low, high
        low = high


#: Bytes of an Arrow batch on its way to Python; Spark's own bound (64 MB) takes several times that in both processes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARKS_BOUND, OWN_BOUND = "67108864b", "4m"


def map_arrow(df: DataFrame, run: Callable[[Iterable], Iterator], schema: Any) -> DataFrame:
    """df.mapInArrow(run, schema) on batches of about 4 MB, unless the session sets a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == SPARKS_BOUND:
        conf.set(BATCH_BYTES, OWN_BOUND)
    return df.mapInArrow(run, schema)


_made: dict[str, tuple[Any, Any]] = {}


def per_worker(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by a Python worker from task to task; of each kind the last one."""
    if kind not in _made or _made[kind][0] != key:
        _made.pop(kind, None)
        _made[kind] = key, make()
    return _made[kind][1]


def task_threads() -> int:
    """CPUs of the running task: native libraries may use as many threads."""
    context = TaskContext.get()
    threads = context.cpus() if context else os.cpu_count() or 1
    if context:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # read by the tokenizers library when it first encodes
    return threads


def _give_back() -> None:
    """Returns freed memory to the system, where the allocators can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def without_gc() -> Iterator[None]:
    """Spares walks over many small objects; what a task left in cycles is freed at its end, as workers are reused."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        _give_back()


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % n


def unit_hash(*keys: str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(1 << 30)) / float(1 << 30)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master where none is set, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("executors share no folder: set spark.checkpoint.dir to one that all of them can reach")
        folder = jdir.get() if jdir.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tallyline_work"
    return folder.rstrip("/")


_work: dict[str, SparkSession] = {}


def _tidy() -> None:
    """Deletes what this driver left in the shared folder: results that depend on it end with the driver."""
    for path, spark in list(_work.items()):
        with contextlib.suppress(Exception):  # the session may be gone already
            discard(spark, path)


def work_path(spark: SparkSession, name: str) -> str:
    if not _work:
        atexit.register(_tidy)
    path = f"{shared_folder(spark)}/tallyline-{name}-{uuid.uuid4().hex}"
    _work[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes work folders through Hadoop's file system, wherever they are."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        _work.pop(path, None)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard_frames(*frames: DataFrame) -> None:
    """Deletes the folders that materialised frames were read from; nothing may depend on them any more."""
    for df in frames:
        discard(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


def join_split(rows: DataFrame, facts: DataFrame, on: str | list[str], weight: str, share: int = 1000) -> DataFrame:
    """rows joined (left) with facts, which has one row for each value of ``on`` and in ``weight`` how many rows have it.

    Values that more than one row in ``share`` has are fewer than ``share``: their facts are broadcast, so
    their rows stay where they are; all other rows are shuffled. facts must be cheap to read twice.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share > total
    often, rest = F.broadcast(facts.filter(hot)), facts.filter(~hot)
    return rows.join(often, on).unionByName(rows.join(often.select(on), on, "left_anti").join(rest, on, "left"))


def numbered(rows: DataFrame, group: str, order: Sequence[Column], most: int = 10_000) -> DataFrame:
    """Adds ``position``, the row's number in its group, from 0, in that order.

    Groups of more than ``most`` rows are sorted over many tasks: by ranges of (group, order), so a row's number is its
    place in its range plus the group's rows of earlier ranges.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(group)
    large = materialise(sizes, "large-groups")  # fewer rows than the input has, divided by most
    within = Window.partitionBy(group).orderBy(*order)
    small = rows.join(large, group, "left_anti").withColumn("position", F.row_number().over(within).cast("long") - 1)
    if not large.limit(1).count():
        return small
    by = [F.col(group), *order, F.col("tie")]
    ranged = rows.join(large, group, "left_semi").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = materialise(ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "large-rows")
    parts = ranged.groupBy(group, "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))  # a row a range and a group in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("before", before).drop("n")
    placed = ranged.join(starts, [group, "part"]).withColumn("position", F.col("before") + F.col("seq") - F.col("first"))
    return small.unionByName(placed.select(*small.columns))


def free_name(taken: Sequence[str], wanted: str) -> str:
    """wanted, or wanted with underscores until no column of the input has that name (case-insensitively)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def word_ids(texts, pattern, ascii_only: bool = False) -> tuple:
    """Words of lower-cased texts: (id of each word of all texts, words of each text, distinct words). ascii_only: A to Z alone are lowered.

    texts: an Arrow string array without nulls. Texts are cut at blanks and line ends
    inside Arrow; the pattern then sees each distinct chunk once.
    """
    import numpy as np
    import pyarrow.compute as pc

    lower = pc.ascii_lower(texts) if ascii_only else pc.utf8_lower(texts)
    lists = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
    chunks = lists.flatten().dictionary_encode()
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    at: dict[str, int] = {}
    found = [[at.setdefault(w, len(at)) for w in pattern.findall(c)] for c in chunks.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(sizes.sum()))
    ids, lengths = gather(flat, np.cumsum(sizes) - sizes, sizes, chunks.indices.to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(per_text)]
    return ids, np.diff(ends, prepend=0), list(at)


def gather(flat, starts, sizes, index) -> tuple:
    """The slices flat[starts[i] : starts[i] + sizes[i]] for i of index, one after another, and their sizes."""
    import numpy as np

    own = sizes[index]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if len(flat) < 1 << 31 and total < 1 << 31 else np.int64  # half the memory where it does
    at = np.repeat((starts[index] - ends + own).astype(kind), own)
    at += np.arange(total, dtype=kind)
    return flat[at], own


def arrow_texts(column):
    """A string column without its nulls (empty instead), as one array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.string()), "")
