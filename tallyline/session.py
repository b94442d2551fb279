"""A session with the settings the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The JVM doesn't compile methods of more bytecodes than that; Spark's own bound leaves them to its interpreter, many times slower.
METHOD_LIMIT, SPARKS_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000"), "65535"
PINNED = {METHOD_LIMIT[0]: METHOD_LIMIT[1], "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=PINNED | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Sets what may be set at run time; canonical times need the UTC zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(METHOD_LIMIT[0], SPARKS_LIMIT) == SPARKS_LIMIT:
        spark.conf.set(*METHOD_LIMIT)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of checkpoints; on a local master without one, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("executors share no folder: set spark.checkpoint.dir to one that all of them can reach")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tallyline_work"
    return folder.rstrip("/")


_left: dict[str, SparkSession] = {}


def _tidy() -> None:
    """Deletes what this driver left in the shared folder: frames that read it end with the driver."""
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, safe from lost executors."""
    if not _left:
        atexit.register(_tidy)
    path = f"{shared_folder(df.sparkSession)}/tallyline-{name}-{uuid.uuid4().hex}"
    _left[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote for the frame; nothing may read it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
