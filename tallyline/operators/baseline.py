"""Baselines kept as a state that each run is folded into, so that a judgment reads a row a metric and not every archived run.

A state has a row for each (bucket, metric) and one for each bucket (metric null): the first and the last clean
observation, the first one after the settling deadline, and the last run that has the metric at all. An
observation is clean unless it was flagged. Of runs created at the same time the one with the smaller name is
the later. judged() gives what judge.breaches() gives over all the runs that were folded in.

Defined results: null counts that a bucket's run doesn't name are 0, also in runs before the metric first appeared; other absent metrics aren't observed.
Runs may be folded in any order, each once.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import judge

SEEN = f"struct<created:timestamp,run:string,value:{judge.VALUE}>"
STATE = f"bucket string, metric string, first {SEEN}, last {SEEN}, settled {SEEN}, held {SEEN}"
PARTS = ("first", "last", "settled", "held")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _later(a: Column, b: Column) -> Column:
    """Whether observation a counts as later than b."""
    return (a["created"] > b["created"]) | ((a["created"] == b["created"]) & (a["run"] < b["run"]))


def _pick(a: Column, b: Column, latest: bool) -> Column:
    chosen = F.when(_later(a, b) if latest else _later(b, a), a).otherwise(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(chosen)


def _counts_nulls(metric: Column) -> Column:
    return metric.startswith("null_counts[")


def fold(state: DataFrame, observed: DataFrame, flagged: DataFrame, run: str, created: dt.datetime, settle_hours: int) -> DataFrame:
    """The state with one more run: observed (bucket, metric, value), flagged (bucket, metric). Joins of the state with a run, keyed by bucket and metric."""
    buckets = observed.select("bucket").distinct()
    whole = state.filter("metric is null").select("bucket", F.struct(*PARTS).alias("whole"))
    known = state.filter("metric is not null").select("bucket", "metric", F.struct(*PARTS).alias("own"))
    seen = observed.select("bucket", "metric", F.col("value").cast(judge.VALUE).alias("value"))
    keyed = known.join(seen, ["bucket", "metric"], "full_outer").join(buckets.withColumn("here", F.lit(True)), "bucket", "left").join(whole, "bucket", "left")
    keyed = keyed.join(flagged.select("bucket", "metric").distinct().withColumn("flag", F.lit(True)), ["bucket", "metric"], "left")
    value = F.coalesce("value", F.when(_counts_nulls(F.col("metric")), F.lit(0))).cast(judge.VALUE)
    zero = lambda part: F.when(F.col("whole")[part].isNotNull(), F.struct(F.col("whole")[part]["created"].alias("created"), F.col("whole")[part]["run"].alias("run"), F.lit(0).cast(judge.VALUE).alias("value")))
    before = {p: F.when(F.col("own").isNotNull(), F.col("own")[p]).when(_counts_nulls(F.col("metric")) & F.lit(p != "held"), zero(p)) for p in PARTS}
    metrics = _merged(keyed, before, value, F.col("here") & F.col("flag").isNull() & value.isNotNull(), F.col("here") & F.col("value").isNotNull(), run, created, settle_hours)
    both = whole.join(buckets.withColumn("here", F.lit(True)), "bucket", "full_outer").withColumn("metric", F.lit(None).cast("string"))
    totals = _merged(both, {p: F.col("whole")[p] for p in PARTS}, F.lit(0).cast(judge.VALUE), F.col("here"), F.col("here"), run, created, settle_hours)
    return metrics.unionByName(totals)


def _merged(rows: DataFrame, before: dict[str, Column], value: Column, clean: Column, held: Column, run: str, created: dt.datetime, settle_hours: int) -> DataFrame:
    at = F.lit(created).cast("timestamp")
    own = F.struct(at.alias("created"), F.lit(run).alias("run"), value.alias("value"))
    new = {"first": clean, "last": clean, "settled": clean & (at > judge.deadline(F.col("bucket"), settle_hours)), "held": held}
    merged = {p: _pick(F.when(F.coalesce(new[p], F.lit(False)), own), before[p], p in ("last", "held")).alias(p) for p in PARTS}
    return rows.select("bucket", "metric", *merged.values())


def judged(state: DataFrame, current: DataFrame, band: Decimal, settle_hours: int, created: dt.datetime, now: dt.datetime | None = None) -> DataFrame:
    """The breaches of the current run (bucket, metric, value) against the state, in the columns of judge.BREACHES."""
    whole = state.filter("metric is null").select("bucket", F.struct(*PARTS).alias("whole"), F.col("last.created").alias("latest"), F.col("last.run").alias("latest_run"))
    present = current.select("bucket").distinct().join(whole, "bucket")
    known = state.filter("metric is not null").select("bucket", "metric", F.struct(*PARTS).alias("own"))
    keyed = known.join(current.select("bucket", "metric", "value"), ["bucket", "metric"], "full_outer").join(present, "bucket")
    # The current and the latest run name a bucket's metrics.
    keyed = keyed.filter(F.col("value").isNotNull() | ((F.col("own.held.run") == F.col("latest_run")) & (F.col("own.held.created") == F.col("latest"))))
    default = F.when(_counts_nulls(F.col("metric")), F.lit(0))
    base = lambda p, c: F.when(F.col("own").isNotNull(), F.col("own")[p][c]).when(_counts_nulls(F.col("metric")), F.lit(0).cast(judge.VALUE) if c == "value" else F.col("whole")[p][c])
    some = lambda p: F.when(base(p, "created").isNotNull(), base(p, "value"))
    bases = keyed.select("bucket", "metric", F.coalesce("value", default).cast(judge.VALUE).alias("after"), "latest", judge.deadline(F.col("bucket"), settle_hours).alias("deadline"), some("last").alias("last"), some("first").alias("first"), base("first", "created").alias("first_created"), some("settled").alias("settled"))
    return judge.decide(bases.filter("after is not null and first_created is not null"), band, settle_hours, created, now)
