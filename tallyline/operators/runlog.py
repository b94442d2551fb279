"""Run history as relations: diffs, trends, new periods, moved buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import cells


def stage_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stages (position, name, row_count, code_hash) of two runs side by side; of repeated names the first counts."""

    def first(df: DataFrame, side: str) -> DataFrame:
        kept = df.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("position"))).filter("n = 1")
        return kept.select("name", *[F.col(c).alias(f"{c}_{side}") for c in ("position", "row_count", "code_hash")])

    joined = first(a, "a").join(first(b, "b"), "name", "full_outer")
    presence = F.when(F.col("position_b").isNull(), "removed").when(F.col("position_a").isNull(), "added").otherwise("both")
    order = Window.orderBy(F.col("position_a").asc_nulls_last(), F.col("position_b").asc_nulls_last())  # a run's few stages
    return joined.select(F.row_number().over(order).alias("at"), "name", presence.alias("presence"), "row_count_a", "row_count_b", (F.col("row_count_b") - F.col("row_count_a")).alias("row_delta"), (~F.col("code_hash_a").eqNullSafe(F.col("code_hash_b"))).alias("code_changed"))


def log(runs: DataFrame, granularity: str) -> DataFrame:
    """Runs (body_hash, created, value) collapsed to periods: the last run counts, with the number of runs and the change since the last period with a value."""
    keyed = runs.withColumn("period", cells.period_key(F.col("created"), granularity))
    last = keyed.groupBy("period").agg(F.max_by("value", F.struct("created", "body_hash")).alias("value"), F.count("*").alias("runs"))
    # One row a period of history: few enough for a single ordered window.
    earlier = F.last("value", ignorenulls=True).over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1))
    return last.select("period", "runs", "value", (F.col("value") - earlier).alias("delta"))


def latest(runs: DataFrame) -> DataFrame:
    """The newest run; of equal times that with the larger hash."""
    return runs.orderBy(F.desc("created"), F.desc("body_hash")).limit(1)


def new_periods(current: DataFrame, committed: DataFrame) -> DataFrame:
    """Buckets of the current data that were not committed before."""
    return current.select("period").distinct().join(committed.select("period").distinct(), "period", "left_anti")


def moved_periods(before: DataFrame, after: DataFrame, value: str = "row_count") -> DataFrame:
    """Periods whose value differs or exists on one side alone."""
    joined = before.select("period", F.col(value).alias("before")).join(after.select("period", F.col(value).alias("after")), "period", "full_outer")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))
