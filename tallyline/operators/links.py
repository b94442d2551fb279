"""Chains of stages as relations: links, gaps, drift, file hashes. All windows run over one chain's few receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Receipts: chain, position, name, input_hash, output_hash, row_count.
def _order():
    return Window.partitionBy("chain").orderBy("position")


def link_check(receipts: DataFrame) -> DataFrame:
    """Every link with what it should and does refer to, and whether it is the chain's first broken one."""
    seen = receipts.withColumn("expected", F.lag("output_hash").over(_order())).filter("position > 0")
    broken = seen.withColumn("broken", ~F.col("expected").eqNullSafe(F.col("input_hash")))
    first = F.min(F.when(F.col("broken"), F.col("position"))).over(Window.partitionBy("chain"))
    return broken.withColumn("first_broken", F.coalesce(first == F.col("position"), F.lit(False))).select("chain", "position", "name", "expected", F.col("input_hash").alias("found"), "broken", "first_broken")


def coverage_gaps(receipts: DataFrame) -> DataFrame:
    """Jumps in the three-digit numbers of receipt names; a chain with any other name is not checked."""
    prefix = F.substring_index("name", "_", 1)
    number = F.when(prefix.rlike("^[0-9]{3}$"), prefix.cast("int"))
    placed = receipts.withColumn("number", number).withColumn("all", F.count("number").over(Window.partitionBy("chain")) == F.count("*").over(Window.partitionBy("chain")))
    before = placed.filter("all").withColumn("previous", F.lag("number").over(_order()))
    start = F.when((F.col("position") == 0) & (F.col("number") != 0), F.format_string("chain starts at %03d, not 000", "number"))
    jump = F.when(F.col("number") != F.col("previous") + 1, F.format_string("numbering jumps %03d -> %03d", "previous", "number"))
    return before.select("chain", "position", F.coalesce(start, jump).alias("gap")).filter("gap is not null")


def row_deltas(receipts: DataFrame) -> DataFrame:
    """Each stage's rows against the last stage before it that had a row count."""
    earlier = F.last("row_count", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return receipts.select("chain", "position", "name", "row_count", (F.col("row_count") - earlier).alias("row_delta"))


def file_mismatches(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Names in the chain whose recorded file hash differs from the actual one, or that have no file."""
    joined = recorded.alias("r").join(actual.alias("a"), ["chain", "name"], "left")
    return joined.filter(~F.col("r.hash").eqNullSafe(F.col("a.hash"))).select("chain", "name", F.col("r.hash").alias("recorded"), F.col("a.hash").alias("actual"))


def totals_drift(totals: DataFrame) -> DataFrame:
    """(chain, position) of the links over which a count, sum or null count moves; totals: chain, position, section, name, value."""
    stages = totals.select("chain", "position").distinct()
    kept = totals.filter(F.col("section").isin("row_count", "column_count", "numeric_sums", "null_counts"))
    keys = ["chain", "position", "section", "name"]
    below = kept.select(*keys, F.col("value").alias("after"))
    above = kept.select("chain", (F.col("position") + 1).alias("position"), "section", "name", F.col("value").alias("before")).join(stages, ["chain", "position"], "left_semi")
    none = F.when(F.col("section") == "null_counts", F.lit("0"))
    moved = below.filter("position > 0").join(above, keys, "full_outer").filter(~F.coalesce("before", none).eqNullSafe(F.coalesce("after", none)))
    return moved.select("chain", "position").distinct()


def superseded(annotations: DataFrame) -> DataFrame:
    """annotations (hash, target, supersedes, created_at) with a flag for those that another one supersedes, oldest first."""
    by = annotations.filter("supersedes is not null").select(F.col("supersedes").alias("hash")).distinct().withColumn("superseded", F.lit(True))
    return annotations.join(by, "hash", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False))).orderBy("created_at", "hash")


def on_receipts(annotations: DataFrame, receipts: DataFrame) -> DataFrame:
    """Annotations whose target is a receipt of a chain."""
    return annotations.join(receipts.select(F.col("output_hash").alias("target")).distinct(), "target", "left_semi")


def gap_columns(columns: DataFrame, gaps: DataFrame) -> DataFrame:
    """Columns (chain, position, column) that first appear at or after a gap (chain, position): nothing accounts for their origin."""
    first = columns.groupBy("chain", "column").agg(F.min("position").alias("first"))
    start = gaps.groupBy("chain").agg(F.min("position").alias("gap"))
    return first.join(start, "chain").filter(F.col("first") >= F.col("gap")).select("chain", "column", "first")


def break_grid(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Whole-table totals (section, period, name, value) at a broken link: metric, expected, found, delta of what differs."""
    from tallyline.operators.totals import delta_rows

    whole = lambda df: df.filter(F.col("section").isin("row_count", "column_count", "numeric_sums", "null_counts"))
    metric = F.when(F.col("section") == "null_counts", F.concat(F.lit("null_counts["), F.col("name"), F.lit("]"))).when(F.col("section") == "numeric_sums", F.col("name")).otherwise(F.col("section"))
    return delta_rows(whole(expected), whole(found)).select(metric.alias("metric"), F.col("before").alias("expected"), F.col("after").alias("found"), "delta")


def changed_columns(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Columns whose sums or null counts differ at a broken link."""
    from tallyline.operators.totals import delta_rows

    return delta_rows(expected, found).filter(F.col("section").isin("numeric_sums", "null_counts")).select(F.col("name").alias("column")).distinct()
