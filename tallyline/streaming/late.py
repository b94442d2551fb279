"""Late rows of a stream, flagged instead of dropped.

A row has an event time, which names its UTC day, and an arrival time, which the watermark follows. A day settles
until its end plus the settling window. Rows that arrive by then are counted and summed in state, of which each day has
a few salted parts, so a busy day is spread over tasks; a timer closes a part when the watermark passes the
deadline, gives out its totals and frees its state. A row that arrives later can only move a settled day: it is
given out as it is, whatever the watermark. verdicts() puts both together, each late row with the day's settled
value before it and the value that it makes.

Defined results: rows without an event or an arrival time, or with arrival times before the watermark, are left out; a value
that is no number counts as a row and adds nothing; values are exact in millionths.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyline.functions import cells
from tallyline.operators import judge

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCALE = 1_000_000
EMITTED = "kind string, period string, row_count long, amount long, id string, arrived timestamp"


def deadline_ms(period: str, settle_hours: int) -> int:
    """Milliseconds of a day's end plus the settling window."""
    day = dt.datetime.fromisoformat(period).replace(tzinfo=dt.timezone.utc)
    return int((day + dt.timedelta(days=1, hours=settle_hours)).timestamp() * 1000)


class SettlingDay(StatefulProcessor):
    """Counts and sums of a part of a day until its deadline."""

    def __init__(self, settle_hours: int):
        self.settle_hours = settle_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "row_count long, amount long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        period = key[0]
        deadline = deadline_ms(period, self.settle_hours)
        count = amount = 0
        for batch in rows:
            late = batch["late"]
            count += int((~late).sum())
            amount += int(batch.loc[~late, "amount"].sum())
            if late.any():
                own = batch[late]
                yield pd.DataFrame({"kind": "late", "period": period, "row_count": 1, "amount": own["amount"], "id": own["id"], "arrived": own["arrived"]})
        if count:
            if self.held.exists():
                before = self.held.get()
                count, amount = count + before[0], amount + before[1]
            else:
                self.handle.registerTimer(deadline)
            self.held.update((count, amount))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        count, amount = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"kind": ["settled"], "period": [key[0]], "row_count": [count], "amount": [amount], "id": pd.Series([None], dtype="object"), "arrived": pd.Series([None], dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def flag_late(stream: DataFrame, time: str, arrived: str, id: str, value: str | None = None, settle_hours: int = 72, disorder: str = "0 seconds", salts: int = 16) -> DataFrame:
    """The stream's settled days, in parts, and its late rows, in the columns of EMITTED; amounts in millionths.

    disorder: how far arrival times may run behind. A day's deadline doesn't depend on batches, so replays of
    any batches flag the same rows.
    """
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # the only store that such state can be kept in
    number = F.lit(0).cast("long") if value is None else F.coalesce(F.expr(f"try_cast(round(try_cast(`{value}` AS decimal(38,6)) * {SCALE}) AS long)"), F.lit(0).cast("long"))
    rows = stream.select(F.col(time).cast("timestamp").alias("time"), F.col(arrived).cast("timestamp").alias("arrived"), F.col(id).cast("string").alias("id"), number.alias("amount")).filter("time is not null and arrived is not null")
    day = F.date_trunc("day", "time")
    late = F.col("arrived") > day + F.make_dt_interval(days=F.lit(1), hours=F.lit(settle_hours))
    keyed = rows.withColumns({"period": F.date_format("time", "yyyy-MM-dd"), "late": late, "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")})
    watched = keyed.withWatermark("arrived", disorder).groupBy("period", "salt")
    return watched.transformWithStateInPandas(SettlingDay(settle_hours), EMITTED, "Append", "EventTime")


def verdicts(emitted: DataFrame) -> DataFrame:
    """(id, period, arrived, type, metric, before, after): what each late row of settled days moves, in the order of arrival; of rows that arrive together the smaller id counts first.

    Values are those of the judge: a row count and a sum in plain decimal text. Days of which every row is late had no value before.
    """
    day = Window.partitionBy("period")
    running = day.orderBy("arrived", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda kind, c: F.coalesce(F.when(F.col("kind") == kind, F.col(c)), F.lit(0))
    sums = {f"{c}0": F.sum(of("settled", a)).over(day) for c, a in (("rows", "row_count"), ("amount", "amount"))} | {f"{c}1": F.sum(of("late", a)).over(running) for c, a in (("rows", "row_count"), ("amount", "amount"))}
    joined = emitted.withColumns(sums).filter("kind = 'late'")
    text = lambda c, unit: cells.plain_text((F.col(c).cast("decimal(38,0)") / unit).cast(cells.DEC) if unit > 1 else F.col(c).cast(cells.DEC))
    sides = lambda metric, start, end, add, unit: F.struct(F.lit(metric).alias("metric"), text(start, unit).alias("before"), text(end, unit).alias("after"), (F.col(add) != 0).alias("moved"))
    placed = joined.withColumns({"before_rows": F.col("rows0") + F.col("rows1") - F.col("row_count"), "after_rows": F.col("rows0") + F.col("rows1"), "before_amount": F.col("amount0") + F.col("amount1") - F.col("amount"), "after_amount": F.col("amount0") + F.col("amount1")})
    moves = F.array(sides("row_count", "before_rows", "after_rows", "row_count", 1), sides("amount", "before_amount", "after_amount", "amount", SCALE))
    told = placed.select("id", "period", "arrived", F.explode(moves).alias("m")).filter("m.moved")
    return told.select("id", "period", "arrived", F.lit("settled_movement").alias("type"), "m.metric", "m.before", "m.after")


def settled_breaches(spark: SparkSession, emitted: DataFrame, created: dt.datetime, settle_hours: int, band: Any) -> DataFrame:
    """The judge's breaches of the days' totals with their late rows against the settled ones: the last of verdicts() by day."""
    by_day = lambda df, run: df.groupBy("period").agg(F.sum("row_count").alias("row_count"), F.sum("amount").alias("amount")).select(*run, F.col("period").alias("bucket"), F.explode(F.array(
        F.struct(F.lit("row_count").alias("metric"), F.col("row_count").cast(judge.VALUE).alias("value")), F.struct(F.lit("amount").alias("metric"), (F.col("amount").cast("decimal(26,0)") / SCALE).cast(judge.VALUE).alias("value")))).alias("m")).select(*[c for c in ("run", "created") if run], "bucket", "m.*")
    settled = by_day(emitted.filter("kind = 'settled'"), [F.lit("settled").alias("run"), F.lit(created - dt.timedelta(seconds=1)).alias("created")])
    flagged = spark.createDataFrame([], "run string, bucket string, metric string")
    return judge.breaches(settled, flagged, by_day(emitted, []), band, settle_hours, created)
