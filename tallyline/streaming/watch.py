"""A watched source: each tick appends clean periods and withholds suspicious changes for review.

The judge flags late changes instead of dropping them, so ticks run inside foreachBatch over
whole snapshots; a watermark is used only for the bounded per-day aggregate (late rows: see late.py).

A batch that fails fails its query, so its offsets stay uncommitted; supervise() starts the query anew from its checkpoint, up to
a number of failures in a row. What a batch decided is recorded in the ledger under the query's and the batch's number, so a
batch that Spark runs again after the ledger was written is not judged again: its effect is had once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from tallyline.plans import annotations, files, history, pipeline, receipts
from tallyline.session import shared_folder


class IdentityError(ValueError):
    """The committed history belongs to another source."""


def new_rows_or_periods(found: dict[str, Any]) -> int:
    """New day buckets of the candidate, or without buckets its growth in rows."""
    before, after = (receipts.totals_of(r) for r in (found["committed"], found["manifest"]))
    if isinstance(after.get("period_buckets"), dict) and isinstance(before.get("period_buckets"), dict):
        return len(set(after["period_buckets"]) - set(before["period_buckets"]))
    return max(0, after.get("row_count", 0) - before.get("row_count", 0))


def withheld_place(spark: SparkSession) -> str:
    """Where the cluster writes withheld rows: in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/tallyline-withheld"


def _kept(records: DataFrame, offered: dict[str, Any]) -> dict[str, Any]:
    """The offer with the place of its rows: written by the cluster as Parquet, under the hash that the manifest signs, and whole only if the writer's mark is there."""
    spark = records.sparkSession
    path = f"{withheld_place(spark)}/{offered['manifest']['semantic_hash']}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        records.write.mode("overwrite").parquet(path)
    return offered | {"records": path}


def tick(spark: SparkSession, records: DataFrame, folder: str | Path, seed: bytes, source_id: str, filename: str | None = None, trusted: list[str] | None = None, per_tick_cap: int | None = None, on_withhold: Callable[[dict[str, Any]], None] | None = None) -> dict[str, Any]:
    """One decision: unchanged, withheld, rate_capped or appended, looked for in this order.

    The source's identity is filename, or without one the source_id. A chain that holds runs of other sources alone may be
    continued: there is no history of its own that the first append could be judged against.
    """
    filename = filename or source_id
    # As read from a csv file: text, and null where a cell is empty. Computed once: a table that moves on is judged as it was.
    records, _ = pipeline.evaluated(records.select(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in records.columns]), "tick")
    found = pipeline.candidate_of(records, filename, folder, seed, trusted)
    if found["unchanged"]:
        return {"decision": "unchanged"}
    judged = found["judgment"]
    if found["own_history"] and history.NOTICES["other source"] in judged["notices"]:
        raise IdentityError(f"{filename} has archived runs, but none that the new data can be judged against")
    offered = {"manifest": found["manifest"]}
    if judged["caveats"]:
        path = annotations.withhold(spark, folder, seed, source_id, found["base_tail"], judged, _kept(records, offered))
        if path is not None and on_withhold:
            on_withhold(judged)
        return {"decision": "withheld", "caveats": judged["caveats"], "new": path is not None}
    if per_tick_cap is not None and new_rows_or_periods(found) > per_tick_cap:
        annotations.withhold(spark, folder, seed, source_id, found["base_tail"], {"caveats": [f"more than {per_tick_cap} new periods in one tick"], "details": [], "breached": {}}, _kept(records, offered))
        return {"decision": "rate_capped"}
    pipeline.commit(spark, folder, found, seed)
    return {"decision": "appended"}


def decided(folder: str | Path, query: str, batch: int) -> dict[str, Any] | None:
    """What was decided for a batch of a query, None if nothing was yet."""
    path = Path(folder) / "commits" / query / f"{batch}.json"
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def once(folder: str | Path, query: str, batch: int, decide: Callable[[], dict[str, Any]]) -> dict[str, Any]:
    """The decision on a batch, made once. If the ledger was written but not the record, the tick that follows decides "unchanged"."""
    done = decided(folder, query, batch)
    if done is None:
        done = decide()
        record = {"query": query, "batch": batch, "decision": done["decision"], "tail": receipts.tail_hash(folder), "at": receipts.now_iso()}
        files.write_text(Path(folder) / "commits" / query / f"{batch}.json", files.text_of(record))
    return done


def review(spark: SparkSession, folder: str | Path, seed: bytes, prefix: str, accept: bool, reason: str, author: str) -> str:
    """Accepts a withheld change (its manifest becomes the chain, if the base is still current) or rejects it."""
    digest, event = annotations.pending_by_prefix(folder, prefix)
    key = receipts.read_chain(folder).get("public_key")
    if not receipts.verify_signature(spark, event, key):
        raise ValueError("the pending change isn't signed by the chain's key")
    if accept:
        manifest = event["candidate"]["manifest"]
        if not receipts.verify_signature(spark, manifest, key):
            raise ValueError("the withheld manifest isn't signed by the chain's key")
        pipeline.commit(spark, folder, {"manifest": manifest, "base_tail": event["base_tail"], "judgment": {"breached": event.get("breached") or {}}}, seed)
        annotations.annotate(spark, folder, seed, receipts.tail_hash(folder), reason, author, accepts=digest)
    annotations.drop_pending(folder, digest)
    return "accepted" if accept else "rejected"


def watch_stream(stream: DataFrame, table: Callable[[SparkSession], DataFrame], folder: str | Path, seed: bytes, checkpoint: str, source_id: str, filename: str | None = None, every: str | None = None, **options: Any) -> StreamingQuery:
    """A query that ticks over the whole table whenever the stream brings rows, once or ``every`` so often. A failing tick fails the query."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # kept in the checkpoint, the same after a restart
        once(folder, query, number, lambda: tick(spark, table(spark), folder, seed, source_id, filename, **options))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Finished(StreamingQueryListener):
    """Counts finished batches that had rows."""

    def __init__(self) -> None:
        self.batches = 0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        if event.progress.numInputRows:
            self.batches += 1

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


#: Errors that a restart can't mend.
FATAL = ("IdentityError", "UntrustedSigner")


def supervise(spark: SparkSession, start: Callable[[], StreamingQuery], most_failures: int = 10, pause: float = 0.0) -> int:
    """Runs a query until it ends by itself, starting it anew from its checkpoint when it fails; returns how often it failed.

    Raises the last failure after ``most_failures`` without a finished batch between, and at once one that a restart can't mend.
    """
    seen, failures, in_a_row = Finished(), 0, 0
    spark.streams.addListener(seen)
    try:
        while True:
            batches = seen.batches
            try:
                start().awaitTermination()
                return failures
            except StreamingQueryException as e:
                failures += 1
                in_a_row = 1 if seen.batches > batches else in_a_row + 1
                if in_a_row >= most_failures or any(f"{name}:" in str(e) for name in FATAL):
                    raise
                time.sleep(pause)
    finally:
        spark.streams.removeListener(seen)


def day_buckets(stream: DataFrame, time: str, sums: list[str], settle: str = "72 hours") -> DataFrame:
    """Counts and sums by UTC day of an event-time stream; a day closes once the settling window has passed."""
    kept = stream.withWatermark(time, settle).groupBy(F.window(time, "1 day"))
    return kept.agg(F.count("*").alias("row_count"), *[F.sum(F.col(c).cast("string").try_cast("decimal(38,6)")).alias(f"sum_{c}") for c in sums]).select(F.date_format("window.start", "yyyy-MM-dd").alias("period"), "row_count", *[f"sum_{c}" for c in sums])
