"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: one record per row, in files of a bounded number of records. Of rows with equal
payloads (of ``least_bytes`` or more) the one with the smallest key is a response,
the others are revisits that hold HTTP headers but no payload.

Reading: tasks cut their byte ranges at the magic line, so every occurrence of it is a
candidate record, true or inside a payload. A candidate's header names the
length of its block, and so the offset of its successor. Pointer jumping from the start
of each file keeps the candidates that the chain of true records reaches; what lies
between them belongs to payloads, which are put together again.

Defined results: a null payload is empty; a null URL is written as an empty one, line
breaks in it as blanks; a null key revisits the smallest key of its group, and is a
response in a group without any. Rows repeated with the smallest key are all responses. An
empty table gives an archive without records. Other columns are not read. A chain
that ends in no record boundary raises ValueError, as the file is damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import discard, join_split, materialise, work_path

MAGIC = "WARC/1.0\r\n"
URN = "urn:page:"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a digest of 40 hex digits: 40 bits make eight letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """The frame, hinted for broadcasting if it has at most that many rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 50_000, most_broadcast: int = 200_000) -> None:
    """Writes the archive files of the rows into the folder ``path``."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("order"), F.col(url).alias("url"), body.alias("body"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"))
    keys = materialise(rows.select("order", "digest", "bytes"), "warc-keys")
    groups = keys.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups, "warc-groups")
    # One payload, the empty one say, may be a large share of all rows.
    revisits = materialise(join_split(keys, groups, ["digest", "bytes"], "n").filter(~F.col("order").eqNullSafe(F.col("first")) & F.col("first").isNotNull()).select(F.col("order").alias("revisit"), F.col("digest").alias("its_digest"), F.col("first").cast("string").alias("first")).distinct(), "warc-revisits")
    marked = rows.join(_bounded(revisits, most_broadcast), F.col("order").eqNullSafe(F.col("revisit")) & (F.col("digest") == F.col("its_digest")), "left")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), F.coalesce("key", F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <{URN}"), "first", F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes")), F.lit("\r\n\r\n"), http,
    )
    record = F.concat(header, F.when(again, "").otherwise(F.col("body").cast("string")), F.lit("\r\n\r"))  # the writer adds the last line feed
    marked.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def _header(value: Column) -> Column:
    return F.substring_index(value, "\r\n\r\n", 1)


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?:^|\r\n)(?i:{name}):[ \t]*([^\r\n]*)", 1)


def _parsed(value: Column, length: Column) -> dict[str, Column]:
    """What a whole record's text tells; value starts after the magic line."""
    header = _header(value)
    block = F.substring(value.cast("binary"), F.octet_length(header) + 5, length)
    http = _header(block.cast("string"))
    payload = F.substring(block, F.octet_length(http) + 5, length)
    kind = _field(header, "WARC-Type")
    return {
        "record_type": kind,
        "record_id": _field(header, "WARC-Record-ID"),
        "url": _field(header, "WARC-Target-URI"),
        "declared_digest": F.regexp_replace(_field(header, "WARC-Payload-Digest"), "^sha1:", ""),
        "refers_to": _field(header, "WARC-Refers-To"),
        "declared_bytes": _field(http, "Content-Length").try_cast("long"),
        "payload_bytes": F.when(kind == "response", F.octet_length(payload).cast("long")),
        "payload_digest": F.when(kind == "response", base32_of_hex(F.sha1(payload))),
    }


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic line, with its place; the first chunk of a file is what stands before any."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from each file's offset 0; nodes: file, at, next (null after the last)."""
    state, spark = materialise(nodes.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("on")), "warc-chain"), nodes.sparkSession
    while state.filter("`on` and jump is not null").limit(1).count():
        hits = state.filter("`on` and jump is not null").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        further = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("next"))
        after = state.join(hits, ["file", "at"], "left").join(further, ["file", "jump"], "left").select("file", "at", F.col("next").alias("jump"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))
        before, state = state.inputFiles(), materialise(after, "warc-chain")
        discard(spark, *{f.rpartition("/")[0] for f in before})
    return state.filter("`on`").select("file", "at")


def read(spark: SparkSession, path: str, most_broadcast: int = 100_000) -> DataFrame:
    """A row per true record: file, at, record_type, record_id, url, payload_bytes and payload_digest of the full payload, refers_to."""
    chunks = _chunks(spark, path)
    header = _header(F.col("value"))
    length = _field(header, "Content-Length").try_cast("long")
    size = F.octet_length("value").cast("long")
    whole = F.coalesce(size == F.octet_length(header) + length + 8, F.lit(False))
    facts = materialise(
        chunks.select("file", "block", "row", size.alias("size"), F.xxhash64("value").alias("mark"), (F.octet_length(header) + length + 8).alias("declared"), whole.alias("whole"), *[F.when(whole, c).alias(n) for n, c in _parsed(F.col("value"), length).items()]),
        "warc-facts",
    )
    order = Window.partitionBy("file").orderBy("block", "row")
    magic = len(MAGIC)
    placed = facts.withColumn("k", F.row_number().over(order)).withColumn("end", F.sum("size").over(order) + (F.col("k") - 1) * magic)
    placed = materialise(placed.filter("k > 1").withColumn("at", F.col("end") - F.col("size") - magic).withColumn("next", F.col("at") + magic + F.col("declared")).drop("k"), "warc-placed")
    on = materialise(reachable(placed.select("file", "at", "next")).withColumn("on", F.lit(True)), "warc-on")
    true = placed.join(on, ["file", "at"])
    if true.join(placed.select("file", F.col("at").alias("next"), F.lit(True).alias("follows")), ["file", "next"], "left").join(placed.groupBy("file").agg(F.max("end").alias("stop")), "file").filter("follows is null and not (next <=> stop)").limit(1).count():
        raise ValueError(f"an archive in {path} is damaged: a record doesn't end where another begins")
    fields = ["record_type", "record_id", "url", "declared_digest", "refers_to", "declared_bytes", "payload_bytes", "payload_digest"]
    records = true.filter("whole").select("file", "at", *fields)
    if true.filter("not whole").limit(1).count():
        owner = F.last(F.when(F.col("on"), F.struct("at", "whole", "declared")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
        owned = placed.join(on, ["file", "at"], "left").select("file", "mark", "at", owner.alias("owner")).filter("not owner.whole")
        # The archive is read again for these chunks alone; a chunk is known by its file and its contents.
        marks = _bounded(owned.select("file", "mark").distinct(), most_broadcast)
        values = chunks.withColumn("mark", F.xxhash64("value")).join(marks, ["file", "mark"]).groupBy("file", "mark").agg(F.first("value").alias("value"))
        parts = owned.join(values, ["file", "mark"])
        texts = parts.groupBy("file", F.col("owner.at").alias("start"), F.col("owner.declared").alias("declared")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        block = F.col("declared") - F.octet_length(_header(F.col("value"))) - 8
        records = records.unionByName(texts.select("file", F.col("start").alias("at"), *[c.alias(n) for n, c in _parsed(F.col("value"), block).items()]))
    named = lambda c: F.nullif(F.regexp_extract(c, rf"^<{URN}(.*)>$", 1), F.lit(""))
    return records.select(
        "file", "at", "record_type", named(F.col("record_id")).alias("record_id"), "url",
        F.coalesce("payload_bytes", "declared_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "declared_digest").alias("payload_digest"), F.when(F.col("record_type") == "revisit", named(F.col("refers_to"))).alias("refers_to"),
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the rows into a new folder of the shared one and reads the archives back."""
    path = work_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
