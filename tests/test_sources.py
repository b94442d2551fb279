import datetime as dt
import json
import shutil
import socket
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyline.functions import cells
from tallyline.operators.canonical import semantic_hash, semantic_hash_row
from tallyline.plans import annotations, crypto, pipeline, receipts
from tallyline.sources import feed_stream, feeds, readers, shared, writers
from tallyline.streaming import watch

ROWS = [("2026-05-01", "1", "x"), ("2026-05-02", "2.50", None), ("2026-05-03", "3", 'q"u,o')]


def test_formats_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Day,amount,Label\n2026-05-01,1,x\n2026-05-02,2.50\n,,\n2026-05-03,3,"q""u,o",extra\n'.encode())
    (tmp_path / "a.tsv").write_text('Day\tamount\tLabel\n2026-05-01\t1\tx\n2026-05-02\t2.50\t\n2026-05-03\t3\t"q""u,o"\n')
    objects = [dict(zip(("Day", "amount", "Label"), r, strict=True)) for r in ROWS]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "a.ndjson").write_text("\n\n".join(map(json.dumps, objects)))
    df = spark.createDataFrame(ROWS, "Day string, amount string, Label string")
    writers.write_xlsx(df, tmp_path / "a.xlsx")
    hashes = {s: semantic_hash(readers.load(spark, str(tmp_path / f"a.{s}"))) for s in ("csv", "tsv", "json", "ndjson", "xlsx")}
    assert set(hashes.values()) == {semantic_hash(df)}, hashes


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "a.ndjson").write_text('{"a": 1}\nnot json\n')
    (tmp_path / "b.csv").write_text("A, a \n1,2\n")
    for name, text in (("a.json", "array of objects"), ("b.csv", "duplicate headers")):
        with pytest.raises(ValueError, match=text):
            readers.load(spark, str(tmp_path / name)).count()
    with pytest.raises(Exception):
        readers.load(spark, str(tmp_path / "a.ndjson")).count()
    with pytest.raises(ValueError, match="no reader"):
        readers.load(spark, "x.bin")


def test_workbook_kinds(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, True, "t"), (2, 2.0, None, None)], "a long, b double, c boolean, d string")
    writers.write_xlsx(df, tmp_path / "k.xlsx")
    got = readers.load(spark, str(tmp_path / "k.xlsx"))
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"} and got.count() == 2


def test_bounds_of_small_forms(spark, tmp_path, monkeypatch):
    df = spark.range(20)
    assert semantic_hash_row(df, 20).first()[0] == semantic_hash(df)
    with pytest.raises(Exception, match="more than 19 rows"):
        semantic_hash_row(df, 19).collect()
    assert writers.csv_text(df).count("\n") == 21
    with pytest.raises(ValueError, match="longer than 10"):
        writers.csv_text(df, 10)
    monkeypatch.setattr(writers, "SHEET_ROWS", 21)
    assert readers.read_xlsx(spark, str(writers.write_xlsx(df, tmp_path / "a.xlsx"))).count() == 20
    with pytest.raises(ValueError, match="at most 21 rows"):
        writers.write_xlsx(spark.range(21), tmp_path / "b.xlsx")
    shorts = spark.createDataFrame([("a" * n,) for n in (8, 10, 11, 64)], "h string").select("h", cells.short_hash(F.col("h")).alias("s")).collect()
    assert all(r.s == receipts.short(r.h) for r in shorts)


def test_workbook_ranges(spark, tmp_path):
    rows = [(i, None if i % 3 else f"t <row> {i} é", i / 4, i % 2 == 0) for i in range(53)]
    rows[20] = (None,) * 4  # a blank row counts for ranges and is no row of the table
    df = spark.createDataFrame(rows, "a long, b string, c double, d boolean")
    path = str(writers.write_xlsx(df, tmp_path / "w.xlsx"))
    want = [r for r in rows if any(v is not None for v in r)]
    for each in (1, 7, 52, 53, 54, 1000):
        got = readers.read_xlsx(spark, path, rows_per_partition=each)
        assert got.rdd.getNumPartitions() == max(1, -(-53 // each))
        assert [tuple(r) for r in got.collect()] == want
    assert readers.read_xlsx(spark, "file://" + path, rows_per_partition=9).count() == 52
    empty = readers.read_xlsx(spark, str(writers.write_xlsx(df.limit(0), tmp_path / "e.xlsx")))
    assert empty.columns == ["a", "b", "c", "d"] and empty.count() == 0


SHEET = """<?xml version="1.0" encoding="UTF-8"?>{doctype}<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:cols/><!-- <row> --><x:sheetData>
<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="B1" t="s"><x:v>1</x:v></x:c></x:row>
<x:row r="2"><x:c r="A2" s="1"><x:v>45000.5</x:v></x:c><x:c r="B2" t="s"><x:v>2</x:v></x:c></x:row>
<x:row r="5"><x:c r="B5" t="inlineStr"><x:is><x:t><![CDATA[<row r="9">]]></x:t></x:is></x:c></x:row><x:row r="6"/>
<x:row r="7"><x:c r="A7" s="1"><x:v>45001</x:v></x:c><x:c r="D7"><x:v>1</x:v></x:c></x:row></x:sheetData><x:mergeCells/></x:worksheet>"""


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_workbook_of_another_writer(spark, tmp_path, encoding):
    """Prefixed names, shared texts, dates by style, gaps, and what looks like a row in texts and comments."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def book(name, doctype=""):
        parts = {
            "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="q"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="q" Target="/xl/worksheets/s.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/sharedStrings.xml": f"<sst {main}><si><t>When</t></si><si><r><t>Wh</t></r><r><t>at</t></r></si><si><t>x</t></si></sst>",
            "xl/worksheets/s.xml": SHEET.format(doctype=doctype).replace("UTF-8", encoding.upper()).encode(encoding),
        }
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for part, data in parts.items():
                z.writestr(part, data)
        return str(tmp_path / name)

    path = book("s.xlsx")
    want = [(dt.datetime(2023, 3, 15, 12), "x"), (None, '<row r="9">'), (dt.datetime(2023, 3, 16), None)]
    for each in (1, 2, 100):
        got = readers.read_xlsx(spark, path, "S", each)
        assert got.columns == ["when", "what"] and [tuple(r) for r in got.collect()] == want
    with pytest.raises(Exception, match="no sheet named"):
        readers.read_xlsx(spark, path, "T").count()
    with pytest.raises(Exception, match="document types"):
        readers.read_xlsx(spark, book("d.xlsx", '<!DOCTYPE a [<!ENTITY b "c">]>')).count()


def test_feed_stream(spark, tmp_path):
    served, asked, state = tmp_path / "served", tmp_path / "asked", tmp_path / "state"

    class Stub(feed_stream.FeedSource):
        @staticmethod
        def fetch(url, etag=None, last_modified=None, **limits):
            tag, body = served.read_bytes().split(b"|", 1)
            with open(asked, "a") as f:
                f.write(f"{etag} ")
            return feeds.Fetched(None, etag, None, True) if etag == tag.decode() else feeds.Fetched(body, tag.decode())

    seen, failing = [], []

    def batch(df, number):
        rows = sorted(map(tuple, df.collect()))
        if failing:
            raise RuntimeError(failing.pop())
        seen.append((number, rows))

    def run(body):
        served.write_bytes(body)
        stream = feeds.map_records(feed_stream.read_stream(spark, "stub://a", str(state), Stub), {"id": "i", "v": "v"})
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query

    first, second = b'[{"i": 1, "v": 1.50}, {"i": 2}]', b'[{"i": 3, "v": "\xc3\xa9"}]'
    run(b"a|" + first)
    assert seen == [(0, [("1", "1.50"), ("2", "")])]
    run(b"a|" + first)  # not changed, by its etag
    run(b"b|" + first)  # not changed, by its content
    assert len(seen) == 1 and set(asked.read_text().split()) == {"None", "a"}
    failing.append("once")
    with pytest.raises(Exception, match="once"):
        run(b"c|" + second)
    run(b"d|[]")  # the failed batch is had with the body that it had; an empty feed is a batch without rows
    run(b"d|[]")
    assert seen[1:] == [(1, [("3", "é")]), (2, [])]
    with pytest.raises(Exception, match="UTF-8"):
        run(b"e|\xff")
    run(b"f|" + first)
    assert seen[3:] == [(3, [("1", "1.50"), ("2", "")])]
    assert len([n for n in shared.names(str(state)) if n.endswith(".body")]) <= 2
    with pytest.raises(Exception, match="state"):
        spark.readStream.format("tallyline_feed").options(url="stub://a").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(60)


def test_feeds(spark):
    raw = b'[{"t": "a", "v": 1.50, "b": true}, {"t": null, "v": 2}]'
    assert [tuple(r) for r in feeds.json_records(spark, raw, {"when": "t", "value": "v", "flag": "b"}).collect()] == [("a", "1.50", "true"), ("", "2", "")]
    columns = b'{"hourly": {"time": ["x", "y"], "temp": [1.0, null]}}'
    assert [tuple(r) for r in feeds.json_records(spark, columns, {"t": "time", "c": "temp"}, "hourly").collect()] == [("x", "1.0"), ("y", "")]
    with pytest.raises(feeds.SourceError, match="differ in length"):
        feeds.json_records(spark, b'{"a": [1], "b": []}', {"a": "a", "b": "b"}, "")
    rss = b"<rss><channel><item><guid>1</guid><title>T</title><pubDate>D</pubDate></item></channel></rss>"
    assert [tuple(r) for r in feeds.rss_records(spark, rss).collect()] == [("1", "T", "D")]
    with pytest.raises(feeds.SourceError, match="document types"):
        feeds.rss_records(spark, b"<!DOCTYPE x><rss/>")


def test_only_public_addresses():
    to = lambda *ips: lambda host, port, **kw: [(socket.AF_INET, 1, 6, "", (ip, port)) for ip in ips]
    assert feeds.public_address("https://example.org/x", to("93.184.216.34"))[1] == "93.184.216.34"
    for ips in (("127.0.0.1",), ("10.0.0.1",), ("93.184.216.34", "169.254.169.254"), ("::ffff:10.0.0.1",), ("64:ff9b::a00:1",), ("64:ff9b:1::7f00:1",), ("::1",)):
        with pytest.raises(feeds.SourceError, match="public"):
            feeds.public_address("http://example.org", to(*ips))
    for url in ("file:///etc/passwd", "http://user:x@example.org", "http://"):
        with pytest.raises(feeds.SourceError):
            feeds.public_address(url, to("93.184.216.34"))


def test_zip_columns(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(r) for r in feeds.zip_columns(df, {"n": "x", "s": "y"}).collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(Exception, match="differ in length"):
        feeds.zip_columns(spark.createDataFrame([([1], ["a", "b"])], "x array<int>, y array<string>"), {"n": "x", "s": "y"}).collect()


@pytest.fixture
def watched(spark, tmp_path):
    crypto.generate(tmp_path / "k")
    seed = crypto.load_private(tmp_path / "k" / "private.pem")
    (tmp_path / "feed.csv").write_text("day,amount\n" + "".join(f"2026-01-{d:02d},100\n" for d in range(1, 6)))
    pipeline.ingest(spark, str(tmp_path / "feed.csv"), tmp_path / "r", seed, band="5%", settle="72h")
    rows = lambda last, moved={}: spark.createDataFrame([(f"2026-01-{d:02d}", str(moved.get(d, 100))) for d in range(1, last + 1)], "day string, amount string")  # noqa: B006, E731
    from tallyline.plans import history

    history.verify_and_judge(spark, tmp_path / "r", seed=seed)
    return tmp_path / "r", seed, rows


def test_ticks(spark, watched):
    folder, seed, rows = watched
    tick = lambda df, **kw: watch.tick(spark, df, folder, seed, "feed", "feed.csv", **kw)["decision"]
    assert tick(rows(5)) == "unchanged"
    assert tick(rows(6)) == "appended"
    seen = []
    assert tick(rows(6, {2: 50}), on_withhold=seen.append) == "withheld" and len(seen) == 1
    assert tick(rows(6, {2: 50}), on_withhold=seen.append) == "withheld" and len(seen) == 1
    assert tick(rows(12), per_tick_cap=3) == "rate_capped"
    held = annotations.pending(folder)
    assert len(held) == 2
    moved = next(h for h, d in held if d["breached"])
    assert watch.review(spark, folder, seed, moved[:12], True, "corrected at the source", "ann") == "accepted"
    assert tick(rows(6, {2: 50})) == "unchanged" and receipts.verify_folder(spark, folder).ok and len(annotations.pending(folder)) == 1


def test_watched_stream(spark, watched, tmp_path):
    folder, seed, rows = watched
    rows(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("day string, amount string").parquet(str(tmp_path / "in"))
    run = watch.watch_stream(stream, lambda s: s.read.parquet(str(tmp_path / "in")), folder, seed, str(tmp_path / "state"), "feed", "feed.csv")
    run.awaitTermination()
    assert receipts.totals_of(receipts.load_receipts(folder)[0])["row_count"] == 7


def test_failing_batches_are_run_again_and_had_once(spark, watched, tmp_path, monkeypatch):
    folder, seed, rows = watched
    rows(7).write.parquet(str(tmp_path / "in"))
    real, calls = watch.tick, []

    def failing(*args, **kw):
        calls.append(1)
        if len(calls) <= 2:
            raise OSError("the ledger's disk is away")
        return real(*args, **kw)

    monkeypatch.setattr(watch, "tick", failing)
    stream = spark.readStream.schema("day string, amount string").parquet(str(tmp_path / "in"))
    start = lambda: watch.watch_stream(stream, lambda s: s.read.parquet(str(tmp_path / "in")), folder, seed, str(tmp_path / "state"), "feed", "feed.csv")
    before = receipts.tail_hash(folder)
    assert watch.supervise(spark, start, most_failures=3) == 2 and len(calls) == 3
    assert receipts.totals_of(receipts.load_receipts(folder)[0])["row_count"] == 7 and receipts.tail_hash(folder) != before
    [record] = (folder / "commits").rglob("*.json")
    assert json.loads(record.read_text())["decision"] == "appended"
    # Spark runs a batch again whose commit it didn't note: the record says that it is done
    shutil.rmtree(tmp_path / "state" / "commits")
    assert watch.supervise(spark, start) == 0 and len(calls) == 3
    calls.clear()
    rows(8).filter("day = '2026-01-08'").write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="disk is away"):
        watch.supervise(spark, start, most_failures=2)
    assert len(calls) == 2 and receipts.totals_of(receipts.load_receipts(folder)[0])["row_count"] == 7  # nothing is skipped: the next start takes it up
    assert watch.supervise(spark, start) == 0 and receipts.totals_of(receipts.load_receipts(folder)[0])["row_count"] == 8


def test_first_append_over_foreign_history(spark, watched):
    folder, seed, rows = watched
    assert watch.tick(spark, rows(6), folder, seed, "https://example.org/feed")["decision"] == "appended"
    assert receipts.load_receipts(folder)[0]["source"]["filename"] == "https://example.org/feed"
    assert watch.tick(spark, rows(6, {2: 50}), folder, seed, "https://example.org/feed")["decision"] == "withheld"
    shown = annotations.timeline(spark, folder)["pending"]
    assert [set(x) for x in shown] == [{"source_id", "created_at", "caveat_count", "hash"}] and shown[0]["caveat_count"] == 1
    # withheld rows count as kept only where the writer's mark is
    place = Path(annotations.pending(folder)[0][1]["candidate"]["records"])
    (place / "_SUCCESS").unlink()
    watch.tick(spark, rows(6, {2: 50}), folder, seed, "https://example.org/feed")
    assert (place / "_SUCCESS").exists() and spark.read.parquet(str(place)).count() == 6


def test_late_rows(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    from tallyline.streaming import late

    day = lambda d, h=0: dt.datetime(2026, 1, d, h)
    batches = [
        [("a", day(1, 1), day(1, 2), "1.5"), ("b", day(1, 3), day(2), "2"), ("c", day(2, 1), day(2, 2), "x")],
        [("d", day(1, 4), day(4), "4"), ("e", day(3), day(6), "1"), (None, day(3), day(6), None), ("n", None, day(6), "1")],  # d: at day 1's deadline
        [("f", day(1, 5), day(7), "10"), ("g", day(1, 6), day(7), None), ("h", day(4), day(12), "3"), ("i", day(2, 3), day(12), "-1")],
        [("z", day(28), day(28), "0")],
    ]
    seen = []
    for k, grouped in enumerate((batches, [sum(batches, [])])):
        where = tmp_path / f"in{k}"
        for rows in grouped:
            spark.createDataFrame(rows, "id string, ts timestamp, at timestamp, v string").coalesce(1).write.mode("append").parquet(str(where))
        stream = spark.readStream.schema("id string, ts timestamp, at timestamp, v string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(where))
        late.flag_late(stream, "ts", "at", "id", "v", settle_hours=48, disorder="20 days", salts=2).writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).outputMode("append").option("checkpointLocation", str(tmp_path / f"state{k}")).trigger(availableNow=True).start().awaitTermination()
        emitted = spark.read.parquet(str(tmp_path / f"out{k}"))
        told = {(r.id, r.metric): (r.period, r.before, r.after) for r in late.verdicts(emitted).collect()}
        assert told == {
            ("f", "row_count"): ("2026-01-01", "3", "4"), ("f", "amount"): ("2026-01-01", "7.5", "17.5"), ("g", "row_count"): ("2026-01-01", "4", "5"),
            ("h", "row_count"): ("2026-01-04", "0", "1"), ("h", "amount"): ("2026-01-04", "0", "3"), ("i", "row_count"): ("2026-01-02", "1", "2"), ("i", "amount"): ("2026-01-02", "0", "-1"),
        }
        moved = late.settled_breaches(spark, emitted, dt.datetime(2026, 2, 1, tzinfo=dt.timezone.utc), 48, Decimal("0.05")).collect()
        assert {(r.type, r.metric, r.period, str(r.before), str(r.after)) for r in moved} == {
            ("settled_movement", "row_count", "2026-01-01", "3.000000", "5.000000"), ("settled_movement", "amount", "2026-01-01", "7.500000", "17.500000"),
            ("settled_movement", "row_count", "2026-01-02", "1.000000", "2.000000"), ("settled_movement", "amount", "2026-01-02", "0.000000", "-1.000000"),
        }
        seen.append(told)
    assert seen[0] == seen[1]


def test_feeds_in_the_plan(spark):
    objects = '{"a": 1.10, "b": "x, 2.50 \\" 3", "c": [1.0, {"d": -5e3}], "e": null, "f": true}'
    df = spark.createDataFrame([(objects,), (f" [{objects}, {{}}]",), ("[]",), ("nope",), ("7",), (None,)], "value string")
    got = [tuple(r) for r in feeds.map_records(df, {"A": "a", "b": "b", "c": "c", "e": "e", "f": "f"}).collect()]
    assert got == [("1.10", 'x, 2.50 " 3', '["1.0",{"d":"-5e3"}]', "", "true")] * 2 + [("", "", "", "", "")]
    rss = '<rss><channel><title>t</title><item><guid>g</guid><title> a </title><pubDate>d</pubDate></item><item><link>l</link></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="h"/><title>é</title><updated>u</updated></entry></feed>'
    feeds_of = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    assert [tuple(r) for r in feeds.map_entries(feeds_of(rss, atom, "nope", "<a/>")).collect()] == [("g", "a", "d"), ("l", "", ""), ("h", "é", "u")]
    assert [tuple(r) for r in feeds.map_entries(feeds_of(rss), {"name": "title"}).collect()] == [("a",), ("",)]
    for bad in ('<!DOCTYPE x [<!ENTITY y "z">]><rss/>', "<rss><!ENTITY y></rss>"):
        with pytest.raises(Exception, match="document types"):
            feeds.map_entries(feeds_of(bad)).collect()
