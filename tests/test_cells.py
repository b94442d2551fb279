import datetime as dt
import hashlib
import json
import random
import unicodedata
from decimal import Decimal

import pytest

from tallyline.functions import cells, headers
from tallyline.operators import canonical, totals
from tallyline.sources.readers import frame


def reference_cell(v):
    """An independent reading of the rules, cell by cell."""
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d") if v.time() == dt.time() else v.strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(v, dt.date):
        return v.isoformat()
    found = cells.python_decimal(repr(v) if isinstance(v, float) else str(v))
    return cells.plain(found) if found is not None else unicodedata.normalize("NFC", str(v)).strip()


def document(df):
    return b"".join(canonical.document_parts(df)).decode()


def reference_document(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [[reference_cell(r[i]) for i in order] for r in rows]
    token = lambda c: "0:" if c is None else f"1:{str(c).lower()}" if isinstance(c, bool) else f"2:{c}"
    body.sort(key=lambda r: [token(c) for c in r])
    return json.dumps({"headers": [names[i] for i in order], "rows": body}, ensure_ascii=False, separators=(",", ":"))


TEXTS = ["", " ", "0.0000005", "0.0000015", "-0.0000005", "0.0000005000000000000000001", "1e3", "1.", ".5", "+5", "1_000", "５", " 5 ", "1E-7", "4e-30", "00030.00", "-0", "nan", "Infinity", "5d", "e5", "1.2.3", "é", "é", "\x1f", "a\"b\\c\n\x0b\x1c", "\\u000B", "�", "😀", "12345678901234567890123", "x\x85"]


def test_text_cells(spark):
    rows = [(t,) for t in TEXTS[:-2]] + [(None,), ("9999999999999999999999",), ("0.1234567890123456789",)]
    assert document(spark.createDataFrame(rows, "t string")) == reference_document(rows, ["t"])


def test_number_forms_at_their_bounds_in_one_pass_over_stripped_text(spark):
    rng = random.Random(11)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert list(cells.SPACES) == spaces
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"{s}{digits(w)}{p}{digits(f) if p else ''}{e}" for s in ("", "+", "-") for w in (0, 1, 9, 10, 11, 19, 20) for p in ("", ".") for f in (0, 1, 9, 10, 18) for e in ("", "e9", "E-9", "e+0", "e10", "e-18", "e")]
    texts = [t for t in texts if (d := cells.python_decimal(t)) is None or abs(d) < 10**20 and (d == 0 or d.as_tuple().exponent >= -18)]
    rows = [("".join(rng.choices(spaces, k=rng.randrange(3))) + t + "".join(rng.choices(spaces, k=rng.randrange(3))), f" n{k % 7}") for k, t in enumerate([*texts, "", "a b"])]
    df = spark.createDataFrame(rows, "t string, u string")
    assert document(df) == reference_document(rows, ["t", "u"])
    assert [r[0] for r in df.select(cells.needs_nfc(df["t"])).collect()] == [not r[0].isascii() for r in rows]
    # Where no cell needs Python, each column is trimmed in one place, a projection below the one that reads it, and by no pattern.
    forms = spark.createDataFrame([(" 10e-1", " n1"), ("+1.", None)], "t string, u string")
    assert [tuple(r) for r in canonical.canonical_cells(forms).collect()] == [("1", "n1"), ("1", None)]
    plan = canonical.canonical_cells(forms)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and plan.count("else trim(") == plan.count("project [") == 2


def test_number_beyond_22_digits_is_an_error(spark):
    with pytest.raises(Exception, match="22 integer digits"):
        document(spark.createDataFrame([("12345678901234567890123",)], "t string"))


def test_typed_cells(spark):
    rows = [(1, 0.1 + 0.2, Decimal("1.50"), True, dt.date(2026, 5, 1), dt.datetime(2026, 5, 1), 1.5), (2, -0.0, Decimal("0.0000005"), False, None, dt.datetime(2026, 5, 1, 13, 45, 9, 5), 1e15), (None,) * 7, (3, float("nan"), Decimal("2"), None, dt.date(1, 1, 1), dt.datetime(2026, 5, 1, 0, 0, 0, 5), float("-inf"))]
    df = spark.createDataFrame(rows, "a long, b double, c decimal(20,10), d boolean, e date, f timestamp_ntz, g double")
    assert document(df) == reference_document(rows, list("abcdefg"))


def test_float32_is_widened_first(spark):
    df = spark.createDataFrame([(1.1,)], "x float")
    assert '"1.1"' in document(df)


def test_random_tables_match_the_independent_version(spark):
    rng = random.Random(5)
    pool = TEXTS[:-3] + [f"{rng.uniform(-1e6, 1e6):.8f}" for _ in range(30)]
    for _ in range(3):
        rows = [(rng.choice(pool), rng.choice([None, *pool]), rng.choice([None, True, False]), rng.choice([None, rng.randint(-(10**12), 10**12)])) for _ in range(60)]
        df = spark.createDataFrame(rows, "B string, a string, c boolean, d long").repartition(5)
        assert document(df) == reference_document(rows, ["b", "a", "c", "d"])


def test_hash_ignores_order_partitions_and_spelling(spark):
    df = spark.createDataFrame([(i, f"{i}.0", None if i % 3 else "x") for i in range(200)], "k long, v string, w string")
    want = canonical.semantic_hash(df)
    assert canonical.semantic_hash(df.repartition(9).select("w", "v", "k")) == want
    assert canonical.semantic_hash(df.selectExpr("cast(k as string) as ` K `", "v", "w")) == want
    assert canonical.semantic_hash_row(df).first()[0] == want
    assert canonical.semantic_hash(df.filter("k <> 7")) != want
    assert canonical.semantic_hash(df.limit(0)) == hashlib.sha256(b'{"headers":["k","v","w"],"rows":[]}').hexdigest()


def test_the_hash_is_made_by_tasks(spark, monkeypatch):
    df = spark.range(3000).selectExpr("cast(id * 7919 % 3001 as string) as k", "if(id % 5 = 0, null, repeat('é', cast(id % 40 as int))) as v").repartition(6)
    want = hashlib.sha256(document(df).encode()).hexdigest()
    monkeypatch.setattr(canonical, "CELL_BYTES", 300)

    def through_the_driver(*_, **__):
        raise AssertionError("the document went through the driver")

    monkeypatch.setattr(type(df), "toLocalIterator", through_the_driver)
    assert canonical.semantic_hash(df) == want
    assert canonical.semantic_hash(df.limit(0)) == hashlib.sha256(b'{"headers":["k","v"],"rows":[]}').hexdigest()


def test_row_fingerprint_counts_repeated_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    once, twice = (canonical.row_fingerprint(x).first() for x in (df, df.unionAll(df)))
    assert (once.row_count, twice.row_count) == (2, 4) and int(twice.sum_a) == 2 * int(once.sum_a)
    assert canonical.row_fingerprint(df.repartition(3)).first() == once


def test_headers(spark):
    assert headers.normalise("  Total \t Spend (USD) ") == "total_spend_(usd)"
    with pytest.raises(ValueError, match="duplicate"):
        headers.normalise_all(["A", " a"])
    merged = headers.merge(spark.createDataFrame([("x", "y"), ("x", None)], ["Name", "name "]))
    assert [r[0] for r in merged.collect()] == ["y", "x"]


def test_mixed_records_keep_their_kind_as_text(spark):
    df = frame(spark, [{"x": 1, "y": "a"}, {"x": "1.0"}, {"x": dt.date(2026, 5, 1), "z": True}])
    assert document(df) == '{"headers":["x","y","z"],"rows":[["1",null,null],["1","a",null],["2026-05-01",null,true]]}'
    with pytest.raises(TypeError):
        frame(spark, "text")


def test_day_keys(spark):
    texts = ["2026-05-02", "2026-13-02", "2026-05-02 00:00", "2026-05-02T23:30:00Z", "2026-05-02T23:30:00.123+05:30", "2026-05-02T01:00-02:00", "02.05.2026", None, "2026-05-02T25:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cells.day_key(df["t"], df.schema["t"].dataType)).collect()]
    assert got == ["2026-05-02", None, "2026-05-02", "2026-05-02", "2026-05-02", "2026-05-02", None, None, None]


def test_period_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 1),)], "c timestamp_ntz")
    row = df.select(*[cells.period_key(F.col("c"), g) for g in ("day", "week", "month", "quarter")]).first()
    assert list(row) == ["2024-12-30", "2025-W01", "2024-12", "2024-Q4"]


def test_totals_document(spark):
    rows = [("2026-05-01", "1", "a"), ("2026-05-02", "2.5", None), (None, "x", "289,084"), *[("2026-05-02", "1", "1,000")] * 20]
    df = spark.createDataFrame(rows, "Day string, amount string, grouped string")
    got = totals.control_totals(df)
    assert got["row_count"] == 23 and got["numeric_sums"] == {"amount": "23.5"} and got["null_counts"] == {"day": 1, "grouped": 1} and got["bucket_column"] == "day"
    assert got["period_buckets"]["2026-05-02"] == {"row_count": 21, "numeric_sums": {"amount": "22.5"}, "null_counts": {"grouped": 1}}
    assert got["period_buckets"]["_unbucketed"] == {"row_count": 1, "numeric_sums": {"amount": "0"}, "null_counts": {"day": 1}}
    assert totals.grouped_numeric_columns(df) == [{"column": "grouped", "example": "1,000"}]
    with pytest.raises(ValueError, match="does not qualify"):
        totals.control_totals(df, "amount")


def test_one_day_or_two_candidates_give_no_buckets(spark):
    one = spark.createDataFrame([("2026-05-01",)] * 3, "d string")
    assert "bucket_column" not in totals.control_totals(one) and totals.control_totals(one, "d")["bucket_column"] == "d"
    two = spark.createDataFrame([("2026-05-01", "2026-05-02"), ("2026-05-03", "2026-05-04")], "a string, b string")
    assert "bucket_column" not in totals.control_totals(two)


def test_empty_table(spark):
    got = totals.control_totals(spark.createDataFrame([], "a string, b long"))
    assert got == {"row_count": 0, "column_count": 2, "numeric_sums": {}, "date_ranges": {}, "null_counts": {}}


def test_deltas():
    a = {"row_count": 5, "column_count": 2, "numeric_sums": {"x": "1.5", "y": "2", "z": "?"}, "null_counts": {"n": 1}, "date_ranges": {}, "period_buckets": {"2026-05-01": {"row_count": 1}}}
    b = {"row_count": 3, "column_count": 2, "numeric_sums": {"x": "1", "w": "3", "z": "1"}, "null_counts": {}, "date_ranges": {"d": {"min": "a", "max": "b"}}, "period_buckets": {}}
    assert totals.totals_delta(a, b) == ["row_count 5 -> 3 (-2)", "w (added) -> 3", "x 1.5 -> 1 (-0.5)", "y 2 -> (removed)", "z ? -> 1", "null_counts[n] 1 -> 0 (-1)"]
    got = totals.structured_delta(a, b)
    assert got["numeric_sums"]["x"] == {"before": "1.5", "after": "1", "delta": "-0.5"} and got["numeric_sums"]["z"] == {"before": "?", "after": "1"}
    assert got["date_ranges"]["d"]["before"] is None and got["period_buckets_changed"] == ["2026-05-01"] and "column_count" not in got
    assert totals.structured_delta(a, a) == {}
