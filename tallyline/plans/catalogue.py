"""Named queries over the test tables, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import cells
from tallyline.operators import canonical, judge, links, runlog, totals
from tallyline.session import pin, shared_folder, written
from tallyline.sources import feeds, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(func: Query) -> Query:
        own = name or func.__name__
        QUERIES[own] = func
        if sql is not None:
            ORACLES[own] = sql
        return func

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments ---------------------------------------------------------------


def _plain(x: str) -> str:
    return f"rtrim(rtrim(CAST({x} AS DECIMAL(38,6))::VARCHAR, '0'), '.')"


def _num(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10))"


def _time(x: str) -> str:
    return f"CASE WHEN date_trunc('day', {x}) = {x} THEN strftime({x}, '%Y-%m-%d') ELSE strftime({x}, '%Y-%m-%dT%H:%M:%SZ') END"


def _day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def _totals_sql(source: str, columns: int, numeric: list[str], dates: list[str] = [], nulls: list[str] = [], bucket: str | None = None, day: str | None = None) -> str:  # noqa: B006
    parts = [f"SELECT 'row_count' AS section, '' AS period, '' AS name, count(*)::VARCHAR AS value FROM {source}", f"SELECT 'column_count', '', '', '{columns}'"]
    parts += [f"SELECT 'numeric_sums', '', '{n}', {_plain(f'sum({_num(n)})')} FROM {source}" for n in numeric]
    parts += [f"SELECT 'date_min', '', '{n}', min({_time(n)}) FROM {source} UNION ALL SELECT 'date_max', '', '{n}', max({_time(n)}) FROM {source}" for n in dates]
    parts += [f"SELECT 'null_counts', '', '{n}', (count(*) - count({n}))::VARCHAR FROM {source}" for n in nulls]
    if bucket:
        key = f"coalesce({day or _day(bucket)}, '_unbucketed')"
        parts += [f"SELECT 'bucket_column', '', '', '{bucket}'", f"SELECT 'bucket_row_count', {key}, '', count(*)::VARCHAR FROM {source} GROUP BY 2"]
        parts += [f"SELECT 'bucket_sums', {key}, '{n}', {_plain(f'coalesce(sum({_num(n)}), 0)')} FROM {source} GROUP BY 2" for n in numeric]
        parts += [f"SELECT 'bucket_nulls', {key}, '{n}', (count(*) - count({n}))::VARCHAR FROM {source} GROUP BY 2 HAVING count(*) > count({n})" for n in nulls]
    return " UNION ALL ".join(parts)


# canonical tables -------------------------------------------------------------


@query(f"SELECT o_custkey::VARCHAR AS o_custkey, {_time('o_orderdate')} AS o_orderdate, o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_orderstatus, {_plain(_num('o_totalprice'))} AS o_totalprice FROM orders")
def canonical_rows_orders(spark, sf_dir):
    return canonical.canonical_cells(t(spark, sf_dir, "orders"))


@query(f"SELECT event_id::VARCHAR AS event_id, event_type, trim(props) AS props, {_time('ts')} AS ts, user_id::VARCHAR AS user_id, {_plain(f'round_even({_num("value")}, 6)')} AS value FROM events")
def canonical_rows_events(spark, sf_dir):
    return canonical.canonical_cells(t(spark, sf_dir, "events"))


@query("SELECT l_linenumber::VARCHAR AS exponent, l_linenumber::VARCHAR AS padded, l_linenumber::VARCHAR AS signed, 'n' || l_linenumber AS word, count(*) AS n FROM lineitem GROUP BY ALL")
def canonical_numeric_text(spark, sf_dir):
    k = F.col("l_linenumber").cast("string")
    forms = t(spark, sf_dir, "lineitem").select(F.concat(k, F.lit("0e-1")).alias("Exponent"), F.concat(F.lit("  00"), k, F.lit(".000 ")).alias("padded"), F.concat(F.lit("+"), k, F.lit(".")).alias("signed"), F.concat(F.lit(" n"), k).alias("word"))
    return canonical.canonical_cells(forms).groupBy("exponent", "padded", "signed", "word").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS key, nfc_normalize(n_name || ' e' || chr(769) || chr(128512) || 'A' || chr(778)) AS text FROM nation")
def canonical_unicode(spark, sf_dir):
    wide = F.concat(F.lit("\u2003"), "n_name", F.lit(" e\u0301\U0001f600A\u030a\u00a0"))
    return canonical.canonical_cells(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), wide.alias("text")))


def _hash_sql(source: str, columns: list[str]) -> str:
    row = "'[\"' || " + " || '\",\"' || ".join(f"{c}::VARCHAR" for c in columns) + " || '\"]'"
    order = ", ".join(f"{c}::VARCHAR" for c in columns)
    return f"SELECT sha256('{{\"headers\":{json.dumps(columns, separators=(',', ':'))},\"rows\":[' || string_agg({row}, ',' ORDER BY {order}) || ']}}') AS semantic_hash FROM {source}"


@query(_hash_sql("region", ["r_name", "r_regionkey"]))
def semantic_hash_region(spark, sf_dir):
    return canonical.semantic_hash_row(t(spark, sf_dir, "region"))


@query(_hash_sql("nation", ["n_name", "n_nationkey", "n_regionkey"]))
def semantic_hash_nation(spark, sf_dir):
    return canonical.semantic_hash_row(t(spark, sf_dir, "nation"))


_CUSTOMER = f"(SELECT {_plain(_num('c_acctbal'))} AS c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer)"


@query(_hash_sql(_CUSTOMER, ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"]))
def semantic_hash_customer(spark, sf_dir):
    return spark.createDataFrame([(canonical.semantic_hash(t(spark, sf_dir, "customer")),)], "semantic_hash string")


@query(_hash_sql(f"(SELECT o_custkey, {_time('o_orderdate')} AS o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, {_plain(_num('o_totalprice'))} AS o_totalprice FROM orders)", ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]))
def semantic_hash_reordered(spark, sf_dir):
    shuffled = t(spark, sf_dir, "orders").repartition(7, F.xxhash64("o_orderkey"))
    return spark.createDataFrame([(canonical.semantic_hash(shuffled),)], "semantic_hash string")


_LINE_ROW = "'[\"' || l_linenumber || '\",\"' || l_orderkey || '\",\"' || l_partkey || '\"]'"


@query(f"SELECT count(*) AS row_count, sum(('0x' || substr(sha256({_LINE_ROW}), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS sum_a, sum(('0x' || substr(sha256({_LINE_ROW}), 16, 15))::BIGINT::HUGEINT)::VARCHAR AS sum_b FROM lineitem")
def row_fingerprint(spark, sf_dir):
    return canonical.row_fingerprint(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"))


@query("SELECT parse_filename(filename) AS file, size::BIGINT AS byte_size, sha256(content) AS evidence_hash FROM read_blob(['/root/testdata/sf0.01/region.parquet', '/root/testdata/sf0.01/nation.parquet'])")
def evidence_hash(spark, sf_dir):
    """By file name; the SQL reads the files at the scale at which results are compared."""
    found = canonical.evidence_hashes(spark, f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet")
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "byte_size", "evidence_hash")


_HIGH = "(SELECT CASE WHEN n_nationkey % 2 = 0 THEN chr(65533) ELSE chr(128512) END || n_name AS name FROM nation)"


@query(_hash_sql(_HIGH, ["name"]))
def semantic_hash_code_points(spark, sf_dir):
    """Rows sort by code points, also beyond the basic plane."""
    high = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "\ufffd").otherwise("\U0001f600"), "n_name")
    return canonical.semantic_hash_row(t(spark, sf_dir, "nation").select(high.alias("name")))


# content trees -------------------------------------------------------------------

_ORDERS_ROW = "'[\"' || o_custkey || '\",\"' || o_orderkey || '\",' || coalesce('\"' || o_orderstatus || '\"', 'null') || ',\"' || total || '\"]'"
_ORDERS = ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"]


def _tree_sql(name: str, source: str, levels: int) -> str:
    """Common tables <name>0, <name>1, ...: nodes of a tree of orders, with borders at one hexadecimal zero more for each level."""
    entry = f"SELECT o_orderkey AS low, {_ORDERS_ROW} AS row, count(*) AS rows FROM (SELECT *, {_plain(_num('o_totalprice'))} AS total FROM {source}) GROUP BY 1, 2"
    out = [f"{name}e AS (SELECT low, row, rows, sha256(row || ' ' || rows) AS digest, 64 - length(rtrim(sha256(row), '0')) AS zeros FROM ({entry}))"]
    out.append(f"{name}0 AS (SELECT p, sha256(string_agg(digest, '' ORDER BY low NULLS FIRST, row)) AS digest, arg_min(zeros, (low, row)) AS zeros, sum(rows)::BIGINT AS rows, min(low) AS low FROM (SELECT *, sum((zeros >= 1)::INT) OVER (ORDER BY low NULLS FIRST, row ROWS UNBOUNDED PRECEDING)::BIGINT AS p FROM {name}e) GROUP BY p)")
    for k in range(1, levels):
        out.append(f"{name}{k} AS (SELECT up AS p, sha256(string_agg(digest, '' ORDER BY p)) AS digest, arg_min(zeros, p) AS zeros, sum(rows)::BIGINT AS rows, min(low) AS low FROM (SELECT *, sum((zeros >= {k + 1})::INT) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)::BIGINT AS up FROM {name}{k - 1}) GROUP BY up HAVING (SELECT count(*) FROM {name}{k - 1}) > 1)")
    return ", ".join(out)


@query(f"WITH {_tree_sql('t', 'orders', 9)} " + " UNION ALL ".join(f"SELECT {k} AS level, p AS at, digest, rows, low FROM t{k}" for k in range(9)))
def tree_hash_orders(spark, sf_dir):
    from tallyline.operators import tree

    nodes = tree.tree(t(spark, sf_dir, "orders").select(*_ORDERS).repartition(5), ["o_orderkey"], leaf=1, fan=1)
    return nodes.select("level", "at", "digest", "rows", F.col("low.o_orderkey").alias("low"))


#: Orders of which some lost their status, and some are gone.
_MOVED = "(SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT BETWEEN 500 AND 520)"


@query(f"WITH {_tree_sql('a', 'orders', 1)}, {_tree_sql('b', _MOVED, 1)} SELECT 'a' AS side, low, rows FROM a0 WHERE digest NOT IN (SELECT digest FROM b0) UNION ALL SELECT 'b', low, rows FROM b0 WHERE digest NOT IN (SELECT digest FROM a0)")
def tree_differences(spark, sf_dir):
    from tallyline.operators import tree

    orders = t(spark, sf_dir, "orders").select(*_ORDERS)
    moved = orders.withColumn("o_orderstatus", F.when(F.col("o_custkey") % 101 != 0, F.col("o_orderstatus"))).filter("o_orderkey not between 500 and 520")
    found = tree.differences(*[tree.tree(df, ["o_orderkey"], leaf=1, fan=1) for df in (orders, moved)])
    return found.select("side", F.col("low.o_orderkey").alias("low"), "rows")


# control totals ----------------------------------------------------------------

_TABLES = {
    "orders": (6, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderdate"], "o_orderdate"),
    "lineitem": (11, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_shipdate"], "l_shipdate"),
    "events": (6, ["event_id", "user_id", "value"], ["ts"], "ts"),
    "customer": (5, ["c_custkey", "c_nationkey", "c_acctbal"], [], None),
    "part": (6, ["p_partkey", "p_size", "p_retailprice"], [], None),
}
for _name, (_n, _numeric, _dates, _bucket) in _TABLES.items():
    query(_totals_sql(_name, _n, _numeric, _dates, bucket=_bucket), f"totals_long_{_name}")(lambda spark, sf_dir, name=_name: totals.long_totals(t(spark, sf_dir, name)))
    if _bucket:
        _sums = ", ".join(f"{_plain(f'sum({_num(n)})')} AS {n}" for n in _numeric)

        def _buckets(spark, sf_dir, name=_name, numeric=tuple(_numeric), bucket=_bucket):
            found = totals.period_buckets(totals.Plan(t(spark, sf_dir, name)), bucket, list(numeric))
            return found.select("period", "row_count", *[cells.plain_text(F.col(f"sum_{i}")).alias(n) for i, n in enumerate(numeric)])

        query(f"SELECT {_day(_bucket)} AS period, count(*) AS row_count, {_sums} FROM {_name} GROUP BY 1", f"period_buckets_{_name}")(_buckets)


_INJECTED = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"


@query(_totals_sql(_INJECTED, 3, ["o_orderkey", "o_totalprice"], nulls=["o_orderstatus", "o_totalprice"]))
def null_counts_injected(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return totals.long_totals(df)


_MIXED = "(SELECT CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderkey END AS over, o_orderkey FROM orders)"


@query(f"SELECT 'row_count' AS section, '' AS period, '' AS name, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'column_count', '', '', '3' UNION ALL SELECT 'numeric_sums', '', 'over', {_plain('sum(over)')} FROM {_MIXED} UNION ALL SELECT 'numeric_sums', '', 'key', {_plain('sum(o_orderkey)')} FROM orders")
def type_threshold(spark, sf_dir):
    key = F.col("o_orderkey")
    text = lambda n: F.when(key % n == 0, "n/a").otherwise(key.cast("string"))
    return totals.long_totals(t(spark, sf_dir, "orders").select(key.alias("key"), text(20).alias("over"), text(5).alias("under")))


@query(f"SELECT 'l_shipdate' AS name, min({_time('l_shipdate')}) AS least, max({_time('l_shipdate')}) AS most FROM lineitem")
def date_ranges_lineitem(spark, sf_dir):
    _, found, _ = totals.profile(t(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(n, x["least"], x["most"]) for n, x in found.items() if x["least"]], "name string, least string, most string")


def _bucket_sql(source: str, dates: list[str], texts: list[str]) -> str:
    """The only column of which nine tenths are days, if it spans two of them."""
    days = [f"SELECT '{c}' AS name, CAST({c} AS DATE)::VARCHAR AS day, {c} IS NOT NULL AS filled FROM {source}" for c in dates]
    days += [f"SELECT '{c}' AS name, CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr({c}, 1, 10) END AS day, {c} IS NOT NULL AS filled FROM {source}" for c in texts]
    found = f"SELECT name, min(day) AS low, max(day) AS high FROM ({' UNION ALL '.join(days)}) GROUP BY 1 HAVING 10 * count(day) >= 9 * count_if(filled) AND count_if(filled) > 0"
    return f"SELECT '{source}' AS source, (SELECT CASE WHEN count(*) = 1 AND min(low) <> max(high) THEN min(name) END FROM ({found})) AS bucket"


_DAYS = [("orders", ["o_orderdate"], ["o_orderstatus", "o_orderpriority"]), ("lineitem", ["l_shipdate"], ["l_returnflag", "l_linestatus"]), ("events", ["ts"], ["event_type", "props"]), ("customer", [], ["c_name", "c_mktsegment"])]


@query(" UNION ALL ".join(_bucket_sql(*x) for x in _DAYS))
def bucket_detect(spark, sf_dir):
    rows = [(n, totals.resolve_bucket(totals.profile(t(spark, sf_dir, n))[1], None)) for n in ("orders", "lineitem", "events", "customer")]
    return spark.createDataFrame(rows, "source string, bucket string")


def _events_text(spark, sf_dir, bad: int):
    """Event times as ISO text, some of them no dates."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t(spark, sf_dir, "events").select(F.when(F.col("event_id") % bad == 0, "soon").otherwise(ts).alias("happened"), "event_id")


@query(_totals_sql("(SELECT CASE WHEN event_id % 20 = 0 THEN NULL ELSE ts END AS happened, event_id FROM events)", 2, ["event_id"], bucket="happened"))
def period_buckets_unbucketed(spark, sf_dir):
    return totals.long_totals(_events_text(spark, sf_dir, 20))


@query("SELECT strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d') AS period, count(*) AS row_count FROM events GROUP BY 1")
def period_buckets_iso_text_offset(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30"))
    plan = totals.Plan(t(spark, sf_dir, "events").select(text.alias("at")))
    return totals.period_buckets(plan, "at", []).select("period", "row_count")


@query(f"SELECT count(*) AS row_count, {_plain(f'sum({_num("value")})')} AS value FROM events")
def buckets_sum_to_totals(spark, sf_dir):
    found = totals.period_buckets(totals.Plan(t(spark, sf_dir, "events")), "ts", ["value"])
    return found.agg(F.sum("row_count").alias("row_count"), cells.plain_text(F.sum("sum_0").cast(cells.DEC)).alias("value"))


@query("SELECT 'amount' AS \"column\", min(format('{:,}', (1000 + o_orderkey)::BIGINT)) AS example FROM orders")
def grouped_numeric(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select(F.format_number(F.col("o_orderkey") + 1000, 0).alias("amount"))
    return spark.createDataFrame([(x["column"], x["example"]) for x in totals.grouped_numeric_columns(df)], "column string, example string")


def _delta_sql(before: str, after: str) -> str:
    return (
        f"WITH a AS ({before}), b AS ({after}), j AS (SELECT coalesce(a.section, b.section) AS section, coalesce(a.period, b.period) AS period, coalesce(a.name, b.name) AS name, a.value AS before, b.value AS after "
        f"FROM a FULL JOIN b ON a.section = b.section AND a.period = b.period AND a.name = b.name) SELECT *, {_plain('try_cast(after AS DECIMAL(38,6)) - try_cast(before AS DECIMAL(38,6))')} AS delta FROM j WHERE before IS DISTINCT FROM after"
    )


_KEPT = "(SELECT * FROM orders WHERE o_orderstatus <> 'F')"


@query(_delta_sql(_totals_sql("orders", *_TABLES["orders"][:3], bucket="o_orderdate"), _totals_sql(_KEPT, *_TABLES["orders"][:3], bucket="o_orderdate")))
def totals_delta_filter(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    return totals.delta_rows(totals.long_totals(orders), totals.long_totals(orders.filter("o_orderstatus <> 'F'")))


_EVENTS, _FEWER = "events", "(SELECT * FROM events WHERE event_id % 10 <> 0)"


def _structured_sql() -> str:
    """Moved counts, sums and date ranges of events without a tenth of them, and the days whose totals moved."""
    both = lambda x: f"(SELECT {x} FROM {_EVENTS}) AS before, (SELECT {x} FROM {_FEWER}) AS after"
    parts = [f"SELECT 'row_count' AS section, '' AS name, {both('count(*)::VARCHAR')}"]
    parts += [f"SELECT 'numeric_sums', '{n}', {both(_plain(f'sum({_num(n)})'))}" for n in ("event_id", "user_id", "value")]
    spans = f"min({_time('ts')}) || ' ' || max({_time('ts')})"
    parts.append(f"SELECT 'date_ranges', 'ts', {both(spans)}")
    days = f"SELECT {_day('ts')} AS day, count(*) AS n FROM {{}} GROUP BY 1"
    parts.append(f"SELECT 'period_buckets_changed', day, NULL, NULL FROM ({days.format(_EVENTS)}) a FULL JOIN ({days.format(_FEWER)}) b USING (day) WHERE a.n IS DISTINCT FROM b.n")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE section = 'period_buckets_changed' OR before IS DISTINCT FROM after"


@query(_structured_sql())
def structured_delta(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    found = totals.structured_delta(totals.control_totals(events), totals.control_totals(events.filter("event_id % 10 <> 0")))
    text = lambda v: f"{v['min']} {v['max']}" if isinstance(v, dict) else str(v)
    rows = [(k, "", text(found[k]["before"]), text(found[k]["after"])) for k in ("row_count", "column_count") if k in found]
    rows += [(k, n, text(v["before"]), text(v["after"])) for k in ("numeric_sums", "null_counts", "date_ranges") for n, v in found.get(k, {}).items()]
    rows += [("period_buckets_changed", day, None, None) for day in found.get("period_buckets_changed", [])]
    return spark.createDataFrame(rows, "section string, name string, before string, after string")


# stages and joins ------------------------------------------------------------------


@query(f"SELECT event_id, event_type, {_plain(f'round_even({_num("value")}, 6)')} AS value FROM events WHERE event_type <> 'click'")
def stage_clean(spark, sf_dir):
    kept = t(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("click"))).filter(F.trim("event_type") != "")
    return kept.select("event_id", "event_type", cells.canonical(F.col("value").cast("string"), kept.schema["event_type"].dataType).alias("value"))


@query(f"SELECT l_returnflag, {_day('l_shipdate')} AS day, {_plain(f'sum({_num("l_quantity")})')} AS quantity, {_plain(f'sum({_num("l_extendedprice")})')} AS price FROM lineitem GROUP BY 1, 2")
def stage_aggregate(spark, sf_dir):
    lineitem = t(spark, sf_dir, "lineitem")
    plan = totals.Plan(lineitem.select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice"))
    facts = plan.facts(["l_quantity", "l_extendedprice"], [], ["l_returnflag", "l_shipdate"])
    sums = facts.groupBy(F.col(f"v{plan.at['l_returnflag']}").alias("l_returnflag"), F.col(f"v{plan.at['l_shipdate']}").cast("date").alias("day")).agg(*[x for n in ("l_quantity", "l_extendedprice") for x in plan.sums(n)])
    return sums.select("l_returnflag", F.date_format("day", "yyyy-MM-dd").alias("day"), *[cells.plain_text(plan.total(n)).alias(a) for n, a in (("l_quantity", "quantity"), ("l_extendedprice", "price"))])


_FAN = "(SELECT n.n_nationkey, r.r_regionkey FROM nation n LEFT JOIN (SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey = 1) r ON n.n_regionkey = r.r_regionkey)"


@query(_delta_sql(_totals_sql("(SELECT n_nationkey FROM nation)", 1, ["n_nationkey"]), _totals_sql(_FAN, 2, ["n_nationkey", "r_regionkey"])))
def join_fanout_delta(spark, sf_dir):
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region").select("r_regionkey")
    twice = region.unionAll(region.filter("r_regionkey = 1"))
    joined = nation.join(twice, nation["n_regionkey"] == twice["r_regionkey"], "left").select("n_nationkey", "r_regionkey")
    return totals.delta_rows(totals.long_totals(nation.select("n_nationkey")), totals.long_totals(joined))


# chains: one chain for each customer, a receipt for each of its orders ------------------

_RECEIPTS = "(SELECT o_custkey AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderkey, o_orderstatus, o_orderkey % 50 AS row_count FROM orders)"


def _chains(spark, sf_dir):
    """Receipts whose input doesn't refer to the one before where the order's status is P; every thirteenth number is skipped."""
    from pyspark.sql import Window

    placed = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("position"), "o_orderkey", "o_orderstatus")
    before = F.lag("o_orderkey").over(Window.partitionBy("chain").orderBy("position"))
    odd = F.col("o_orderstatus") == "P"
    return placed.select(
        "chain", "position", F.format_string("%03d_step.json", F.col("position") + F.floor(F.col("position") / 13)).alias("name"),
        F.sha2(F.concat(F.when(odd, "x").otherwise(""), before.cast("string")), 256).alias("input_hash"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("output_hash"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).alias("row_count"),
    )


@query(f"WITH r AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY chain ORDER BY position) AS before FROM {_RECEIPTS}), s AS (SELECT * FROM r WHERE position > 0) SELECT chain, position, printf('%03d_step.json', position + position // 13) AS name, sha256(before::VARCHAR) AS expected, sha256(CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END || before) AS found, o_orderstatus = 'P' AS broken, coalesce(position = min(CASE WHEN o_orderstatus = 'P' THEN position END) OVER (PARTITION BY chain), false) AS first_broken FROM s")
def chain_links(spark, sf_dir):
    return links.link_check(_chains(spark, sf_dir))


@query(f"SELECT chain, position, printf('numbering jumps %03d -> %03d', position + position // 13 - 2, position + position // 13) AS gap FROM {_RECEIPTS} WHERE position > 0 AND position % 13 = 0")
def coverage_gaps(spark, sf_dir):
    return links.coverage_gaps(_chains(spark, sf_dir))


@query(f"WITH r AS (SELECT *, 'c' || (o_orderkey % 12) AS col FROM {_RECEIPTS}), g AS (SELECT chain, min(position) AS gap FROM r WHERE position > 0 AND position % 13 = 0 GROUP BY 1), f AS (SELECT chain, col, min(position) AS first FROM r GROUP BY ALL) SELECT f.chain, f.col AS \"column\", f.first FROM f JOIN g USING (chain) WHERE f.first >= g.gap")
def gap_columns(spark, sf_dir):
    from pyspark.sql import Window

    placed = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("position"), F.concat(F.lit("c"), F.col("o_orderkey") % 12).alias("column"))
    return links.gap_columns(placed, links.coverage_gaps(_chains(spark, sf_dir)))


_GRID = "SELECT 'row_count' AS metric, count(*)::VARCHAR AS expected, count(*) FILTER (p_size <> 7)::VARCHAR AS found FROM part UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', {_plain(f'sum({_num(c)})')}, {_plain(f'sum({_num(c)}) FILTER (p_size <> 7)')} FROM part" for c in ("p_partkey", "p_size", "p_retailprice"))


@query(f"WITH g AS ({_GRID}) SELECT *, {_plain('found::DECIMAL(38,6) - expected::DECIMAL(38,6)')} AS delta FROM g")
def break_grid(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    return links.break_grid(totals.long_totals(part), totals.long_totals(part.filter("p_size <> 7")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM part HAVING {_num_sum} IS DISTINCT FROM {_num_sum} FILTER (p_size <> 7)" for c in ("p_partkey", "p_size", "p_retailprice") for _num_sum in (f"sum({_num(c)})",)))
def changed_columns(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    return links.changed_columns(totals.long_totals(part), totals.long_totals(part.filter("p_size <> 7")))


@query(f"WITH r AS (SELECT chain, position, CASE WHEN o_orderkey % 3 <> 0 THEN row_count END AS rows FROM {_RECEIPTS}) SELECT chain, position, printf('%03d_step.json', position + position // 13) AS name, rows AS row_count, rows - last_value(rows IGNORE NULLS) OVER (PARTITION BY chain ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS row_delta FROM r")
def timeline_row_delta(spark, sf_dir):
    return links.row_deltas(_chains(spark, sf_dir))


@query(f"SELECT chain, position FROM (SELECT chain, position, row_count, lag(row_count) OVER (PARTITION BY chain ORDER BY position) AS before FROM {_RECEIPTS}) WHERE position > 0 AND row_count <> before")
def drift(spark, sf_dir):
    from pyspark.sql import Window

    placed = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("position"), (F.col("o_orderkey") % 50).cast("string").alias("value"))
    return links.totals_drift(placed.select("chain", "position", F.lit("row_count").alias("section"), F.lit("").alias("name"), "value"))


@query("SELECT s_nationkey::BIGINT AS chain, s_name AS name, s_suppkey::VARCHAR AS recorded, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey + 1)::VARCHAR END AS actual FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0")
def receipt_file_mismatch(spark, sf_dir):
    base = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("chain"), F.col("s_name").alias("name"), "s_suppkey")
    actual = base.filter("s_suppkey % 5 <> 0").select("chain", "name", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey") + 1).otherwise(F.col("s_suppkey")).cast("string").alias("hash"))
    return links.file_mismatches(base.select("chain", "name", F.col("s_suppkey").cast("string").alias("hash")), actual)


@query("SELECT a.c_custkey::VARCHAR AS hash, a.c_mktsegment AS target, CASE WHEN a.c_custkey % 4 = 0 THEN (a.c_custkey - 1)::VARCHAR END AS supersedes, a.c_name AS created_at, (a.c_custkey + 1) % 4 = 0 AND EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey + 1) AS superseded FROM customer a")
def annotations_superseded(spark, sf_dir):
    key = F.col("c_custkey")
    notes = t(spark, sf_dir, "customer").select(key.cast("string").alias("hash"), F.col("c_mktsegment").alias("target"), F.when(key % 4 == 0, (key - 1).cast("string")).alias("supersedes"), F.col("c_name").alias("created_at"))
    return links.superseded(notes)


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def annotations_on_receipts(spark, sf_dir):
    notes = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), "o_orderpriority")
    held = t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("output_hash"))
    return links.on_receipts(notes, held).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# judgment: run k of ten holds the events that had arrived by then -------------------------


def _observations(spark, sf_dir, runs: int, share: str, created: str):
    """(run, created, bucket, metric, value) of row counts and sums by day; share: which events run k has."""
    events = t(spark, sf_dir, "events").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).filter(share)
    by_day = events.groupBy("k", F.date_format("ts", "yyyy-MM-dd").alias("bucket")).agg(F.count("*").cast(judge.VALUE).alias("row_count"), F.sum("user_id").cast(judge.VALUE).alias("user_id"))
    long = by_day.select("k", "bucket", F.explode(F.create_map(F.lit("row_count"), F.col("row_count"), F.lit("user_id"), F.col("user_id"))).alias("metric", "value"))
    return long.select(F.format_string("r%02d", "k").alias("run"), F.expr(f"timestamp '{created}' + make_dt_interval(k)").alias("created"), "bucket", "metric", "value", "k")


def _judge_sql(runs: int, share: str, created: str, band: str, settle: int, flagged: str = "false") -> str:
    observed = f"""o AS (SELECT k, 'r' || printf('%02d', k) AS run, TIMESTAMP '{created}' + to_days(k::INTEGER) AS created, strftime(ts, '%Y-%m-%d') AS bucket, count(*)::DECIMAL(26,6) AS rc, sum(user_id)::DECIMAL(26,6) AS us FROM events, range({runs}) g(k) WHERE {share} GROUP BY ALL),
    l AS (SELECT k, run, created, bucket, 'row_count' AS metric, rc AS value FROM o UNION ALL SELECT k, run, created, bucket, 'user_id', us FROM o),
    cur AS (SELECT bucket, metric, value, created FROM l WHERE k = {runs - 1}),
    h AS (SELECT * FROM l WHERE k < {runs - 1}),"""
    return f"""WITH {observed}
    z AS (SELECT c.bucket, c.metric, c.value AS after, c.created AS now, max(h.created) AS latest, CAST(c.bucket AS DATE) + INTERVAL 1 DAY + INTERVAL {settle} HOUR AS deadline,
      arg_max(h.value, h.created) FILTER (NOT ({flagged})) AS last, arg_min(h.value, h.created) FILTER (NOT ({flagged})) AS first, min(h.created) FILTER (NOT ({flagged})) AS first_created,
      arg_min(h.value, h.created) FILTER (NOT ({flagged}) AND h.created > CAST(c.bucket AS DATE) + INTERVAL 1 DAY + INTERVAL {settle} HOUR) AS settled
      FROM cur c JOIN h USING (bucket, metric) GROUP BY ALL),
    d AS (SELECT *, latest > deadline AS frozen, latest <= deadline AND now > deadline + INTERVAL {settle} HOUR AS refrozen,
      greatest(1, least(ceil(epoch(now - first_created) / 86400.0), greatest(1, ceil({settle} / 24.0))))::INTEGER AS days FROM z WHERE last IS NOT NULL),
    e AS (SELECT *, CASE WHEN last = 0 THEN after <> 0 ELSE abs(after - last) > {band} * abs(last) END AS step, CASE WHEN first = 0 THEN after <> 0 ELSE abs(after - first) > {band} * days * abs(first) END AS total FROM d)
    SELECT CASE WHEN frozen OR refrozen THEN 'settled_movement' ELSE 'band_breach' END AS type, metric, bucket AS period,
      {_plain("CASE WHEN frozen THEN coalesce(settled, last) WHEN refrozen OR step THEN last ELSE first END")} AS before, {_plain("after")} AS after
    FROM e WHERE CASE WHEN frozen THEN after <> coalesce(settled, last) WHEN refrozen THEN after <> last ELSE step OR total END"""


def _judged(spark, sf_dir, runs, share, created, band, settle, flagged=None):
    seen = _observations(spark, sf_dir, runs, share, created)
    last = dt.datetime.fromisoformat(created).replace(tzinfo=dt.timezone.utc) + dt.timedelta(days=runs - 1)
    history = seen.filter(F.col("k") < runs - 1)
    marked = history.filter(flagged or "false").select("run", "bucket", "metric")
    return judge.breaches(history.drop("k"), marked, seen.filter(F.col("k") == runs - 1).select("bucket", "metric", "value"), Decimal(band), settle, last)


_CASES = {
    # late rows trickle in while most days settle; band wide and narrow
    "judge_settling_band": (10, "event_id % 10 <= k", "2024-01-20 06:00:00", "0.05", 240, None),
    "judge_cumulative": (10, "event_id % 40 <= 30 + k", "2024-01-25 06:00:00", "0.03", 240, None),
    "judge_settled_frozen": (10, "event_id % 10 <= k", "2024-02-20 00:00:00", "0.05", 72, None),
    "judge_refreeze": (3, "event_id % 10 <= 7 + k", "2024-02-01 00:00:00", "0.5", 24, None),
    "judge_tainted_baseline": (10, "event_id % 10 <= k", "2024-01-20 06:00:00", "0.05", 240, "k % 3 = 1"),
}
for _case, (_runs, _share, _created, _band, _settle, _flag) in _CASES.items():
    query(_judge_sql(_runs, _share, _created, _band, _settle, (f"h.{_flag}" if _flag else "false")), _case)(
        lambda spark, sf_dir, own=(_runs, _share, _created, _band, _settle, _flag): _judged(spark, sf_dir, *own).select("type", "metric", "period", *[cells.plain_text(F.col(c).cast(cells.DEC)).alias(c) for c in ("before", "after")])
    )


@query(_judge_sql(*_CASES["judge_tainted_baseline"][:5], "h.k % 3 = 1"))
def judge_folded_baseline(spark, sf_dir):
    """The same runs folded into a state one by one, the last judged against the state alone."""
    from tallyline.operators import baseline

    runs, share, created, band, settle, flag = _CASES["judge_tainted_baseline"]
    seen = written(_observations(spark, sf_dir, runs, share, created), "observations")
    at = lambda k: dt.datetime.fromisoformat(created).replace(tzinfo=dt.timezone.utc) + dt.timedelta(days=k)
    state = baseline.empty(spark)
    for k in range(runs - 1):
        own = seen.filter(F.col("k") == k)
        state = written(baseline.fold(state, own.select("bucket", "metric", "value"), own.filter(flag).select("bucket", "metric"), f"r{k:02d}", at(k), settle), "baseline")
    found = baseline.judged(state, seen.filter(F.col("k") == runs - 1).select("bucket", "metric", "value"), Decimal(band), settle, at(runs - 1))
    return found.select("type", "metric", "period", *[cells.plain_text(F.col(c).cast(cells.DEC)).alias(c) for c in ("before", "after")])


_WORST = """WITH j AS ({judged}), n AS (SELECT *, before::DECIMAL(26,6) AS b, after::DECIMAL(26,6) AS a FROM j),
    w AS (SELECT type, metric, period, before, after, count(*) OVER (PARTITION BY type, metric) AS periods, row_number() OVER (PARTITION BY type, metric ORDER BY type = 'band_breach' AND b = 0 DESC,
      CASE WHEN type = 'settled_movement' THEN abs(a - b)::DOUBLE WHEN b <> 0 THEN abs(a - b) / abs(b) END DESC NULLS LAST, period) AS n FROM n)
    SELECT type, metric, period, before, after, periods FROM w WHERE n = 1"""


@query(_WORST.format(judged=_judge_sql(*_CASES["judge_settling_band"][:5])))
def judge_flood_control(spark, sf_dir):
    found = judge.worst(_judged(spark, sf_dir, *_CASES["judge_settling_band"]))
    return found.select("type", "metric", "period", *[cells.plain_text(F.col(c).cast(cells.DEC)).alias(c) for c in ("before", "after")], "periods")


@query(f"WITH j AS ({_judge_sql(*_CASES['judge_settling_band'][:5])}) SELECT period, string_agg(metric, ',' ORDER BY metric) AS metrics FROM j GROUP BY 1")
def breached_map(spark, sf_dir):
    return judge.breached_map(_judged(spark, sf_dir, *_CASES["judge_settling_band"])).select("period", F.array_join("metrics", ",").alias("metrics"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS period, {_plain('count(*)')} AS before FROM events WHERE strftime(ts, '%d') IN ('07', '12') GROUP BY 1")
def judge_removed_interior(spark, sf_dir):
    seen = _observations(spark, sf_dir, 1, "true", "2024-02-01 00:00:00").select("bucket", "metric", "value")
    return judge.removed(seen, seen.filter(~F.substring("bucket", 9, 2).isin("07", "12", "30"))).select("period", cells.plain_text(F.col("before").cast(cells.DEC)).alias("before"))


@query("SELECT 'band_breach' AS type, 'row_count' AS metric, 'whole-table' AS period, count(*) FILTER (event_id % 10 <= 7)::VARCHAR AS before, count(*)::VARCHAR AS after FROM events")
def judge_flat_band(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    rows = lambda cond: events.filter(cond).agg(F.count("*").cast(judge.VALUE).alias("value")).select(F.lit(judge.WHOLE_TABLE).alias("bucket"), F.lit("row_count").alias("metric"), "value")
    history = rows("event_id % 10 <= 7").select(F.lit("r0").alias("run"), F.lit(dt.datetime(2024, 2, 1)).alias("created"), "bucket", "metric", "value")
    nothing = spark.createDataFrame([], "run string, bucket string, metric string")
    found = judge.breaches(history, nothing, rows("true"), Decimal("0.05"), 72, dt.datetime(2024, 2, 2), flat=True)
    return found.select("type", "metric", "period", *[cells.plain_text(F.col(c).cast(cells.DEC)).alias(c) for c in ("before", "after")])


# run history --------------------------------------------------------------------------------


@query("WITH a AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS position, count(*) AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1), b AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS position, count(*) FILTER (p_size > 10) AS n FROM part WHERE p_brand <> 'Brand#12' GROUP BY 1) SELECT row_number() OVER (ORDER BY a.position NULLS LAST, b.position NULLS LAST) AS at, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN a.name IS NULL THEN 'added' ELSE 'both' END AS presence, a.n AS row_count_a, b.n AS row_count_b, b.n - a.n AS row_delta, a.n IS DISTINCT FROM b.n AS code_changed FROM a FULL JOIN b ON a.name = b.name")
def run_diff_stages(spark, sf_dir):
    from pyspark.sql import Window

    part = t(spark, sf_dir, "part")

    def stages(df, count):
        found = df.groupBy(F.col("p_brand").alias("name")).agg(count.alias("row_count"))
        return found.withColumns({"position": F.row_number().over(Window.orderBy("name")), "code_hash": F.col("row_count").cast("string")})

    a = stages(part.filter("p_brand <> 'Brand#11'"), F.count("*"))
    b = stages(part.filter("p_brand <> 'Brand#12'"), F.count_if(F.col("p_size") > 10))
    return runlog.stage_diff(a, b).withColumn("at", F.col("at").cast("long"))


_PERIODS = {"day": "strftime(o_orderdate, '%Y-%m-%d')", "week": "strftime(o_orderdate, '%G-W%V')", "month": "strftime(o_orderdate, '%Y-%m')", "quarter": "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)"}
for _g, _key in _PERIODS.items():
    query(
        f"WITH p AS (SELECT {_key} AS period, count(*) AS runs, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END, (o_orderdate, printf('%012d', o_orderkey))) AS v FROM orders GROUP BY 1), q AS (SELECT period, runs, nullif(v, -1) AS value FROM p) "
        "SELECT period, runs, value, value - last_value(value IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM q",
        f"run_log_{_g}",
    )(lambda spark, sf_dir, g=_g: runlog.log(t(spark, sf_dir, "orders").select(F.format_string("%012d", "o_orderkey").alias("body_hash"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("value")), g))


@query("SELECT o_orderkey::VARCHAR AS body_hash, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC LIMIT 1")
def latest_run(spark, sf_dir):
    return runlog.latest(t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("body_hash"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created")))


def _days(spark, sf_dir, cond: str):
    return t(spark, sf_dir, "events").filter(cond).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("row_count"))


@query("SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-26'")
def new_period_count(spark, sf_dir):
    return runlog.new_periods(_days(spark, sf_dir, "true"), _days(spark, sf_dir, "ts < '2024-01-26'")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '2024-01-26') AS new_periods, count(DISTINCT CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '2024-01-26') > 3 AS capped FROM events")
def rate_cap(spark, sf_dir):
    from tallyline.streaming.watch import new_rows_or_periods

    events = t(spark, sf_dir, "events").select("ts", "event_id")
    sides = {k: {"kind": "source_manifest", "control_totals": totals.control_totals(df)} for k, df in (("committed", events.filter("ts < '2024-01-26'")), ("manifest", events))}
    n = new_rows_or_periods(sides)
    return spark.createDataFrame([(n, n > 3)], "new_periods long, capped boolean")


@query("WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1), b AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events WHERE NOT (strftime(ts, '%d') = '09' AND event_id % 2 = 0) GROUP BY 1) SELECT coalesce(a.period, b.period) AS period, a.n AS before, b.n AS after FROM a FULL JOIN b ON a.period = b.period WHERE a.n IS DISTINCT FROM b.n")
def moved_periods(spark, sf_dir):
    return runlog.moved_periods(_days(spark, sf_dir, "ts >= '2024-01-03'"), _days(spark, sf_dir, "not (day(ts) = 9 and event_id % 2 = 0)"))


_NATION = ["n_name", "n_nationkey", "n_regionkey"]


@query(f"SELECT a.semantic_hash = b.semantic_hash AS same, a.semantic_hash = c.semantic_hash AS changed FROM ({_hash_sql('nation', _NATION)}) a, ({_hash_sql('(SELECT * FROM nation ORDER BY n_nationkey DESC)', _NATION)}) b, ({_hash_sql('(SELECT * FROM nation WHERE n_nationkey <> 3)', _NATION)}) c")
def noop_gate(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    h = [canonical.semantic_hash(df) for df in (nation, nation.repartition(3).select(*reversed(nation.columns)), nation.filter("n_nationkey <> 3"))]
    return spark.createDataFrame([(h[0] == h[1], h[0] == h[2])], "same boolean, changed boolean")


# feeds and files ------------------------------------------------------------------------------


@query("SELECT event_id::VARCHAR AS id, event_type AS kind FROM events")
def columnar_zip(spark, sf_dir):
    arrays = t(spark, sf_dir, "events").groupBy(F.pmod("event_id", F.lit(64)).alias("g")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("x"))
    return feeds.zip_columns(arrays.select(F.col("x.event_id").alias("ids"), F.col("x.event_type").alias("kinds")), {"id": "ids", "kind": "kinds"})


@query("SELECT n_name AS nation, n_regionkey::VARCHAR AS region FROM nation")
def feed_field_map(spark, sf_dir):
    lines = t(spark, sf_dir, "nation").select(F.to_json(F.struct("n_name", "n_regionkey", "n_nationkey")).alias("value"))
    return feeds.map_records(lines, {"nation": "n_name", "region": "n_regionkey"})


@query("SELECT o_orderkey::VARCHAR AS id, o_orderkey || '.50' AS price, '-' || o_custkey || 'e-3' AS small, 'of 7, ' || o_orderpriority AS note, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'true' END AS flag FROM orders")
def feed_numbers_as_written(spark, sf_dir):
    """Feed objects in arrays of several, with numbers that no parser gives back as they were."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", F.format_string('{"id": %d, "price": %d.50, "small": -%de-3, "note": "of 7, %s", "flag": %s}', "o_orderkey", "o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "null").otherwise("true")).alias("one"))
    pages = orders.groupBy(F.expr("o_orderkey div 40").alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("value"))
    return feeds.map_records(pages, {n: n for n in ("id", "price", "small", "note", "flag")})


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'https://example.org/' || o_orderkey ELSE 'urn:' || o_orderkey END AS id, o_orderpriority || ' <&> é' AS title, CASE WHEN (o_orderkey // 40) % 2 = 1 OR o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS published FROM orders")
def feed_entries(spark, sf_dir):
    """Feeds of several entries, every second one Atom, the others RSS."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.expr("o_orderkey div 40").alias("page"))
    k = F.col("o_orderkey")
    title = F.concat(F.lit("<title>"), "o_orderpriority", F.lit(" &lt;&amp;&gt; é </title>"))
    rss = F.concat(F.lit("<item>"), F.when(k % 5 == 0, F.format_string("<link>https://example.org/%d</link>", k)).otherwise(F.format_string('<guid isPermaLink="false">urn:%d</guid><link>https://example.org/x</link>', k)), title, F.when(k % 7 != 0, F.concat(F.lit("<pubDate>"), "day", F.lit("</pubDate>"))).otherwise("<pubDate/>"), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), F.when(k % 5 == 0, F.format_string('<link rel="self" href="https://example.org/%d"/>', k)).otherwise(F.format_string("<id> urn:%d </id>", k)), title, F.when(k % 7 == 0, F.concat(F.lit("<updated>"), "day", F.lit("</updated>"))).otherwise(F.concat(F.lit("<published>"), "day", F.lit("</published>"))), F.lit("</entry>"))
    one = F.when(F.col("page") % 2 == 0, rss).otherwise(atom)
    pages = orders.groupBy("page").agg(F.array_join(F.collect_list(one), "").alias("x"))
    value = F.when(F.col("page") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>of all</title>'), "x", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>of all</title>'), "x", F.lit("</feed>")))
    return feeds.map_entries(pages.select(value.alias("value")))


def _read_array(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an export as one array in a file of its own, read as such."""
    lines = spark.read.text(path).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    lines.coalesce(1).write.text(f"{path}-array")
    return readers.read_json(spark, f"{path}-array")


def _round_trip(kind: str) -> Query:
    def run(spark, sf_dir):
        import uuid

        from tallyline.sources.writers import export

        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallyline_work/{kind}-{uuid.uuid4().hex}"
        export(t(spark, sf_dir, "supplier"), path, kind)
        read = {"csv": readers.read_csv, "tsv": readers.read_tsv, "ndjson": readers.read_ndjson, "json": _read_array}[kind]
        return canonical.canonical_cells(read(spark, path))

    return run


for _kind in ("csv", "tsv", "ndjson", "json"):
    query(f"SELECT {_plain(_num('s_acctbal'))} AS s_acctbal, s_name, s_nationkey::VARCHAR AS s_nationkey, s_suppkey::VARCHAR AS s_suppkey FROM supplier", f"source_{_kind}_roundtrip")(_round_trip(_kind))


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS row_count FROM events GROUP BY 1")
def stream_day_buckets(spark, sf_dir):
    """The events table replayed as a stream of files, counted by day."""
    import uuid

    from tallyline.streaming.watch import day_buckets

    schema = t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"days_{uuid.uuid4().hex}"
    found = day_buckets(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", [])
    run = found.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _work(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Every event arrives an hour after it happened, but those whose number is a multiple of 97 five days after.
_ARRIVED = "ts + CASE WHEN event_id % 97 = 0 THEN INTERVAL 5 DAY ELSE INTERVAL 1 HOUR END"
_LATE = f"""WITH e AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS period, {_ARRIVED} AS arrived, {_num('value')} AS v FROM events),
    l AS (SELECT *, arrived > date_trunc('day', ts) + INTERVAL 4 DAY AS late, CAST(round_even(v, 6) AS DECIMAL(38,6)) AS amount FROM e),
    w AS (SELECT *, count(*) FILTER (NOT late) OVER (PARTITION BY period) AS rows0, coalesce(sum(amount) FILTER (NOT late) OVER (PARTITION BY period), 0) AS amount0,
      count(*) FILTER (late) OVER (PARTITION BY period ORDER BY arrived, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS rows1, coalesce(sum(amount) FILTER (late) OVER (PARTITION BY period ORDER BY arrived, event_id::VARCHAR ROWS UNBOUNDED PRECEDING), 0) AS amount1 FROM l)
    SELECT event_id::VARCHAR AS id, period, 'settled_movement' AS type, 'row_count' AS metric, (rows0 + rows1 - 1)::VARCHAR AS before, (rows0 + rows1)::VARCHAR AS after FROM w WHERE late
    UNION ALL SELECT event_id::VARCHAR, period, 'settled_movement', 'amount', {_plain('amount0 + amount1 - coalesce(amount, 0)')}, {_plain('amount0 + amount1')} FROM w WHERE late AND coalesce(amount, 0) <> 0"""


def _late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events replayed as a stream; what is given out of settled days and late rows."""
    from tallyline.streaming import late

    schema = t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    arrived = F.col("ts") + F.when(F.col("event_id") % 97 == 0, F.expr("INTERVAL 5 DAYS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    path = _work(spark, "late-rows")
    found = late.flag_late(stream.withColumn("arrived", arrived), "ts", "arrived", "event_id", "value", settle_hours=72)
    found.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(late.EMITTED).parquet(f"{path}/rows")


@query(_LATE)
def stream_late_rows(spark, sf_dir):
    from tallyline.streaming import late

    return late.verdicts(_late_rows(spark, sf_dir)).drop("arrived")


# signatures and the ledger -----------------------------------------------------------------

#: A receipt for every customer, signed by its nation's key; some are altered afterwards, lack their signature or bear a stranger's.
_SIGNED = "CASE WHEN c_custkey % 7 = 0 THEN 'altered' WHEN c_custkey % 11 = 0 THEN 'none' WHEN c_custkey % 13 = 0 THEN 'stranger' ELSE 'good' END"


def _signed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, customer, body, signature): receipts signed by tasks."""
    from tallyline.plans import ledger

    k = F.col("c_custkey")
    seed = lambda who: F.unhex(F.sha2(who.cast("string"), 256))
    body = F.format_string('{"customer":%d,"kind":"transform_receipt","nation":%d}', "c_custkey", "c_nationkey")
    # With their number given, partitions stay as many: rows are short, but each takes much work.
    tasks = max(16, 4 * spark.sparkContext.defaultParallelism)
    rows = t(spark, sf_dir, "customer").repartition(tasks, "c_custkey").select(F.col("c_nationkey").alias("chain"), k.alias("customer"), body.alias("body"), seed(F.when(~(k % 7 == 0) & ~(k % 11 == 0) & (k % 13 == 0), F.lit("a stranger")).otherwise(F.concat(F.lit("nation "), "c_nationkey"))).alias("seed"))
    signed = rows.withColumn("signature", ledger.sign(F.col("seed"), F.col("body")))
    return signed.select("chain", "customer", F.when(F.col("customer") % 7 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")).alias("body"), F.when((F.col("customer") % 7 == 0) | (F.col("customer") % 11 != 0), F.col("signature")).alias("signature"))


def _nation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, key, own): each chain's embedded key; those of even nations are trusted, too."""
    from tallyline.plans import crypto

    keys = F.udf(lambda n: crypto.public_of(hashlib.sha256(f"nation {n}".encode()).digest()), "string")  # a call a chain
    own = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chain"), keys("n_nationkey").alias("key"), F.lit(True).alias("own"))
    return own.unionByName(own.filter("chain % 2 = 0").withColumn("own", F.lit(False)))


@query(f"SELECT c_nationkey AS chain, c_custkey AS customer, CASE WHEN s <> 'good' THEN 'none' WHEN c_nationkey % 2 = 0 THEN 'trusted' ELSE 'chain' END AS signer FROM (SELECT *, {_SIGNED} AS s FROM customer)")
def signature_verify(spark, sf_dir):
    from tallyline.plans import ledger

    return ledger.signers(_signed_receipts(spark, sf_dir), _nation_keys(spark, sf_dir)).select("chain", "customer", "signer")


@query(f"SELECT c_nationkey AS chain, count(*) AS receipts, 'unrecognized signing key: ' || count(*) || ' receipt(s) verify under the chain''s embedded key alone' AS caveat FROM (SELECT *, {_SIGNED} AS s FROM customer) WHERE s = 'good' AND c_nationkey % 2 = 1 GROUP BY 1")
def key_trust_caveat(spark, sf_dir):
    from tallyline.plans import ledger

    return ledger.key_caveats(ledger.signers(_signed_receipts(spark, sf_dir), _nation_keys(spark, sf_dir)))


_RUNS = "(SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, dense_rank() OVER (ORDER BY event_type) - 1 AS kind FROM events GROUP BY 1, 2)"


@query(f"SELECT day || ' ' || event_type AS path, n AS row_count, CASE WHEN n % 5 = 4 THEN 'unreadable JSON' WHEN n % 7 = 6 THEN 'body does not canonicalize' WHEN n % 11 = 0 THEN 'not a run_snapshot' WHEN n % 13 = 0 THEN 'created_at is in the future' WHEN kind % 2 = 0 AND n % 3 = 1 THEN 'signature does not verify under any trusted key' END AS reason FROM {_RUNS}")
def snapshots_usable(spark, sf_dir):
    """Archived runs, one for each day and type of event: every second type's are signed; some are altered, broken, of another kind or from the future."""
    from pyspark.sql import Window

    from tallyline.plans import crypto, ledger

    seed = b"\7" * 32
    runs = t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    types = runs.select("event_type").distinct().withColumn("kind", F.row_number().over(Window.orderBy("event_type")) - 1)  # a row a type
    n = F.col("n")
    kind = F.when(n % 11 == 0, "note").otherwise("run_snapshot")
    created = F.when(n % 13 == 0, "2999-01-01").otherwise(F.col("day"))
    number = F.when(n % 7 == 6, F.concat(n.cast("string"), F.lit(".0"))).otherwise(n.cast("string"))
    text = F.concat(F.format_string('{"kind": "%s", "created_at": "%sT00:00:00Z", "stages": [{"name": "source", "totals": {"row_count": ', kind, created), number, F.lit("}}]"))
    bodies = runs.join(F.broadcast(types), "event_type").select("day", "event_type", "n", "kind", text.alias("text"))
    signed = bodies.withColumn("signature", ledger.sign(F.lit(seed), F.coalesce(ledger.body_text(F.concat("text", F.lit("}"))), F.lit(""))))
    altered = F.when(n % 3 == 1, F.concat(F.lit("00"), F.substring("signature", 3, 126))).otherwise(F.col("signature"))
    whole = F.concat("text", F.when(F.col("kind") % 2 == 0, F.format_string(', "signature": {"alg": "ed25519", "value": "%s"}', altered)).otherwise(""), F.lit("}"))
    texts = signed.select(F.concat_ws(" ", "day", "event_type").alias("path"), F.when(n % 5 == 4, F.concat(F.lit("{"), whole)).otherwise(whole).alias("value"), "n")
    found = ledger.usable(ledger.documents(texts), "run_snapshot", [crypto.public_of(seed)], dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc))
    return found.select("path", F.col("n").alias("row_count"), "reason")
