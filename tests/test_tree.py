import hashlib

import pytest
from pyspark.sql import functions as F

from tallyline.operators import tree

ROWS = [(k if k % 50 else None, f"v{k % 7}", k * 0.5) for k in range(1, 600)] + [(9, "hot", 1.0)] * 400


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "Key long, b string, c double")


def plain(rows, leaf, fan):
    """Digests by level, row by row."""
    text = lambda v: "null" if v is None else f'"{v:g}"' if isinstance(v, float) else f'"{v}"'
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    counted = {}
    for key, b, c in rows:
        row = f"[{text(b)},{text(c)},{text(key)}]"
        counted[(key is not None, key or 0, row)] = counted.get((key is not None, key or 0, row), 0) + 1
    nodes = [(sha(f"{row} {n}"), len(sha(row)) - len(sha(row).rstrip("0"))) for (*_, row), n in sorted(counted.items())]
    levels = []
    while len(nodes) > 1 or not levels:
        groups = []
        for digest, zeros in nodes:
            if not groups or zeros >= leaf + fan * len(levels):
                groups.append(([], zeros))
            groups[-1][0].append(digest)
        nodes = [(sha("".join(ds)), z) for ds, z in groups]
        levels.append([d for d, _ in nodes])
    return levels


def by_level(nodes):
    out = {}
    for r in nodes.orderBy("level", "at").collect():
        out.setdefault(r.level, []).append(r.digest)
    return [out[k] for k in sorted(out)]


def test_trees_are_those_of_a_plain_walk(table):
    expected = plain(ROWS, 1, 1)
    assert len(expected) > 2
    for n in (1, 3, 11):
        nodes = tree.tree(table.repartition(n).select("c", "b", "Key"), ["key"], leaf=1, fan=1)
        assert by_level(nodes) == expected and tree.root(nodes) == expected[-1][0]
        assert nodes.filter("level = 0").agg(F.sum("rows")).first()[0] == len(ROWS)
    one = tree.tree(table, ["Key"])
    assert by_level(one)[-1] == plain(ROWS, 3, 2)[-1]


def test_differences_name_the_ranges(spark, table):
    moved = table.withColumn("b", F.when(F.col("Key") == 301, "x").otherwise(F.col("b"))).filter("Key is null or Key <> 17")
    a, b = (tree.tree(df, ["Key"], leaf=1, fan=1) for df in (table, moved))
    found = tree.differences(a, b)
    rows = found.collect()
    spans = [(r.low.key, r.high.key if r.high else None) for r in rows if r.side == "a"]
    inside = lambda key: any((low is None or low <= key) and (high is None or key <= high) for low, high in spans)
    assert inside(301) and inside(17) and len(spans) < 6 and sum(r.rows for r in rows if r.side == "a") < 200
    kept = tree.rows_of(table, "Key", found)
    assert {17, 301} <= {r.Key for r in kept.collect()} and kept.count() < 250
    assert tree.differences(a, tree.tree(table.repartition(5), ["Key"], leaf=1, fan=1)).count() == 0
    assert {17, 301} <= {r.Key for r in tree.rows_of(table, "Key", found, most=1).collect()}


def test_filters_of_ranges_reach_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    ranges = spark.createDataFrame([((5,), (9,)), ((500,), None)], "low struct<key:long>, high struct<key:long>")
    kept = tree.rows_of(stored, "Key", ranges)
    assert "GreaterThanOrEqual(Key,5)" in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.Key for r in kept.collect()} == {k for k, *_ in ROWS if k is not None and (5 <= k <= 9 or k >= 500)}


def test_trees_of_other_heights_and_of_nothing(table):
    small, none = table.filter("Key < 6"), tree.tree(table.limit(0), ["Key"])
    assert none.count() == 0 and tree.root(none) is None
    a, b = tree.tree(table, ["Key"], leaf=1, fan=1), tree.tree(small, ["Key"], leaf=1, fan=1)
    found = tree.differences(a, b)
    assert found.filter("side = 'a'").agg(F.sum("rows")).first()[0] > 900
    assert tree.differences(a, none).filter("side = 'a'").count() == a.filter("level = 0").count()
