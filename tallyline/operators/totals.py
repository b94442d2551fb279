"""Control totals: one pass for the profile of all columns, one for the day buckets."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal, localcontext
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import cells, headers
from tallyline.operators.canonical import kinds, python_paths
from tallyline.session import pin

UNBUCKETED = "_unbucketed"
#: Scale of a column's longs by kind: whole numbers count ones, doubles millionths.
SCALES = {"byte": 1, "short": 1, "integer": 1, "long": 1, "float": cells.MILLION, "double": cells.MILLION}
LONG_LIMIT = 1 << 63


def enough(part: int, whole: int) -> bool:
    """Nine tenths or more, in integers."""
    return whole > 0 and 10 * part >= 9 * whole


class Plan:
    """A table's columns, by normalised name, and what is computed from their cells.

    Two projections stand before every aggregate: stripped text, then what each cell says. So a cell is stripped once
    and read once as a number and as a day, however many aggregates use it (projections whose columns
    are used several times aren't merged into what is above them). Whole numbers, and doubles that are exact in
    millionths, are summed as longs.

    slow: text columns that need the Python path for numbers, found when first needed if not given;
    wide: columns whose longs might overflow.
    """

    def __init__(self, df: DataFrame, slow: set[str] | None = None, wide: Iterable[str] = ()):
        pin(df.sparkSession)
        self.df = headers.merge(df)
        self.kinds = kinds(self.df)
        self.at = {n: i for i, n in enumerate(self.kinds)}
        self.slow, self.wide = slow, set(wide)

    def is_text(self, name: str) -> bool:
        return self.kinds[name].typeName() == "string"

    def scale(self, name: str) -> int | None:
        return None if name in self.wide else SCALES.get(self.kinds[name].typeName())

    def _is_slow(self, name: str) -> bool:
        if self.slow is None:
            self.slow = python_paths(self.df)[0]
        return name in self.slow

    def _read(self, name: str, numbers: bool, days: bool) -> list[Column]:
        i, kind, scale = self.at[name], self.kinds[name], self.scale(name)
        value, text = F.col(f"v{i}"), F.col(f"t{i}")
        if self.is_text(name):
            number = [cells.text_number(text, self._is_slow(name)).alias(f"n{i}")] if numbers else []
            return number + ([cells.text_day(text).alias(f"d{i}")] if days else [])
        if not numbers or not cells.is_numeric(kind):
            return []
        if scale == 1:
            return [value.cast("long").alias(f"k{i}")]
        if scale:
            exact = cells.millionths(value)
            return [exact.alias(f"k{i}"), F.when(exact.isNull(), cells.number(value, kind)).alias(f"n{i}")]
        return [cells.number(value, kind).alias(f"n{i}")]

    def facts(self, numbers: Iterable[str], days: Iterable[str], others: Iterable[str] = ()) -> DataFrame:
        """By a column's number i: v its cell, t its stripped text, k its number as a long, n as a decimal where it has none as a long, d its day."""
        numbers, days = set(numbers), set(days)
        used = [n for n in self.kinds if n in numbers or n in days or n in {*others}]
        first = [F.col(f"`{n}`").alias(f"v{self.at[n]}") for n in used]
        first += [cells.strip(F.col(f"`{n}`")).alias(f"t{self.at[n]}") for n in used if self.is_text(n) and n in numbers | days]
        return self.df.select(*first).select("*", *[c for n in used for c in self._read(n, n in numbers, n in days)])

    def number_parts(self, name: str) -> list[Column]:
        """The columns of facts() that hold the cells' numbers; each number stands in one of them."""
        i, scale = self.at[name], self.scale(name)
        if scale == 1:
            return [F.col(f"k{i}")]
        if scale:
            return [F.col(f"k{i}"), F.col(f"n{i}")]
        return [F.col(f"n{i}")] if self.is_text(name) or cells.is_numeric(self.kinds[name]) else []

    def sums(self, name: str) -> list[Column]:
        """Aggregates s<i>_<part>: the sum and number of each of number_parts()."""
        i = self.at[name]
        return [x for p, part in enumerate(self.number_parts(name)) for x in (F.try_sum(part).alias(f"s{i}_{p}"), F.count(part).alias(f"c{i}_{p}"))]

    def total(self, name: str) -> Column:
        """The sum, from these aggregates; null without numbers."""
        i, scale, parts = self.at[name], self.scale(name), self.number_parts(name)
        out = []
        for p in range(len(parts)):
            held = F.col(f"s{i}_{p}")
            sound = F.when((F.col(f"c{i}_{p}") > 0) & held.isNull(), F.raise_error(F.lit(f"the sum of column {name} has more than 20 integer digits"))).otherwise(held)
            out.append((sound.cast("decimal(20,0)") * F.lit(Decimal(1) / scale).cast("decimal(7,6)")).cast(cells.DEC) if scale and p == 0 else sound.cast(cells.DEC))
        return F.coalesce(sum(out[1:], out[0]), *out) if out else F.lit(None).cast(cells.DEC)

    def day(self, name: str) -> Column:
        """The day of facts(): text for text columns, a date for dates and times."""
        return F.col(f"d{self.at[name]}") if self.is_text(name) else F.col(f"v{self.at[name]}").cast("date") if cells.is_temporal(self.kinds[name]) else F.lit(None).cast("string")


def _aggregates(plan: Plan, name: str) -> dict[str, Column]:
    """What the profile needs to know of a column."""
    i, kind, parts = plan.at[name], plan.kinds[name], plan.number_parts(name)
    out = {"filled": F.count(f"v{i}")}
    if cells.is_temporal(kind):
        out |= {"least": F.min(f"v{i}"), "most": F.max(f"v{i}")}
    for p, part in enumerate(parts):
        out |= {f"count{p}": F.count(part), f"sum{p}": F.try_sum(part)}
    if plan.scale(name):
        out |= {"bottom": F.min(parts[0]), "top": F.max(parts[0])}
    if plan.is_text(name):
        text, day = F.col(f"t{i}"), F.col(f"d{i}")
        grouped = F.when(parts[0].isNull() & cells.may_be_number(text), F.when(text.rlike(cells.GROUPED), text))
        out |= {"days": F.count(day), "first_day": F.min(day), "last_day": F.max(day), "grouped": F.count(grouped), "example": F.min(grouped)}
        if name not in plan.slow:
            out["slow"] = F.coalesce(F.bool_or(F.when(parts[0].isNull(), cells.needs_python(text, True)).otherwise(False)), F.lit(False))
    return out


def _one_pass(plan: Plan, names: list[str]) -> tuple[dict[str, dict[str, Any]], int]:
    wanted = {n: _aggregates(plan, n) for n in names}
    aggregated = plan.facts(names, names).agg(F.count("*").alias("rows"), *[c.alias(f"{k}_{plan.at[n]}") for n in names for k, c in wanted[n].items()])
    ranges = [(f"{k}_{plan.at[n]}", plan.kinds[n]) for n in names for k in ("least", "most") if k in wanted[n]]
    row = aggregated.withColumns({c: cells.canonical(F.col(c), kind) for c, kind in ranges}).first().asDict() if ranges else aggregated.first().asDict()
    return {n: {k: row[f"{k}_{plan.at[n]}"] for k in wanted[n]} for n in names}, row["rows"]


def profile(df: DataFrame) -> tuple[Plan, dict[str, dict[str, Any]], int]:
    """Per column: filled, numeric, days and grouped (counts), sum, least, most, first_day, last_day, example; and the number of rows.

    One aggregate; columns in which it finds numbers that only Python reads, or longs that might overflow, are read again.
    """
    plan = Plan(df, slow=set())
    found, rows = _one_pass(plan, list(plan.kinds))
    plan.slow = {n for n, x in found.items() if x.get("slow")}
    plan.wide = {n for n, x in found.items() if rows * max(abs(x.get("top") or 0), abs(x.get("bottom") or 0)) >= LONG_LIMIT}
    if plan.slow | plan.wide:
        found |= _one_pass(plan, [n for n in plan.kinds if n in plan.slow | plan.wide])[0]
    return plan, {n: _column(plan, n, found[n]) for n in plan.kinds}, rows


def _column(plan: Plan, name: str, x: dict[str, Any]) -> dict[str, Any]:
    parts = range(len(plan.number_parts(name)))
    numeric = sum(x[f"count{p}"] for p in parts)
    total = None
    for p in parts:
        if x[f"count{p}"]:
            if x[f"sum{p}"] is None:
                raise ValueError(f"the sum of column {name} has more than 20 integer digits")
            with localcontext(prec=60):
                total = (total or Decimal(0)) + Decimal(x[f"sum{p}"]) / ((plan.scale(name) or 1) if p == 0 else 1)
    least, most = x.get("least"), x.get("most")
    if cells.is_temporal(plan.kinds[name]):
        x = x | {"days": x["filled"], "first_day": least and least[:10], "last_day": most and most[:10]}
    return {"filled": x["filled"], "numeric": numeric, "sum": total, "least": least, "most": most} | {k: x.get(k, d) for k, d in (("days", 0), ("first_day", None), ("last_day", None), ("grouped", 0), ("example", None))}


def numeric_columns(found: dict[str, dict[str, Any]]) -> list[str]:
    return [n for n, x in found.items() if enough(x["numeric"], x["filled"])]


def bucket_candidates(found: dict[str, dict[str, Any]]) -> list[str]:
    return [n for n, x in found.items() if enough(x["days"], x["filled"])]


def resolve_bucket(found: dict[str, dict[str, Any]], declared: str | None) -> str | None:
    """The declared column if it qualifies; else the only candidate, if it spans two days or more."""
    candidates = bucket_candidates(found)
    if declared is not None:
        name = headers.normalise(declared)
        if name not in candidates:
            raise ValueError(f"bucket column {name!r} does not qualify: fewer than 90% of its non-null values are dates or ISO-shaped date text")
        return name
    if len(candidates) == 1 and found[candidates[0]]["first_day"] != found[candidates[0]]["last_day"]:
        return candidates[0]
    return None


def period_buckets(plan: Plan, bucket: str, numeric: list[str], nullable: Iterable[str] | None = None) -> DataFrame:
    """(period, row_count, sum_<i> of numeric[i], nulls_<j> of the j-th column) by UTC day; rows without a day under _unbucketed.

    nullable: the columns that may hold nulls, all if not given.
    """
    counted = list(plan.kinds if nullable is None else nullable)
    facts = plan.facts(numeric, [bucket], counted)
    nulls = [(F.count("*") - F.count(f"v{plan.at[n]}")).alias(f"nulls_{plan.at[n]}") for n in counted]
    grouped = facts.groupBy(plan.day(bucket).alias("day")).agg(F.count("*").alias("row_count"), *[x for n in numeric for x in plan.sums(n)], *nulls)
    period = F.coalesce(F.col("day") if plan.is_text(bucket) else F.date_format("day", "yyyy-MM-dd"), F.lit(UNBUCKETED)).alias("period")
    sums = [F.coalesce(plan.total(n), F.lit(0).cast(cells.DEC)).alias(f"sum_{i}") for i, n in enumerate(numeric)]
    none = [F.lit(0).cast("long").alias(f"nulls_{plan.at[n]}") if n not in counted else F.col(f"nulls_{plan.at[n]}") for n in plan.kinds]
    return grouped.select(period, "row_count", *sums, *none)


def _nullable(found: dict[str, dict[str, Any]], rows: int) -> list[str]:
    return [n for n, x in found.items() if rows > x["filled"]]


def control_totals(df: DataFrame, bucket_column: str | None = None) -> dict[str, Any]:
    """The totals document: row and column counts, sums, date ranges, null counts, day buckets."""
    plan, found, rows = profile(df)
    numeric, nullable = numeric_columns(found), _nullable(found, rows)
    totals: dict[str, Any] = {
        "row_count": rows,
        "column_count": len(found),
        "numeric_sums": {n: cells.plain(found[n]["sum"]) for n in numeric},
        "date_ranges": {n: {"min": x["least"], "max": x["most"]} for n, x in found.items() if n not in numeric and cells.is_temporal(plan.kinds[n]) and x["filled"]},
        "null_counts": {n: rows - found[n]["filled"] for n in nullable},
    }
    bucket = resolve_bucket(found, bucket_column)
    if bucket is not None:
        totals["bucket_column"] = bucket
        totals["period_buckets"] = {
            r["period"]: {
                "row_count": r["row_count"],
                "numeric_sums": {n: cells.plain(r[f"sum_{i}"]) for i, n in enumerate(numeric)},
                "null_counts": {n: r[f"nulls_{plan.at[n]}"] for n in nullable if r[f"nulls_{plan.at[n]}"]},
            }
            for r in period_buckets(plan, bucket, numeric, nullable).orderBy("period").toLocalIterator()
        }
    return totals


def long_totals(df: DataFrame, bucket_column: str | None = None) -> DataFrame:
    """The same totals as rows (section, period, name, value), all text; buckets are computed and unpivoted on the cluster."""
    plan, found, rows = profile(df)
    spark, numeric, nullable = df.sparkSession, numeric_columns(found), _nullable(found, rows)
    facts = [("row_count", "", "", str(rows)), ("column_count", "", "", str(len(found)))]
    facts += [("numeric_sums", "", n, cells.plain(found[n]["sum"])) for n in numeric]
    facts += [("null_counts", "", n, str(rows - found[n]["filled"])) for n in nullable]
    facts += [(f"date_{k}", "", n, x[v]) for n, x in found.items() if cells.is_temporal(plan.kinds[n]) and x["filled"] for k, v in (("min", "least"), ("max", "most"))]
    bucket = resolve_bucket(found, bucket_column)
    if bucket is not None:
        facts.append(("bucket_column", "", "", bucket))
    out = spark.createDataFrame(facts, "section string, period string, name string, value string")
    if bucket is None:
        return out
    text = lambda s, n, v: F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value"))
    parts = [text("bucket_row_count", "", F.col("row_count").cast("string"))]
    parts += [text("bucket_sums", n, cells.plain_text(F.col(f"sum_{i}"))) for i, n in enumerate(numeric)]
    parts += [text("bucket_nulls", n, F.when(F.col(f"nulls_{plan.at[n]}") > 0, F.col(f"nulls_{plan.at[n]}").cast("string"))) for n in nullable]
    buckets = period_buckets(plan, bucket, numeric, nullable).select("period", F.explode(F.array(*parts)).alias("x")).select("x.section", "period", "x.name", "x.value").filter("value is not null")
    return out.unionByName(buckets)


def document_rows(totals: dict[str, Any]) -> list[tuple[str, str, str, str]]:
    """A totals document in the form of long_totals(): (section, period, name, value); entries that aren't numbers are left out."""

    def of(period: str, entry: Any, sections: tuple[str, str, str]) -> Iterable[tuple[str, str, str, Any]]:
        entry = entry if isinstance(entry, dict) else {}
        counts = [(sections[0], "", entry["row_count"])] if type(entry.get("row_count")) is int else []
        held = [(s, n, v) for s, key in zip(sections[1:], ("numeric_sums", "null_counts"), strict=True) if isinstance(entry.get(key), dict) for n, v in entry[key].items()]
        return ((s, period, n, repr(v) if isinstance(v, float) else str(v)) for s, n, v in counts + held if type(v) in (int, float, str))

    buckets = totals.get("period_buckets")
    rows = [*of("", totals, ("row_count", "numeric_sums", "null_counts"))]
    return rows + [r for period, entry in (buckets.items() if isinstance(buckets, dict) else ()) for r in of(period, entry, ("bucket_row_count", "bucket_sums", "bucket_nulls"))]


def grouped_numeric_columns(df: DataFrame) -> list[dict[str, str]]:
    """Columns that aren't summed but would be if thousands groups were removed; the example is the smallest text."""
    _, found, _ = profile(df)
    return [{"column": n, "example": x["example"]} for n, x in found.items() if not enough(x["numeric"], x["filled"]) and x["grouped"] and enough(x["numeric"] + x["grouped"], x["filled"])]


# deltas -------------------------------------------------------------------


class Move(NamedTuple):
    """A total that differs: where, both sides (None where absent), and their difference where both are numbers."""

    section: str
    name: str
    before: Any
    after: Any
    delta: Any


#: Sections of a totals document in the order of reports.
COUNTS, MAPS = ("row_count", "column_count"), ("numeric_sums", "null_counts", "date_ranges", "period_buckets")


def _flat(totals: dict[str, Any]) -> dict[tuple[str, str], Any]:
    held = {(s, ""): totals[s] for s in COUNTS if s in totals}
    return held | {(s, n): v for s in MAPS if isinstance(totals.get(s), dict) for n, v in totals[s].items()}


def _delta(before: Any, after: Any) -> Any:
    """Of counts as an int, of decimal texts as plain text; None for anything else."""
    sides = (before, after)
    if all(type(x) is int for x in sides):
        return after - before
    numbers = [cells.python_decimal(x) if isinstance(x, str) else None for x in sides]
    return None if None in numbers else cells.plain(numbers[1] - numbers[0])


def moves(before: dict[str, Any], after: dict[str, Any]) -> list[Move]:
    """What differs between two totals documents, in the order of reports; an absent null count is 0."""
    sides = [_flat(before), _flat(after)]
    order = {s: i for i, s in enumerate((*COUNTS, *MAPS))}
    out = []
    for section, name in sorted({*sides[0], *sides[1]}, key=lambda k: (order[k[0]], k[1])):
        a, b = (side.get((section, name), 0 if section == "null_counts" else None) for side in sides)
        if a != b:
            out.append(Move(section, name, a, b, _delta(a, b)))
    return out


#: How a moved total reads, by section and by which sides are present. Fixed text.
LINES = {
    "row_count": "{section} {before} -> {after}{moved}", "column_count": "{section} {before} -> {after}{moved}",
    "numeric_sums": "{name} {before} -> {after}{moved}", "null_counts": "null_counts[{name}] {before} -> {after}{moved}",
}


def totals_delta(before: dict[str, Any], after: dict[str, Any]) -> list[str]:
    """A line for each count, sum or null count that moved. Date ranges and buckets are left to structured_delta."""
    lines = []
    for m in moves(before, after):
        if m.section in LINES:
            sums = m.section == "numeric_sums"
            absent = ("(added)", "(removed)") if sums else (0, 0)
            shown = [missing if side is None else side for side, missing in zip((m.before, m.after), absent, strict=True)]
            delta = m.delta if sums else _delta(*shown)
            moved = "" if delta is None else f" ({delta})" if sums else f" ({delta:+d})"
            lines.append(LINES[m.section].format(section=m.section, name=m.name, before=shown[0], after=shown[1], moved=moved))
    return lines


def structured_delta(before: dict[str, Any], after: dict[str, Any]) -> dict[str, Any]:
    """What moved, by section; sides that are absent are null, absent null counts 0; of buckets only the names."""
    out: dict[str, Any] = {}
    for m in moves(before, after):
        if m.section == "period_buckets":
            out.setdefault("period_buckets_changed", []).append(m.name)
            continue
        a, b = (x if isinstance(x, dict) or m.section != "date_ranges" else None for x in (m.before, m.after))
        entry = {"before": a, "after": b} | ({} if m.delta is None or m.section == "date_ranges" else {"delta": m.delta})
        if m.section in COUNTS:
            out[m.section] = entry
        else:
            out.setdefault(m.section, {})[m.name] = entry
    return out


def delta_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The delta of two long totals as rows: a full outer join on (section, period, name), null-safe inequality."""
    keys = ["section", "period", "name"]
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), keys, "full_outer")
    counted = F.col("section").isin("null_counts", "bucket_nulls")
    joined = joined.withColumns({c: F.when(counted, F.coalesce(c, F.lit("0"))).otherwise(F.col(c)) for c in ("before", "after")})
    moved = F.col("after").try_cast(cells.DEC) - F.col("before").try_cast(cells.DEC)
    return joined.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("delta", cells.plain_text(moved.cast(cells.DEC)))
