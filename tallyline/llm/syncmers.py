"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text's units are its words, in lower case; ideographs and other marks stand alone. Of
every run of ``k`` units all inner runs of ``s`` units are hashed; the run is an anchor
if the smallest of these hashes is its first or its last one. Whether a run is
an anchor depends on nothing outside it, so equal passages have equal anchors
wherever they stand. An entry of a fingerprint is an anchor's hash together with the
distance to the next anchor, which ties entries to their places in a passage, and
likeness is the Dice coefficient of two texts' sets of entries.

Defined results: a null text is empty; a text without units has no entries, one with units
but without an anchor has one entry for all of it. Two texts without entries have
likeness 1, one without and one with 0. Documents follow one another by descending key, rows with
equal keys by their text, null keys come last. Only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+|[^\s\p{L}\p{N}\p{M}]"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entries(text: Column, k: int = 5, s: int = 2) -> Column:
    """The fingerprint's entries in order, array<int>."""
    inner = k - s + 1

    def seeded(units: Column) -> Column:
        return _let(F.transform(units, lambda u: F.xxhash64(u)), lambda h: runs(h, F.size(h)))

    def runs(h: Column, n: Column) -> Column:
        short = F.when(n > 0, F.array(F.hash(h))).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        return F.when(n < k, short).otherwise(_let(hashes, lambda g: anchored(h, g, n)))

    def anchored(h: Column, g: Column, n: Column) -> Column:
        def place(i: Column) -> Column:
            own = [F.get(g, i + j) for j in range(inner)]
            return F.when(F.least(*own) == F.least(own[0], own[-1]), i)

        found = F.filter(F.transform(F.sequence(F.lit(0), n - k), place), lambda i: i.isNotNull())
        return _let(found, lambda at: F.when(F.size(at) == 0, F.array(F.hash(h))).otherwise(F.transform(at, lambda i, j: entry(g, i, F.get(at, j + 1)))))

    def entry(g: Column, i: Column, after: Column) -> Column:
        steps = sorted({*range(0, inner, s), inner - 1})
        return F.hash(*[F.get(g, i + j) for j in steps], F.coalesce(after - i, F.lit(0)))

    return _let(F.regexp_extract_all(F.lower(text), F.lit(UNITS), F.lit(0)), seeded)


def as_text(found: Column) -> Column:
    """The fingerprint as one string of hexadecimal entries."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of entries, 0 to 1."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / sizes)


def _longs(values: list[int]) -> Column:
    """An array that stands in the plan as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key, by two short searches."""
    width = max(1, round(len(bounds) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < key))
    part = F.greatest(below(_longs(bounds[::width])) - 1, F.lit(0))
    return _let(part, lambda p: p * width + below(F.slice(_longs(bounds), p * width + 1, F.lit(width))))


def with_next(docs: DataFrame, key: str, columns: list[str], rows_per_bucket: int = 500, most_buckets: int = 20_000) -> DataFrame:
    """The rows, with what the row after them (by descending key, cyclically) has in ``columns``, as next_<column>.

    Buckets end at approximate quantiles that are keys themselves; the driver receives these alone, ``most_buckets``
    at most. The last row of a bucket needs the first of the one below, whose key is a bound, so rows at
    bounds are sent to both. One exchange moves the rows; no task has more than a few buckets, and
    a bucket is sorted with spilling. Rows that share a key share a bucket. Keys must be whole numbers of
    at most 64 bits, others raise TypeError; null keys count as the smallest.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number of at most 64 bits, not {docs.schema[key].dataType.simpleString()}")
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(at.alias("at"))
    n, top = ids.agg(F.count("*"), F.max("at")).first()
    if not n:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    wanted = min(most_buckets, -(-n // rows_per_bucket))
    found = ids.agg(F.percentile_approx("at", [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] if wanted > 1 else []
    bounds = sorted({*found, top})
    last, held = F.lit(len(bounds) - 1), _longs(bounds)
    to = _let(_bucket(F.col("_at"), bounds), lambda b: F.when(F.get(held, b) == F.col("_at"), F.array(b, -1 - F.when(b == last, 0).otherwise(b + 1))).otherwise(F.array(b)))
    rest = [c for c in docs.columns if c not in columns]
    sent = docs.select(*rest, F.struct(*columns).alias("_row"), at.alias("_at")).withColumn("_to", F.explode(to))  # below 0: -1 - bucket, a copy
    sent = sent.select(*rest, "_row", "_at", F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to")).alias("_bucket"), (F.col("_to") < 0).alias("_copy"))
    order = Window.partitionBy("_bucket").orderBy(F.col("_copy") & (F.col("_at") == top), F.desc("_at"), F.col("_row")[columns[0]])
    led = sent.withColumn("_next", F.lead("_row").over(order)).filter(~F.col("_copy"))
    unpacked = [F.col(c) if c in rest else F.col("_row")[c].alias(c) for c in docs.columns]
    return led.select(*unpacked, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint beside that of its edited text, which takes its last third from the next row.

    key, text, entries, next_entries, edited, edited_entries.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), own.alias("text")).withColumn("entries", entries(F.col("text")))
    paired = with_next(base, "key", ["text", "entries"])
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 3)))"), F.substring(F.col("next_text"), F.lit(1), cut))
    return paired.withColumn("edited", edited).withColumn("edited_entries", entries(F.col("edited"))).drop("next_text").withColumnsRenamed({"key": key, "text": text})
