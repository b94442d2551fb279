"""Canonical cells as Column expressions.

A cell's canonical form doesn't depend on the file format it came from: numbers and text that
reads as a number become plain decimal text (six places, half-even), times become UTC
text, midnight becomes a bare date, other text is NFC without outer white space.
Sessions must use the UTC time zone (``tallyline.session`` pins it).
"""

from __future__ import annotations

import unicodedata
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEC = "decimal(38,18)"
#: White space in the sense of Python's str.strip(), as a regular expression class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: ISO shapes that count as days, and thousands-grouped numbers. Fixed patterns.
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
GROUPED = r"^[+-]?[0-9]{1,3}([,   ][0-9]{3})+(\.[0-9]+)?$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Numbers of which the form alone says that DECIMAL(38,18) holds them, so that most cells meet one pattern.
PLAIN = r"^[+-]?(?:[0-9]{1,20}(?:\.[0-9]{0,18})?|\.[0-9]{1,18}|[0-9]{1,10}(?:\.[0-9]{0,9})?[eE][+-]?[0-9])$"
#: What Python reads as a decimal beyond that: other scripts' digits, underscores between digits.
WIDE_NUMBER = r"^[+-]?[\p{Nd}_]*\.?[\p{Nd}_]*([eE][+-]?[\p{Nd}_]+)?$"
_EXACT = Context(prec=28, rounding=ROUND_HALF_EVEN)


def _visible(code: Column) -> Column:
    return (code > 32) & (code < 127)


def strip(text: Column) -> Column:
    """The text without outer white space; what begins and ends with visible ASCII is it already."""
    bare = _visible(F.ascii(text)) & _visible(F.ascii(F.substring(text, -1, 1)))
    return F.when(bare, text).otherwise(F.trim(text, F.lit(SPACES)))


def may_be_number(stripped: Column) -> Column:
    """Whether the first character of a stripped text is one that a number can begin with: a digit, sign, point, underscore, or not ASCII."""
    code = F.ascii(stripped)
    return code.between(48, 57) | code.isin(43, 45, 46, 95) | (code > 127)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.FractionalType))


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def python_decimal(text: str | None) -> Decimal | None:
    """The number in a text, as Python reads it; None if there is none or it isn't finite."""
    if text is None or not text.strip():
        return None
    try:
        value = Decimal(text.strip())
    except InvalidOperation:
        return None
    return value if value.is_finite() else None


def plain(value: Decimal) -> str:
    """Plain decimal text of six places at most, half-even; numbers of 23 or more integer digits raise ValueError."""
    try:
        text = format(value.quantize(Decimal("0.000001"), context=_EXACT), "f")
    except InvalidOperation:
        raise ValueError(f"a number of more than 22 integer digits has no canonical form: {value}") from None
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("number", T.DecimalType(38, 18))]))
def _slow_number(values: pd.Series) -> pd.DataFrame:
    found = [python_decimal(v) for v in values]
    wide = Context(prec=60)
    return pd.DataFrame({"text": [None if d is None else plain(d) for d in found], "number": [None if d is None or abs(d) >= 10**20 else wide.quantize(d, Decimal("1e-18")) for d in found]})


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.udf(T.StringType())
def _as_python_text(value) -> str | None:
    return None if value is None else str(value)


def _fits(text: Column) -> Column:
    """Whether DECIMAL(38,18) holds the number without rounding."""
    fraction = F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))
    power = F.regexp_extract(text, r"[eE]([+-]?[0-9]{1,6})$", 1)
    exponent = F.when(power == "", 0).otherwise(power.try_cast("int"))
    whole = F.length(F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1))
    return (fraction - exponent <= 18) & (whole + exponent <= 20) & ~text.rlike(r"[eE][+-]?[0-9]{7,}$")


def needs_python(text: Column, stripped: bool = False) -> Column:
    """Whether a text may hold a number that only the slow path reads exactly."""
    t = text if stripped else strip(text)
    # Nested conditions: what stands behind an "and" may be computed for every cell.
    narrow = F.when(t.rlike(NUMBER), _fits(t)).otherwise(False)
    wide = F.when(t.rlike(WIDE_NUMBER), t.rlike(r"\p{Nd}") & ~narrow).otherwise(False)
    return F.when(may_be_number(t), F.when(t.rlike(PLAIN), False).otherwise(wide)).otherwise(False)


def needs_nfc(text: Column) -> Column:
    """Whether a text isn't ASCII alone."""
    return (F.octet_length(text) > F.char_length(text)) | ~F.is_valid_utf8(text)


def text_number(stripped: Column, slow: bool = False) -> Column:
    """The number that a stripped text reads as, or null."""
    held = F.when(stripped.rlike(PLAIN), True).otherwise(F.when(stripped.rlike(NUMBER), _fits(stripped)).otherwise(False))
    fast = F.when(may_be_number(stripped), F.when(held, stripped.try_cast(DEC)))
    return F.coalesce(fast, _slow_number(F.when(needs_python(stripped, True), stripped))["number"]) if slow else fast


#: Doubles that are a whole number of millionths of at most 15 digits; the closest double to such a number reads back as that number.
MILLION, EXACT_LIMIT = 1_000_000, 1e15


def millionths(value: Column) -> Column:
    """A double's millionths as a long where they are exact, else null."""
    wide = value.cast("double")
    scaled = F.rint(wide * float(MILLION))
    return F.when((F.abs(scaled) < EXACT_LIMIT) & (scaled / float(MILLION) == wide), scaled.cast("long"))


def number(value: Column, kind: T.DataType, slow: bool = False) -> Column:
    """The cell's number as DECIMAL(38,18), null where it has none. Booleans and times have none."""
    if isinstance(kind, T.StringType):
        return text_number(strip(value), slow)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = value.cast("double")
        return F.when(F.isnan(wide) | (F.abs(wide) == float("inf")), None).otherwise(wide.cast("string").try_cast(DEC))
    if is_numeric(kind):
        return value.try_cast(DEC)
    return F.lit(None).cast(DEC)


def plain_text(number_: Column) -> Column:
    """Plain decimal text of a DECIMAL(38,18)."""
    return F.rtrim(F.rtrim(F.bround(number_, 6).cast("decimal(38,6)").cast("string"), F.lit("0")), F.lit("."))


def canonical_text(stripped: Column) -> Column:
    """The canonical text of a stripped text that needs no Python path."""
    return F.coalesce(plain_text(text_number(stripped)), stripped)


def canonical(value: Column, kind: T.DataType, slow: bool = False, nfc: bool = False) -> Column:
    """The cell's canonical text; booleans as true and false; null for null.

    slow and nfc add the Python paths that a text column needs if some of its cells
    satisfy needs_python or needs_nfc.
    """
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(value == F.date_trunc("DAY", value), F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = value.cast("double")
        odd = F.when(F.isnan(wide), "nan").when(wide == float("inf"), "inf").when(wide == float("-inf"), "-inf")
        return F.coalesce(odd, plain_text(number(value, kind)))
    if is_numeric(kind):
        return plain_text(number(value, kind))
    if isinstance(kind, T.StringType):
        text = strip(F.when(needs_nfc(value), _nfc(F.when(needs_nfc(value), value))).otherwise(value) if nfc else value)
        exact = [_slow_number(F.when(needs_python(value), strip(value)))["text"]] if slow else []
        return F.coalesce(plain_text(number(value, kind)), *exact, text)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    return strip(_as_python_text(value))


def day_key(value: Column, kind: T.DataType) -> Column:
    """UTC day of a typed date or time, or of ISO-shaped text; else null."""
    if is_temporal(kind):
        return F.date_format(value, "yyyy-MM-dd")
    return text_day(strip(value)) if isinstance(kind, T.StringType) else F.lit(None).cast("string")


def text_day(t: Column) -> Column:
    """UTC day of a stripped ISO-shaped text; else null."""
    shaped = (F.substring(t, 5, 1) == "-") & (F.length(t) >= 10)
    return F.when(shaped, _iso_day(t))


def _iso_day(t: Column) -> Column:
    bare = F.when(t.rlike(ISO_DATE), F.date_format(t.try_cast("date"), "yyyy-MM-dd"))
    return F.coalesce(bare, F.when(t.rlike(ISO_TIME), F.date_format(F.regexp_replace(t, "^([0-9-]{10})[T ]([0-9]{2}:[0-9]{2})(?=Z|[+-]|$)", "$1T$2:00").try_cast("timestamp"), "yyyy-MM-dd")))


def is_grouped(value: Column, kind: T.DataType) -> Column:
    return strip(value).rlike(GROUPED) if isinstance(kind, T.StringType) else F.lit(False)


def json_leaf(text: Column, kind: T.DataType) -> Column:
    """A canonical cell of a column of that kind as JSON: text escaped minimally with lower-case codes, booleans bare, null for null."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(text, F.lit("null"))
    if is_numeric(kind) or is_temporal(kind):
        return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))
    quoted = F.to_json(F.array(text))
    lowered = quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    plain_ = F.concat(F.lit('"'), text, F.lit('"'))
    return F.coalesce(F.when(~text.rlike(r"[\x00-\x1f\"\\]"), plain_).when(text.rlike(r"[\x00-\x1f]"), lowered).otherwise(quoted), F.lit("null"))


def period_key(created: Column, granularity: str) -> Column:
    """Day, ISO week, month or quarter of a UTC time."""
    if granularity == "day":
        return F.date_format(created, "yyyy-MM-dd")
    if granularity == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), created), F.weekofyear(created))
    if granularity == "month":
        return F.date_format(created, "yyyy-MM")
    if granularity == "quarter":
        return F.concat(F.date_format(created, "yyyy"), F.lit("-Q"), F.quarter(created))
    raise ValueError(f"unknown granularity: {granularity}")


def short_hash(value: Column) -> Column:
    """First four and last two characters of a value of 11 or more."""
    return F.when(F.length(value) > 10, F.concat(F.substring(value, 1, 4), F.lit("..."), F.substring(value, -2, 2))).otherwise(value)


def signed(value: Column) -> Column:
    """Plain text with a plus for positive numbers."""
    return F.concat(F.when(value > 0, "+").otherwise(""), plain_text(value))


def percent(delta: Column, base: Column) -> Column:
    """Signed percentage of the base's size, one place, half-even; null for base 0."""
    share = F.bround(F.abs(delta) / F.nullif(F.abs(base), F.lit(0)).cast("decimal(38,6)") * 100, 1).cast("decimal(30,1)")
    return F.concat(F.when(delta < 0, "-").otherwise("+"), share.cast("string"), F.lit("%"))
