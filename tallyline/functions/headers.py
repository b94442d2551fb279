"""Column names: NFC, no outer white space, lower case, inner white space as one underscore."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(header: object) -> str:
    text = unicodedata.normalize("NFC", "" if header is None else str(header))
    return re.sub(r"\s+", "_", text.strip().lower())


def normalise_all(headers: Iterable[object]) -> list[str]:
    """The names, rejecting those that become equal."""
    names = [normalise(h) for h in headers]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"duplicate headers after normalisation: {', '.join(twice)}")
    return names


def rename(df: DataFrame) -> DataFrame:
    """df with normalised names; raises ValueError if two become equal."""
    return df.toDF(*normalise_all(df.columns))


def merge(df: DataFrame) -> DataFrame:
    """df with normalised names; of columns whose names become equal the last non-null value counts, as in records with such keys."""
    held: dict[str, list] = {}
    for at, name in enumerate(df.columns):
        held.setdefault(normalise(name), []).append(at)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[(F.coalesce(*[F.col(f"c{i}") for i in reversed(places)]) if len(places) > 1 else F.col(f"c{places[0]}")).alias(name) for name, places in held.items()])
