"""Language identification by word-first backoff.

A known word counts with its log frequency in each language. A word that no
language knows is scored by its character n-grams instead: the longest order (five
characters first, then four, down to one) of which some n-gram is known decides.

Defined results: a null text or one without a letter gives ``und`` and score 0, as
does every text where nothing could be learned. Repeated rows are scored one by
one, an equal score goes to the language that sorts first, rows whose lang or text
is null teach nothing. Other columns of the input stay as they are; one that has the
name of a result raises ValueError.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, map_arrow, ranges, unit_hash, without_gc, word_ids

ORDERS = (5, 4, 3, 2, 1)
WORD = re.compile(r"[^\W\d_]+")
#: Bytes of text looked at together.
SLICE_BYTES = 4_000_000


def _grams(word: str, n: int) -> list[str]:
    edged = f"<{word}>"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, unit, n) of texts; size 0 marks words, others the n-gram's length."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, found in words.items():
            for size in (0, *ORDERS):
                units: dict[str, int] = {}
                for word, n in found.items():
                    for unit in _grams(word, size) if size else (word,):
                        units[unit] = units.get(unit, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(units), pa.string()), pa.array([size] * len(units), pa.int32()), pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())],
                    names=["lang", "size", "unit", "n"],
                )


class LanguageModel:
    """Log frequencies by unit, in Arrow and numpy arrays, as executors unpickle them in every task."""

    def __init__(self, counts: Iterable[tuple[str, int, str, int]]):
        rows = list(counts)
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        totals = Counter()
        places: dict[int, dict[str, int]] = {size: {} for size in (0, *ORDERS)}
        for lang, size, unit, n in rows:
            totals[size, lang] += n
            places[size].setdefault(unit, len(places[size]))
        self.units = {size: pa.array(list(table), pa.string()) for size, table in places.items()}
        self.logs = {size: np.tile(np.array([-math.log(totals[size, lang] + 1000.0) for lang in self.langs], dtype=np.float32), (len(table), 1)) for size, table in places.items()}
        for lang, size, unit, n in rows:
            self.logs[size][places[size][unit], at[lang]] += math.log(n + 1.0)

    def _known(self, size: int, units: list[str]) -> np.ndarray:
        """Places of units in the table of their size, -1 for unknown ones."""
        found = pc.index_in(pa.array(units, pa.string()), value_set=self.units[size])
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log frequencies by word and language, each word's by the first table that knows it; 0 if none does."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        known = self._known(0, words)
        out[known >= 0] = self.logs[0][known[known >= 0]]
        left = np.flatnonzero(known < 0)
        for size in ORDERS:
            if not len(left):
                break
            grams = [_grams(words[i], size) for i in left]
            sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
            places = self._known(size, [g for own in grams for g in own])
            row = np.repeat(np.arange(len(left)), sizes)[places >= 0]
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[left[row[first]]] = np.add.reduceat(self.logs[size][places[places >= 0]], first, axis=0) / size
            left = np.delete(left, np.unique(row))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """texts: an Arrow string array, nulls as empty texts."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        for low, high in ranges(texts, SLICE_BYTES) if self.langs else ():
            ids, counts, words = word_ids(texts.slice(low, high - low), WORD)
            rows = np.flatnonzero(counts)
            if not len(rows):
                continue
            table = self.score_words(words)
            starts = (np.cumsum(counts) - counts)[rows]
            letters = np.add.reduceat(np.array([any(map(str.isalpha, w)) for w in words])[ids], starts, dtype=np.int64)
            total = np.stack([np.add.reduceat(table[:, k][ids], starts, dtype=np.float64) for k in range(len(self.langs))], axis=1)
            total = np.exp(total - total.max(axis=1, keepdims=True))
            total /= total.sum(axis=1, keepdims=True)
            for i, has, k, p in zip(rows + low, letters, total.argmax(axis=1), total.max(axis=1), strict=True):
                if has:
                    langs[i], scores[i] = self.langs[k], float(p)
        return langs, scores


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 400, max_chars: int = 20_000) -> LanguageModel:
    """Fits on about docs_per_lang rows of each language, of at most max_chars characters, chosen by a hash of the key.

    The sample bounds the model, however large the input is; every word and n-gram of it is kept.
    Of rows that share a key and a language the smallest text teaches.
    """
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) <= max_chars))
    held = {r[0]: r[1] for r in usable.groupBy(key, lang).agg(F.lit(1)).groupBy(lang).count().collect()}
    if not held:
        return LanguageModel([])
    share = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, min(1.0, docs_per_lang / n))])
    sample = usable.filter(unit_hash(key) < F.element_at(share, F.col(lang))).groupBy(key, lang).agg(F.min(text).alias("text")).select("text", F.col(lang).alias("lang"))
    units = map_arrow(sample, _counts, "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))
    found = units.orderBy("lang", "size", "unit").toArrow()
    return LanguageModel(zip(*(c.to_pylist() for c in found.columns), strict=True))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior probability (0 to 1) added."""
    fields = [*docs.schema.fields]
    if {lang_name.lower(), score_name.lower()} & {f.name.lower() for f in fields}:
        raise ValueError(f"the input has a column named {lang_name} or {score_name}; give other names")
    at = [f.name for f in fields].index(text)
    schema = docs.select("*", F.lit("").alias(lang_name), F.lit(0.0).alias(score_name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in batches:
                texts = arrow_texts(batch.column(at))
                for low, high in ranges(texts, SLICE_BYTES):
                    langs, scores = model.predict(texts.slice(low, high - low))
                    added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *added], names=[*batch.schema.names, lang_name, score_name])

    return map_arrow(docs, run, schema)


def accepted(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a filtering stage keeps a document: its language was found, with at least that probability."""
    return (lang != "und") & (score >= least)
