"""The corpus pipeline: documents in, packed pieces of clean, distinct text out.

Each stage takes the documents its predecessor kept. Results of one stage are written as
Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import jaccard, language_id, packing, spans, toxicity
from tallyline.llm.common import free_name, materialise, remainder
from tallyline.llm.queries import tokenizer
from tallyline.llm.tables import table

#: SQL can express neither the models nor the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a probability of one half or more.

    The model learns from those with crc32(doc_id) mod 4 other than 2. Null, empty and letterless
    texts have no language and go; rows with a null doc_id are judged and teach nothing; repeated rows stay.
    """
    model = language_id.learn(docs.filter(remainder("doc_id", 4) != 2))
    lang, score = free_name(docs.columns, "_lang_pred"), free_name(docs.columns, "_lang_score")
    found = language_id.identify(docs, model, lang_name=lang, score_name=score)
    return found.filter(language_id.accepted(F.col(lang), F.col(score))).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from labelled documents among these.

    Null and empty texts score 0 and stay; without labels of both kinds everything stays.
    """
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    name = free_name(docs.columns, "_toxic_score")
    return toxicity.score(docs, model, name=name).filter(F.col(name) < 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar ones: that with the smallest doc_id, null last.

    A row is told by its doc_id and its text, so other texts under one doc_id, or without one,
    are documents of their own. Texts without words have no class: equal ones under one doc_id
    count once, those with a null doc_id stay.
    """
    no_id = F.col("doc_id").isNull()
    row = F.struct(no_id.alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("text"))
    name, bare, own = (free_name(docs.columns, n) for n in ("_row", "_wordless", "_own"))
    named = docs.withColumn(name, row)
    found = jaccard.similar(named, key=name)
    first = found.filter(F.col(name) == F.col("class_id")).select(name, F.col("node").isNull().alias(bare)).distinct()
    kept = named.join(first, name).withColumn(own, F.when(no_id & F.col(bare), F.monotonically_increasing_id()))
    return kept.dropDuplicates([name, own]).select(*docs.columns)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences of repeated spans; n_chars follows the text, null for a null one."""
    cleaned = spans.remove_repeated(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, as op2's query returns them; null and empty texts have a piece of one token."""
    pieces = packing.pack(docs, tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("sentence_spans", drop_repeated_spans),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
