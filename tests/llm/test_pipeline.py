"""The pipeline's stages over made-up tables, each against a plain version of its rule."""

import random
import re

import pytest
from pyspark.sql import functions as F



def prose(rng, pool, n):
    return ". ".join(" ".join(rng.choice(pool) for _ in range(9)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    pools = {lang: ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(250)] for lang, stems in (("aa", ["tok", "mir", "sel", "dron", "va"]), ("bb", ["ulu", "ebo", "ika", "ozu", "ne"]))}
    rows, labels = [], []
    passage = prose(rng, pools["aa"], 8)
    for i in range(300):
        lang = ("aa", "bb")[i % 2]
        text = prose(rng, pools[lang], rng.randint(4, 12))
        bad = i % 5 == 4
        if bad:
            text = " ".join(w + (" zork" + rng.choice(["", "en", "ost"]) if k % 9 == 3 else "") for k, w in enumerate(text.split()))
        if i % 50 == 10:
            text = f"{text} {passage} {prose(rng, pools[lang], 3)}"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2], "copy", rows[i][4]) for i in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "aa", "s", 0), (2002, "12 34 !!", "bb", "s", 8), rows[0]]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, {i for i, _, bad in labels if bad}, passage


def test_stages(spark, corpus, tokenizers_path):
    import corpus_pipeline

    folder, rows, bad, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "ngram_jaccard", "sentence_spans", "packing"]

    docs = stages["language_id"](spark, docs, folder)
    kept = sorted(r.doc_id for r in docs.collect())
    assert docs.columns == columns and kept == sorted(r[0] for r in rows if r[0] not in (2000, 2001, 2002))

    docs = stages["toxicity"](spark, docs, folder)
    left = {r.doc_id for r in docs.collect()}
    clean = {r[0] for r in rows if r[0] < 1000} - bad
    assert docs.columns == columns and len(left & bad) <= 0.1 * len(bad) and len(clean - left) <= 0.03 * len(clean)

    docs = stages["ngram_jaccard"](spark, docs, folder).cache()
    once = sorted(r.doc_id for r in docs.collect())
    assert docs.columns == columns and len(once) == len(set(once))
    assert set(once) == {i for i in left if i < 1000 or i - 1000 not in left}

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = stages["sentence_spans"](spark, docs, folder).cache()
    after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert docs.columns == columns and after.keys() == before.keys()
    inner = passage.split(". ")[1:]
    holders = sorted(i for i, t in before.items() if all(s in t for s in inner))
    assert len(holders) > 2 and [i for i in holders if any(s in after[i][0] for s in inner)] == holders[:1]
    assert all(after[i][0] == t for i, t in before.items() if i not in holders) and all(n == len(t) for t, n in after.values())

    pieces = stages["packing"](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(after)
    for i in after:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert own[0].start == 0 and own[-1].start + own[-1].length == own[0].doc_tokens


def test_near_duplicates_under_one_key(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(6)]
    rows = [
        (1, texts[0]), (1, texts[1]), (1, None), (1, texts[1]), (5, texts[0].upper()), (5, texts[2]), (None, texts[3]), (None, texts[3]),
        (None, texts[3] + " zz"), (None, texts[4]), (None, texts[2]), (None, None), (None, None), (9, "!!"), (9, "!!"), (9, "??"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    threes = [r for r in got if r[1] and r[1].startswith(texts[3])]
    assert len(threes) == 1
    want = [(1, texts[0]), (1, texts[1]), (1, None), (5, texts[2]), (None, texts[4]), (None, None), (None, None), (9, "!!"), (9, "??")]
    assert sorted(got, key=repr) == sorted(want + threes, key=repr)


def test_stages_with_an_empty_table_and_clashing_columns(spark, corpus, tokenizers_path):
    import corpus_pipeline

    folder, rows, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = ["_id", "_n", "_key", "_Row", "_toxic_score", "_lang_pred", "_drop", "_removed", "hash", "node"]
    clashing = docs.filter("doc_id < 40 or doc_id is null").select("*", *[F.lit(7).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        got = stage(spark, clashing, folder)
        assert got.columns == clashing.columns and 0 < got.count() <= clashing.count() and got.filter("_n <> 7 or _id <> 7 or _key <> 7").count() == 0, name
    assert corpus_pipeline.pack(spark, docs.limit(0), folder).count() == 0
    assert {p.doc_id for p in corpus_pipeline.pack(spark, clashing, folder).collect()} == {r[0] for r in rows if r[0] < 40}


def test_run_is_the_stages_in_order(spark, corpus, tokenizers_path):
    import corpus_pipeline

    folder, _, _, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_every_operator_has_a_query():
    from tallyline.llm import queries

    names = [n for n in queries.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
