"""Operators on texts, pages, vectors and messages against brute force."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import jaccard, neighbours, quotes, spans, syncmers, warc


def words(rng, n, pool=None):
    pool = pool or ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    return [rng.choice(pool) for _ in range(n)]


# fingerprints -----------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = {i: " ".join(words(rng, rng.randint(0, 300))) for i in range(0, 60, 3)} | {61: "é😀 日本語 x", 62: "", 63: "Same text here, twice over and over", 64: "Same text here, twice over and over"}
    rows = [(i, t, 7) for i, t in texts.items()] + [(70, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entries int").repartition(4)
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    order = sorted(got, reverse=True)
    for at, i in enumerate(order):
        own, after = texts.get(i) or "", texts.get(order[(at + 1) % len(order)]) or ""
        cut = len(own) // 3
        assert got[i].edited == own[: len(own) - cut] + after[:cut]
        assert got[i].next_entries == got[order[(at + 1) % len(order)]].entries
        units = re.findall(r"[一-鿿]|[^\W_]+|[^\w\s]|_", own.lower())
        assert bool(got[i].entries) == bool(units)
    assert got[63].entries == got[64].entries
    near = syncmers.fingerprints(df).select("doc_id", F.length("text").alias("n"), syncmers.likeness(F.col("entries"), F.col("edited_entries")).alias("e"), syncmers.likeness(F.col("entries"), F.col("next_entries")).alias("x")).collect()
    assert all(r.e > 0.5 for r in near if r.n > 600) and all(r.x < 0.2 for r in near if r.n > 600)
    assert syncmers.fingerprints(df.limit(0)).count() == 0
    one = syncmers.fingerprints(df.filter("doc_id = 63")).first()
    assert one.next_entries == one.entries


def test_fingerprints_need_ordered_keys(spark):
    with pytest.raises(TypeError, match="whole number"):
        syncmers.fingerprints(spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string"))


def test_anchors_by_hand(spark):
    text = " ".join(f"w{i}" for i in range(40))
    inside = "zz yy xx " + text + " qq rr"
    a, b = (set(r[0]) for r in spark.createDataFrame([(text,), (inside,)], "t string").select(syncmers.entries(F.col("t"))).collect())
    assert len(a & b) >= len(a) - 2  # the same anchors wherever the passage stands


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_next_rows_over_buckets(spark, per_bucket):
    ids = [5, 5, -3, 0, None, 9, 2**62, 17, 12, None, 4]
    df = spark.createDataFrame([(k, f"t{i:02d}") for i, k in enumerate(ids)], "k long, t string").repartition(3)
    got = {r.t: r.next_t for r in syncmers.with_next(df, "k", ["t"], per_bucket).collect()}
    order = [f"t{i:02d}" for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0), i))]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


# spans ------------------------------------------------------------------------


def plain_tokens(text):
    """(token, start, whether a line or the text ends behind it): what stands between blanks, cut after ideographic stops."""
    found, held, at = [], "", 0
    for k, c in enumerate(text + "\n"):
        if c in " \t\r\n":
            found += [[held, at, False]] if held else []
            if c == "\n" and found:
                found[-1][2] = True
            held = ""
        else:
            at = at if held else k
            held += c
            if c in "。！？":
                found.append([held, at, False])
                held = ""
    return found


def plain_bounds(found):
    """(beginnings, ends after the last token, words before each token) by their rules."""
    import xxhash

    tokens = [t for t, _, _ in found]
    weight = [max(1, len(t) // 6 if len(t) > 40 else 0) for t in tokens]
    ends, sentence = set(), []
    for k, (t, _, last) in enumerate(found):
        sentence.append(k)
        if last or t.rstrip("\"'”’»)]").endswith((".", "!", "?", "…", "。", "！", "？")):
            ends.add(k + 1)
            if sum(weight[i] for i in sentence) > spans.LONG:
                ends |= {i + 1 for i in sentence if (xxhash.xxh64_intdigest(tokens[i].lower()) >> 7) % spans.CUT == 0}
            sentence = []
    begins = {0, *ends, *(k for k, t in enumerate(tokens) if t[0].isupper())} - {len(tokens)}
    before = [0]
    for w in weight:
        before.append(before[-1] + w)
    return sorted(begins), sorted(ends), before


def brute_force(rows, least_words, order=None):
    """Rows (key, text) without the tokens of every run, of all lengths, that isn't the first of its kind; order: of texts under one key."""
    places = collections.defaultdict(list)
    ids = sorted({(k is None, k or 0, t) for k, t in rows if t}, key=lambda r: r[:2])
    for row in ids:
        found = plain_tokens(row[2])
        tokens = [t.lower() for t, _, _ in found]
        begins, ends, before = plain_bounds(found)
        for i in begins:
            for j in ends:
                if j > i and before[j] - before[i] >= least_words and sum(i < e <= j for e in ends) >= 2:
                    places[tuple(tokens[i:j])].append((row, i, j))
    gone = collections.defaultdict(set)
    for found in places.values():
        head = min(found, key=lambda f: (f[0][:2], (order or {}).get(f[0]), f[1]))[:2]
        for row, i, j in found:
            if (row, i) != head:
                gone[row].update(range(i, j))
    out = []
    for k, t in rows:
        row = (k is None, k or 0, t)
        if t and gone[row]:
            starts = [s for _, s, _ in plain_tokens(t)] + [len(t)]
            t = (t[: starts[0]] + "".join(t[starts[i] : starts[i + 1]] for i in range(len(starts) - 1) if i not in gone[row])).strip()
        out.append((k, t))
    return sorted(out, key=repr)


def test_tokens_are_those_of_a_plain_loop():
    for text in ["", "One. Two!  Three\nfour\t\tFive six. ", "no stop", "日本。語！です", " lead\r\nTrail ", " \n ", "x" * 50, "。。a b。c", "a\u00a0b \u2003c"]:
        expected = plain_tokens(text)
        assert [[m.group(), m.start()] for m in spans.TOKEN.finditer(text)] == [t[:2] for t in expected], text
        tokens = spans.Tokens(pa.array([text, "z", text]))
        assert np.bincount(tokens.text, minlength=3).tolist() == [len(expected), 1, len(expected)]
        assert all(tokens.closed[k] for k, t in enumerate(expected) if t[2])


@pytest.mark.parametrize("keys", ["unique", "repeated"])
def test_spans_against_brute_force(spark, keys):
    rng = random.Random(77)
    # Sentences end alike wherever they stand, so that the shortest runs cover what all runs cover.
    pool = [" ".join(words(rng, rng.randint(1, 9))) + rng.choice([".", ".", "!", "…", "\n", " 終。"]) for _ in range(60)]
    pool = [p.capitalize() if rng.random() < 0.5 else p for p in pool] + [" ".join(words(rng, 50)) + ".", "Wort" * 20 + "?", "one two " * 20 + "\n"]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 7))]
        if i % 2:
            at = rng.randrange(len(pool) - 8)
            parts[1:1] = pool[at : at + rng.randint(3, 8)]
        text = rng.choice([" ", "  ", "\t"]).join(re.sub(r"(?<=\w)[abc]", lambda m: m[0].upper(), p) if i % 9 == 8 else p for p in parts)
        key = i if keys == "unique" else rng.choice([None, 1, 2, i])
        rows.append((key, text))
    rows += [rows[3], rows[3], rows[5]] if keys == "repeated" else [(100, ""), (101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text) for r in spans.remove_repeated(df, least_words=12).collect()]
    named = df.select("*", spans._identity("doc_id", "text", False)["row"].alias("row")).collect()
    expected = brute_force(rows, 12, {(r.doc_id is None, r.doc_id or 0, r.text): r.row for r in named})
    assert sorted(got, key=repr) == expected and expected != sorted(rows, key=repr)


def test_common_runs_are_dealt_to_groups(spark):
    rng = random.Random(78)
    line = " ".join(words(rng, 8)).capitalize() + ". " + " ".join(words(rng, 26)).capitalize() + ". "
    rows = [(i, line + " ".join(words(rng, 12)) + f" {line if i % 7 == 0 else ''}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    drawn = spans.spans(df, unique=True)
    assert spans._common(drawn).count() > 0
    got = sorted(((r.doc_id, r.text) for r in spans.remove_repeated(df).collect()), key=repr)
    assert got == brute_force(rows, spans.LEAST_WORDS)


def test_a_clash_of_names(spark):
    with pytest.raises(ValueError, match="Gone"):
        spans.remove_repeated(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, gone int"), removed_name="Gone")


def test_repeated_passages_go(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join(words(rng, n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (6, 14, 9, 17, 11))
    own = {i: [" ".join(sentence(rng.randint(4, 15)) for _ in range(6)) for _ in range(2)] for i in range(12)}
    texts = {i: f"{a[:-1]} {passage} {b[0].lower()}{b[1:]}" if i % 3 == 0 else f"{a} {b}" for i, (a, b) in own.items()}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(20, None, "x", 1), (21, "", "x", 1), (22, "Ok. Yes. No.", "x", 1), (23, "Ok. Yes. No.", "x", 1), (0, texts[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _drop string, _KEY int").repartition(3)
    got = collections.defaultdict(list)
    for r in spans.remove_repeated(df).collect():
        got[r.doc_id].append(r.text)
    assert got[0] == [texts[0]] * 2 and got[20] == [None] and got[21] == [""] and got[22] == got[23] == ["Ok. Yes. No."]
    inner = passage.split(". ", 1)[1]
    for i in range(1, 12):
        text = got[i][0]
        if i % 3:
            assert text == texts[i]
        else:
            held = sum(p in text for p in inner.split(". "))
            assert held == 0 and own[i][0][:-20] in text and own[i][1][20:] in text
    assert spans.remove_repeated(df.limit(0)).count() == 0


def test_a_passage_without_stops_goes(spark):
    rng = random.Random(9)
    passage = words(rng, 90)
    rows = [(i, " ".join(words(rng, 60) + passage + words(rng, 60))) for i in range(4)]
    got = {r.doc_id: r.text for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 4):
        left = len(got[i].split())
        assert 100 < left < 160 and got[i].startswith(rows[i][1][:150]) and got[i].endswith(rows[i][1][-150:])


def test_runs_by_hand():
    tokens = spans.Tokens(pa.array(["a b c. d e. f g h i. j.", "z.", ""]))
    a, b, _ = tokens.runs(6)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 9), (3, 9), (3, 10)]
    a, b, _ = spans.Tokens(pa.array(["a b c d e f g. h."])).runs(6)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 8)]


def test_the_short_end_of_a_repeated_passage_goes(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen. Apple pear plum fig grape lime kiwi melon nut. Red green blue pink black white."
    own = ["Alpha beta gamma delta.", "Sun moon star comet."]
    rows = [(i, f"{passage} {own[i]}") for i in range(2)] + [(2, passage)]
    got = {r.doc_id: r.text for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: own[1], 2: ""}


@pytest.mark.parametrize("key", [None, 7])
def test_texts_under_one_key_are_documents_of_their_own(spark, key):
    rng = random.Random(12)
    prose = lambda n: [" ".join(words(rng, 9)).capitalize() + "." for _ in range(n)]
    passage, own = prose(4), [prose(8), prose(8), prose(2)]
    first, again = " ".join([*prose(5), *passage]), " ".join([*own[0][:4], *passage, *own[0][4:]])
    rows = [(1, first), (key, again), (key, " ".join(own[1])), (key, " ".join(own[2])), (key, None), (key, ""), (key, again)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text, r.removed) for r in spans.remove_repeated(df, removed_name="removed").collect())
    assert got == collections.Counter([(1, first, 0), (key, " ".join(own[0]), 4), (key, " ".join(own[0]), 4), (key, rows[2][1], 0), (key, rows[3][1], 0), (key, None, 0), (key, "", 0)])


@pytest.mark.parametrize("blank", [" ", "\t"])
def test_cuts_do_not_depend_on_the_host(spark, blank):
    rng = random.Random(31)
    passage = [*words(rng, 29), "end.", *words(rng, 24), "stop."]
    rows = [(i, blank.join([*words(rng, 8), *passage])) for i in range(4)]
    got = {r.doc_id: r.text for r in spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(8 <= len(got[i].split()) < 32 for i in range(1, 4))


# WARC -------------------------------------------------------------------------


def test_warc_round_trip(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u1", inner), (2, "u\r\n2", None), (3, None, ""), (4, "u", "x" * 30_000), (5, "u", "é" * 100 + "WARC/1.0\r\n"), (6, "u", "x" * 30_000), (None, "q", "null"), (8, "u", "a\r\n\r\nWARC/1.0\r\n\r\n"), (9, "u", inner), (10, "u", inner * 2), (4, "u", "x" * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        for least in (0, 100):
            got = warc.round_trip(df, least_bytes=least, records_per_file=4).collect()
            assert len(got) == len(rows)
            html = {str(k) if k is not None else None: (h or "").encode() for k, _, h in rows}
            first = {}
            for k, _, h in rows:
                if k is not None:
                    first[(h or "").encode()] = min(k, first.get((h or "").encode(), k))
            for r in got:
                payload = html[r.record_id]
                assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
                again = len(payload) >= least and payload in first and str(first[payload]) != r.record_id
                assert (r.record_type, r.refers_to) == (("revisit", str(first[payload])) if again else ("response", None))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pointer_jumping(spark):
    chain = [("f", 10 * i, 10 * (i + 1) if i < 20 else None) for i in range(21)] + [("f", 15, 25), ("f", 25, 210), ("g", 5, 10), ("g", 0, 7)]
    got = {tuple(r) for r in warc.reachable(spark.createDataFrame(chain, "file string, at long, next long")).collect()}
    assert got == {("f", 10 * i) for i in range(21)} | {("g", 0)}


# vectors ------------------------------------------------------------------------


def brute_nearest(rows, every, k):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in usable:
        if q % every == 0:
            scored = sorted(((-(x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum()), i) for i, y in usable if i != q), key=lambda s: (round(s[0], 12), s[1]))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 9), (2002, [None] + [1.0] * 8), (2003, [float("nan")] + [1.0] * 8), (2050, [float("inf")] + [1.0] * 8), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, every=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(rows, 7, 5)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) > 0.95
    assert got[7] == want[7]  # the smallest ids among equal vectors
    small = neighbours.search(neighbours.build(df, neighbours.fit(df, "vec_id", "embedding"), "vec_id", "embedding"), neighbours.fit(df, "vec_id", "embedding"), F.col("id") % 7 == 0, depth=50, block=100).collect()
    assert sum(r.vec_id in want[r.query_id] for r in small) / sum(map(len, want.values())) > 0.95  # in seven blocks
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), every=50).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_sizes_of_vectors_do_not_matter(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    sizes = np.array([1e-300, 1e-200, 1.0, 1e200, 1e300])[rng.integers(0, 5, 60)]
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, plain = ({(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(frame(x), every=10).collect()} for x in (base * sizes[:, None], base))
    assert got.keys() == plain.keys() and all(got[q][0] == plain[q][0] and abs(got[q][1] - plain[q][1]) < 1e-12 for q in plain)


def test_codes_favour_the_parallel_part():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.normal(size=(8, 16))

    def parallel(threshold):
        model = neighbours.AnisotropicQuantiser(16, threshold).fit(x)
        codes = model.encode(x)
        approx = model.tables(x[:200])[np.arange(200)[:, None], np.arange(codes.shape[1]), codes[:200]].sum(axis=1)
        tables = model.tables(q)
        exact = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ x.T
        scanned = tables[:, np.arange(codes.shape[1])[:, None], codes.T].sum(axis=1)
        return np.abs(1 - approx).mean(), np.abs(scanned - exact).mean()

    assert parallel(0.5)[0] < parallel(0.0)[0] and parallel(0.2)[1] < 0.15


# near-duplicates --------------------------------------------------------------------


def brute_similar(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = collections.defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            names[find(i)].append(rows[i][0])
    return collections.Counter((rows[i][0], min(names[find(i)], default=None) if sets[i] else rows[i][0], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("options", [{}, {"bucket": 3, "tile": 4, "depth": 3}])
def test_similar_documents(spark, options):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    base = [words(rng, 120, pool) for _ in range(8)]
    rows = []
    for b in base:
        for k in range(rng.randint(1, 14)):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rows.append((len(rows), " ".join(w).upper() if k % 2 else " ".join(w)))
    shared = " ".join(base[0][:40])
    rows += [(100 + i, shared + " " + " ".join(words(rng, 60, pool))) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "!!"), (203, "one two"), (204, "One two."), (205, "one two three"), (None, " ".join(base[1])), (3, rows[3][1]), (3, "another text under the same key as before it")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, Node int").repartition(4)
    got = collections.Counter((r.doc_id, r.class_id, r.links) for r in jaccard.similar(df, **options).collect())
    assert got == brute_similar(rows)
    assert jaccard.similar(df.limit(0)).count() == 0


def test_runs_for_any_threshold(spark):
    assert jaccard.plan_runs(0.8, 0.999, 4) == (7, 4) and jaccard.plan_runs(1.0, 0.999, 4) == (1, 4)
    assert jaccard.plan_runs(0.3, 0.999, 4) == (171, 3)  # 337 with four levels
    assert jaccard.plan_runs(0.02, 0.999, 4) == (342, 0)
    for threshold in (0.9, 0.5, 0.3, 0.1, 0.02):
        runs, depth = jaccard.plan_runs(threshold, 0.99, 6)
        assert (1 - threshold * (1 - (1 - threshold) ** 2) ** depth) ** runs <= 0.01
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    shared = [words(rng, 30, pool) for _ in range(3)]
    rows = [(i, " ".join(words(rng, rng.randint(0, 30), pool) + shared[i % 3][: rng.randint(10, 30)])) for i in range(40)] + [(40, None), (41, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, links int").repartition(3)
    for threshold, bucket in ((0.3, 4), (0.02, 200)):
        got = collections.Counter((r.doc_id, r.class_id, r.links) for r in jaccard.similar(df, threshold=threshold, bucket=bucket, recall=0.99999).collect())
        assert got == brute_similar(rows, threshold)
    with pytest.raises(ValueError, match="threshold"):
        jaccard.similar(df, threshold=0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (101, 50), (101, 102), (7, 7)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "node long, root long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 100, 101, 102)}


# quotations -------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there, how do I parse mail?\nSecond line here is longer."),
        (1, 1, "assistant", "> Hello there, how do I parse mail?\nUse a parser library."),
        (1, 2, "user", "On Monday someone wrote:\n>> Hello there, how do I PARSE  mail?\n> Use a parser library.\nThanks a lot."),
        (1, 3, "user", "> Second line here is longer.\nah"),
        (None, 0, "u", "no conversation"), (None, 1, "u", "> no conversation"), (None, 1, "u", None), (2, None, "u", ""), (2, 0, "u", "> not found anywhere at all\nhm"), (3, 0, "u", "same"), (3, 0, "u", "same"), (4, 0, "u", "> " * 3000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, Position string").repartition(3)
    found = quotes.link(df).collect()
    alone = [r for r in found if r.conv_id is None]
    assert sorted(r.body for r in alone) == ["", "", "no conversation"] and all((r.position, r.parent, r.depth, r.place, r.linked) == (0, None, 0, 0, False) for r in alone)
    got = {(r.conv_id, r.position): r for r in found if r.conv_id is not None}
    assert len(found) == len(rows) == len(got) + len(alone)
    assert [(got[1, i].parent, got[1, i].linked, got[1, i].depth) for i in range(4)] == [(None, False, 0), (0, True, 1), (1, True, 2), (0, True, 1)]
    assert got[1, 2].body == "Thanks a lot." and got[1, 2].levels == 2 and [tuple(s) for s in got[1, 2].sources] == [(1, 1), (2, 0)]
    assert (got[2, 1].parent, got[2, 1].linked, got[2, 1].body) == (0, False, "hm")
    assert quotes.link(df.limit(0)).count() == 0


def test_quotes_of_parts_of_a_paragraph(spark):
    body = "First of all, install it. Then read the\nmanual twice. Ask us! Or do something else.\n- a list item\nThe end of it. Bye."
    asian = "今天天气很好。我们去公园散步。\n明天再说吧。"
    quoted = [
        "> Then read the manual twice. Ask us!", "> Then read\n> the manual\n> twice.", "> Or do something else.\n> - a list item\n> The end\n> of it.", "> first of all,  install it. Then read the", "> 我们去公园散步。", "> 我们去公园\n> 散步。明天再说吧。", "> 明天再说吧。",
        "> the manual twice. Ask", "> Then read the manual twice. Ask", "> Ask us!", "> 公园散步。",
    ]
    rows = [(1, 0, "u", body), (1, 1, "u", asian), (1, 2, "u", "Something else entirely.")] + [(1, 3 + i, "u", f"{q}\nyes {i}") for i, q in enumerate(quoted)]
    got = {r.position: (r.parent, r.linked) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[3 + i] for i in range(7)] == [(0, True)] * 4 + [(1, True)] * 3
    assert [got[10 + i] for i in range(4)] == [(9 + i, False) for i in range(4)]  # parts of sentences, and what is too short


@pytest.mark.parametrize("most", [1000, 3])
def test_conversations_in_reply_order(spark, most):
    rng = random.Random(2)
    rows, want = [(0, i, "u", f"plain {i}") for i in range(4)], [(0, i, i, i) for i in range(4)]
    for conv in range(1, 6):
        parents = [None] + [rng.choice([i, i, rng.randint(0, i)]) for i in range(30)]
        rows += [(conv, i, "u", (f"> This is message number {p} of it.\n" if p is not None else "") + f"This is message number {i} of it.") for i, p in enumerate(parents)]

        def walk(i, depth):
            yield i, depth
            for j, p in enumerate(parents):  # noqa: B023
                if p == i:
                    yield from walk(j, depth + 1)

        want += [(conv, k, i, depth) for k, (i, depth) in enumerate(walk(0, 0))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = quotes.link(df, most_in_a_row=most).orderBy("conv_id", "place").collect()
    assert got == quotes.conversations(df).collect()
    assert [(r.conv_id, r.place, r.position, r.depth) for r in got] == want
    assert all(">" not in r.body for r in got)


def test_large_conversations_are_numbered_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, 1, 2, 3, 4]), rng.choice("ab"), rng.choice(["x", "y", "z"])) for _ in range(400)] + [(9, 1, "a", "x")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(5)
    got, plain = (sorted(tuple(r) for r in quotes._positions(df, most).select("conv", "position", F.coalesce("turn", F.lit(-1)), "text", "role").collect()) for most in (50, 10_000))
    assert got == plain


def plain_links(rows, least_chars):
    """By brute force: the latest earlier message of the conversation whose body has a run of lines equal to a quotation of level 1."""
    fold = lambda lines: " ".join(" ".join(lines).lower().split())
    out, bodies = {}, collections.defaultdict(list)
    for conv, turn, _, text in sorted(rows):
        quoted, own = [], []
        for line in text.split("\n"):
            (quoted if line.startswith("> ") else own).append(line.removeprefix("> "))
        cited = fold(quoted)
        parent = None
        if len(cited) >= least_chars:
            for at, lines in enumerate(bodies[conv]):
                if any(fold(lines[i:j]) == cited for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)):
                    parent = at
        bodies[conv].append([x for x in own if x.strip()])
        out[conv, turn] = (parent, True) if parent is not None else (turn - 1 if turn else None, False)
    return out


def test_links_against_brute_force(spark):
    rng = random.Random(41)
    lines = [" ".join(words(rng, rng.randint(1, 6))) for _ in range(40)]
    rows = []
    for conv in range(25):
        said = []
        for turn in range(8):
            own = [rng.choice(lines) for _ in range(rng.randint(1, 6))]
            quoted = []
            if said and rng.random() < 0.7:
                source = rng.choice(said)
                at = rng.randrange(len(source))
                quoted = [f"> {x.title() if rng.random() < 0.3 else x}" for x in source[at : at + rng.randint(1, 4)]]
            rows.append((conv, turn, "u", "\n".join(quoted + own)))
            said.append(own)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.position): (r.parent, r.linked) for r in quotes.link(df).collect()}
    expected = plain_links(rows, 12)
    assert got == expected and sum(v[1] for v in expected.values()) > 50


def test_nested_levels_and_wraps_against_brute_force(spark):
    """Levels of up to three, quotations wrapped anew, sentences within lines, ideographs: each level's latest earlier origin."""
    rng = random.Random(43)
    fold = lambda text: re.sub(r"(?<=[一-鿿]) | (?=[一-鿿])", "", re.sub(r"\s+", " ", text.lower()).strip())
    sentence = lambda: (" ".join(words(rng, rng.randint(2, 6))) + ".") if rng.random() < 0.8 else "漢字" * rng.randint(2, 4)
    stock = [sentence() for _ in range(30)]
    rows, expected = [], {}
    for conv in range(12):
        said = []
        for turn in range(7):
            own = [rng.choice(stock) for _ in range(rng.randint(1, 5))]
            quoted, levels = [], {}
            if said and rng.random() < 0.8:
                for level in range(rng.randint(1, 3), 0, -1):
                    source = rng.choice(said)
                    at = rng.randrange(len(source))
                    part = source[at : at + rng.randint(1, 3)]
                    text = " ".join(part).split(" ")
                    width = rng.randint(1, 8)
                    quoted += ["> " * level + " ".join(text[i : i + width]) for i in range(0, len(text), width)]
                    levels[level] = fold(" ".join(part))
            body = []
            for x in own:  # several sentences on a line, or one
                body = [*body[:-1], body[-1] + " " + x] if body and x.endswith(".") and body[-1].endswith(".") and rng.random() < 0.4 else [*body, x]
            rows.append((conv, turn, "u", "\n".join(quoted + body)))
            found = {}
            for level, cited in levels.items():
                weight = len(cited) + 2 * len(re.findall(r"[一-鿿]", cited))
                for at, pieces in enumerate(said):
                    runs = [fold(" ".join(pieces[i:j])) for i in range(len(pieces)) for j in range(i + 1, len(pieces) + 1)]
                    if weight >= 12 and cited in runs:
                        found[level] = at
            expected[conv, turn] = sorted(found.items())
            said.append(own)
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert {(r.conv_id, r.position): sorted((x.level, x.origin) for x in r.sources or []) for r in got} == expected
    assert sum(map(len, expected.values())) > 40


def test_alike_lines_and_lines_that_all_quote(spark):
    lines = [f"- item number {i} of the list is here" for i in range(3000)]
    rows = [(1, 0, "u", "\n".join(lines))] + [(1, 1 + k, "a", "\n".join("> " + x for x in lines[k * 7 : k * 7 + 3 + k]) + "\nanswer") for k in range(20)]
    rows += [(2, k, "u", "> the very same line for all of us\nthe very same line for all of us") for k in range(3000)]
    rows += [(3, 0, "u", "the same short line here\n" * 2000), (3, 1, "a", "> the same short line here\n" * 700 + "yes"), (3, 2, "a", "> the same short line here\n" * 2001 + "no")]
    got = {(r.conv_id, r.position): (r.parent, r.linked) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[1, k] == (0, True) for k in range(1, 21)) and all(got[2, k] == (k - 1, True) for k in range(1, 3000))
    assert got[3, 1] == (0, True) and got[3, 2] == (1, False)


def test_long_messages_and_long_conversations(spark):
    rng = random.Random(42)
    long = [" ".join(words(rng, 8)) for _ in range(5000)]
    rows = [(1, 0, "u", "\n".join(long)), (1, 1, "u", "other words of some length here"), (1, 2, "u", "\n".join(f"> {x}" for x in long) + "\nyes"), (1, 3, "u", "\n".join(f"{'>' * (1 + k % 2)} {x}" for k, x in enumerate(long)))]
    rows += [(2, i, "u", f"message {i} of this long conversation" if i % 50 else f"> message {i // 2 + 1} of this long conversation\nanswer {i}") for i in range(12_000)]
    got = {(r.conv_id, r.position): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert (got[1, 2].parent, got[1, 2].linked, got[1, 3].parent) == (0, True, 0) and len(got) == len(rows)
    assert all(got[2, i].parent == (i // 2 + 1 if i and not i % 50 and (i // 2 + 1) % 50 else i - 1 if i else None) for i in range(12_000))
    assert sorted(got[2, i].place for i in range(12_000)) == list(range(12_000))


def test_anchors_are_those_of_a_plain_search(spark):
    import struct

    import regex
    import xxhash

    rng = random.Random(51)
    texts = [" ".join(words(rng, rng.choice([0, 1, 3, 4, 5, 6, 7, 40, 200]), ["al", "be", "ce", "da", "漢字", "e.f", "Gh,"])) for _ in range(80)]
    unit = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{N}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+|[^\s\p{L}\p{N}\p{M}]", regex.V1)
    long = lambda x: x - (1 << 64) if x >> 63 else x

    def plain(text):
        """(inner hashes that an entry takes, distance to the next anchor) of every anchor."""
        h = [long(xxhash.xxh64_intdigest(u.encode(), seed=42)) for u in unit.findall(text.lower())]
        if len(h) < 5:
            return [tuple(h)] if h else []
        g = []
        for a, b in zip(h, h[1:], strict=False):
            first = xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)
            g.append(long(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=first)))
        at = [i for i in range(len(h) - 4) if min(g[i : i + 4]) in (g[i], g[i + 3])]
        return [(g[i], g[i + 2], g[i + 3], (at[k + 1] if k + 1 < len(at) else i) - i) for k, i in enumerate(at)] if at else [tuple(h)]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r.e) for r in df.select("i", syncmers.entries(F.col("t")).alias("e")).collect()}
    named = {}
    for i, text in enumerate(texts):
        expected = plain(text)
        assert len(got[i]) == len(expected), text
        for entry, what in zip(got[i], expected, strict=True):
            assert named.setdefault(entry, what) == what
    assert len(named) == len({*named.values()}) > 100
