"""Language ID and toxicity: learned on one part of made-up rows, held to account on the other."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tallyline.llm import language_id, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"


def made_up(n=240, seed=1):
    rng = random.Random(seed)
    stems = {"aa": ["tok", "mir", "sel", "dron"], "bb": ["ulu", "ebo", "ika", "ozu"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        words = ["".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_held_out(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df.filter("doc_id % 4 <> 2"))
    found = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(found[i].lang_pred == lang and 0.5 < found[i].score <= 1 for i, _, lang in rows)
    # words never seen are placed by their n-grams
    new = spark.createDataFrame([(1, "dronselmirtokdron selseltok")], "doc_id long, text string")
    assert language_id.identify(new, model).first().lang_pred == "aa"


def test_language_edges(spark):
    model = language_id.learn(spark.createDataFrame(made_up(40), "doc_id long, text string, lang string"))
    texts = [None, "", "  \n", "123 ... !!", "½ ²", "tok " * 100_000, "漢字", "tok\x00mir", "tok", "tok"]
    df = spark.createDataFrame([(i if i else None, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, Extra string")
    rows = language_id.identify(df, model).collect()
    assert [r.lang_pred for r in rows[:5]] == ["und"] * 5 and all(r.score == 0 for r in rows[:5])
    assert rows[5].lang_pred == "aa" and rows[6].lang_pred in ("aa", "bb") and rows[8] [4:] == rows[9][4:]
    nothing = language_id.learn(df.limit(0))
    assert nothing.langs == [] and {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    try:
        language_id.identify(spark.createDataFrame([(1, "a", "b", "c")], SCHEMA), model)
        raise AssertionError("a clash of names went unnoticed")
    except ValueError as e:
        assert "score" in str(e)


def test_backoff_by_hand():
    model = language_id.LanguageModel([("x", 0, "ab", 3), ("y", 0, "ab", 1), ("x", 2, "<c", 5), ("y", 1, "z", 4)])
    words = model.score_words(["ab", "cq", "z", "ö"])
    assert words[0, 0] > words[0, 1] and words[1, 0] > words[1, 1] and words[2, 1] > words[2, 0] and not words[3].any()


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiou") + rng.choice("bdglmnrst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        bad = i % 2
        words = [rng.choice(plain) for _ in range(rng.randint(8, 120))]
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = "zork" + rng.choice(["", "en", "ost", "ify", "ling"])
        rows.append((i, " ".join(words), bad))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    learned = toxicity.learnable(labels)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in learned.collect())
    model = toxicity.train(docs, learned)
    again = toxicity.train(docs.unionByName(docs.limit(50)), learned)  # repeated rows teach once
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum((scores[i] >= 0.7) == bool(bad) for i, _, bad in held)
    assert right / len(held) > 0.9
    # the worst of all windows counts, wherever it stands in a long text
    clean = " ".join(r[1] for r in rows if not r[2])
    near = toxicity.score(spark.createDataFrame([(1, clean), (2, clean + " zorken " + clean), (3, clean + " zorken")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert near[1].score >= near[0].score and near[2].score >= near[0].score
    edges = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "!!", "c"), (None, "zork", "d"), (4, "zork", "e"), (4, "zork", "e")], "doc_id long, text string, Toxic string")
    got = [r.score for r in toxicity.score(edges, model).collect()]
    assert got[:3] == [0, 0, 0] and got[3] == got[4] == got[5] > 0
    assert toxicity.score(edges.limit(0), model).count() == 0
    unlabelled = toxicity.train(docs, learned.limit(0))
    assert {r.score for r in toxicity.score(edges, unlabelled).collect()} == {0.0}


def test_windows_cover_every_word():
    net = toxicity.GatedNetwork(window=5, step=3)
    counts = np.array([0, 1, 5, 6, 14])
    start, length, text = net.windows(counts)
    first = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        covered = {k for s, m, own in zip(start, length, text, strict=True) if own == t for k in range(s - first[t], s - first[t] + m)}
        assert covered == set(range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.GatedNetwork(buckets=64, char_dim=3, word_dim=2, hidden=3, window=4, step=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = ["ab cd ef gh ij kl", "cd cd ab", "kl"]
    labels = np.array([1, 0, 1], dtype=np.float32)
    ids, counts, words = toxicity.word_ids(pa.array(texts), toxicity.WORD)
    start, length, text = net.windows(counts)
    grads = net._backward(ids, start, length, text, labels, words)

    def loss():
        x = net._inputs(toxicity.WordTable(words, net.buckets)).astype(np.float64)
        at = net._at(ids, start, length, len(words))
        states = np.concatenate([net._run(g, at, way, None) for g, way in zip(net._gates(x), "fb", strict=True)], axis=2).astype(np.float64)
        logit = net._pool(states, at == len(words))[2]
        total = np.array([np.log(np.exp(logit[text == d]).sum()) for d in range(3)])
        return np.mean(np.log1p(np.exp(total)) - labels * total)

    for name in ("out", "v", "Uf", "Wb", "bf"):
        flat = net.p[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        before = flat[k]
        flat[k] = before + 1e-2
        up = loss()
        flat[k] = before - 1e-2
        down = loss()
        flat[k] = before
        assert abs((up - down) / 2e-2 - np.asarray(grads[name]).reshape(-1)[k]) < 5e-3, name


def test_half_a_window_lies_whole_in_some_window():
    model = toxicity.GatedNetwork()
    for count in (1, 13, 24, 25, 47, 200):
        start, length, _ = model.windows(np.array([count]))
        size = min(13, count)
        assert all(any(a <= i and i + size <= a + n for a, n in zip(start, length, strict=True)) for i in range(count - size + 1))


def plain_probability(net, words):
    """A window's probability, word by word and unit by unit."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, p = net.hidden, net.p
    mask = (1 << 64) - 1

    def bucket(gram):
        x = len(gram)
        for c in gram:
            x = ((x ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
            x ^= x >> 29
        return x % net.buckets

    inputs = []
    for w in words:
        edged = f"\x02{w}\x03"
        grams = [edged[i : i + n] for n in toxicity.GRAMS for i in range(len(edged) - n + 1)]
        chars = sum((p["chars"][bucket(g)].astype(np.float64) for g in grams), np.zeros(p["chars"].shape[1])) / np.sqrt(max(1, len(grams)))
        inputs.append(np.concatenate([chars, p["words"][zlib.crc32(w.encode()) % net.buckets]]))
    states = {}
    for way, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        state = np.zeros(h)
        for t in order:
            g, s = inputs[t] @ p[f"W{way}"] + p[f"b{way}"], state @ p[f"U{way}"]
            r, z = sig(g[:h] + s[:h]), sig(g[h : 2 * h] + s[h : 2 * h])
            state = (1 - z) * np.tanh(g[2 * h :] + r * s[2 * h :]) + z * state
            states[t, way] = state
    both = [np.concatenate([states[t, "f"], states[t, "b"]]) for t in range(len(words))]
    weights = np.exp([v @ p["v"] for v in both])
    return sig(sum(w * v for w, v in zip(weights / weights.sum(), both, strict=True)) @ p["out"] + p["bias"][0])


def test_scores_are_those_of_a_plain_forward_pass():
    rng = random.Random(5)
    net = toxicity.GatedNetwork(buckets=512, window=7, step=3, seed=4)
    net.trained = True
    texts = [" ".join("".join(rng.choice("abcdéß漢") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (0, 1, 2, 7, 8, 30)] + ["A!b  C", "..."]
    got = net.score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        words = toxicity.WORD.findall(text.lower())
        starts = sorted({min(k, max(len(words) - net.window, 0)) for k in range(0, max(len(words) - net.window, 0) + net.step, net.step)})
        expected = max((plain_probability(net, words[s : s + net.window]) for s in starts), default=0.0) if words else 0.0
        assert abs(score - expected) < 1e-4, text


def test_languages_are_those_of_a_plain_backoff():
    rng = random.Random(8)
    counts = {}
    for lang, letters in (("x", "abcde"), ("y", "cdefg"), ("z", "efghi")):
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
            for size in (0, *language_id.ORDERS):
                for unit in [word] if not size else [f"<{word}>"[i : i + size] for i in range(len(word) + 3 - size)]:
                    counts[lang, size, unit] = counts.get((lang, size, unit), 0) + 1
    model = language_id.LanguageModel([(*k, n) for k, n in counts.items()])
    totals = {}
    for (lang, size, _), n in counts.items():
        totals[size, lang] = totals.get((size, lang), 0) + n
    log = lambda lang, size, unit: np.log(counts.get((lang, size, unit), 0) + 1.0) - np.log(totals[size, lang] + 1000.0)

    def plain(text):
        words = language_id.WORD.findall(text.lower())
        if not words:
            return "und", 0.0
        sums = dict.fromkeys("xyz", 0.0)
        for w in words:
            for size in (0, *language_id.ORDERS):
                units = [w] if not size else [f"<{w}>"[i : i + size] for i in range(len(w) + 3 - size)]
                known = [u for u in units if any((lang, size, u) in counts for lang in "xyz")]
                if known:
                    for lang in "xyz":
                        sums[lang] += sum(log(lang, size, u) for u in known) / max(1, size)
                    break
        top = max(sums.values())
        best = min(k for k, v in sums.items() if v == top)
        return best, 1 / sum(np.exp(v - top) for v in sums.values())

    texts = [" ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["12 !", "ZZZ", ""]
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores, strict=True):
        expected = plain(text)
        assert lang == expected[0] and abs(score - expected[1]) < 1e-4, text


def test_a_score_depends_on_the_text_alone(spark):
    import random

    rows = toxic_rows()
    model = toxicity.GatedNetwork()
    model.train([r[1] for r in rows], np.array([r[2] for r in rows]), epochs=2)
    rng = random.Random(6)
    texts = [r[1] for r in rows[:150]] + ["zork", "a b", " ".join(r[1] for r in rows[:40]), "x " * 5000]
    alone = {t: float(model.score(pa.array([t]))[0]) for t in texts}
    for _ in range(20):
        some = rng.choices(texts, k=rng.randint(1, 80))
        assert model.score(pa.array(some)).tolist() == [alone[t] for t in some]
    df = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    for n in (1, 3, 7, 20):
        assert all(r.score == alone[r.text] for r in toxicity.score(df.repartition(n), model).collect())


def test_few_labels_teach():
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("al", "be", "ci", "do", "er", "fu")) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for k in range(260):
        own = [word() for _ in range(rng.randint(30, 200))]
        if k % 9 == 0:
            for bad in rng.sample(["zorken", "mugwum", "blixty", "krudge"], 2):
                own.insert(rng.randrange(len(own)), bad)
        texts.append(" ".join(own))
        labels.append(int(k % 9 == 0))
    model = toxicity.GatedNetwork()
    model.train(texts, np.array(labels))
    held = [" ".join(word() for _ in range(80)) for _ in range(40)]
    scores = model.score(pa.array(held + [t + " zorken " + t for t in held[:20]]))
    assert (scores[40:] >= 0.7).sum() >= 16 and (scores[:40] >= 0.7).sum() <= 2
