"""Threshold search, prefix trie and bin completion against brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import common, completion, prefix_trie, threshold, tokens

ODD = ["", " ", "İ. X", "é. a", "<|startoftext|>a b<|endoftext|>.", "it's DON'T they'll.", "½. ²x a.b,,.. ,", "a  b\n\n c \n d\x1cx  y  ", "ǅ. ſ. ß.", "日本語. ñandú,", "x́ ́a", "ÀÉ.,. Σ. ΑΣ.", "😀.", "Å. K.", "x" * 9000, "word, " * 4000]


# bin completion ---------------------------------------------------------------


def fewest(lengths, size):
    """Sequences of the best packing, every one tried."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(order):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= order[k]}.values():
            place(k + 1, [r - order[k] if i == j else r for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, size - order[k]])

    place(0, [])
    return best[0]


def test_completion_finds_the_fewest():
    rng, better = random.Random(5), 0
    for case in range(250):
        size = rng.choice([20, 30, 60, 100])
        lengths = [rng.randint(1, size) if case % 2 else rng.randint(size // 5, size // 2 + 3) for _ in range(rng.randint(0, 11))]
        found, first = completion.complete(lengths, size, nodes=20_000, tries=10**6), completion.best_fit(lengths, size)
        for packed in (found, first):
            assert sorted(x for f in packed for x in f) == sorted(lengths) and all(0 < sum(f) <= size for f in packed)
        assert completion.lower_bound(lengths, size) <= len(found) == fewest(lengths, size) <= len(first)
        better += len(found) < len(first)
    assert better  # best fit alone isn't enough
    assert len(completion.complete([1] * 5000, 100)) == 50


def test_fillings_are_maximal_and_undominated():
    stock = completion.Stock([7, 5, 4, 3, 2, 2], 20)
    found = completion.fillings(stock, 9, 20, 9, 10**6, enough=10**6)
    assert found[:2] == [(0, (7, 2)), (0, (5, 4))] and stock.counts[2] == 2
    # 4+3+2 is as long, but 5 could stand for 3+2; 3+2+2 leaves room for 2 in place of nothing shorter
    assert (0, (4, 3, 2)) not in found and all(sum(f) + w == 9 for w, f in found)
    assert completion.fillings(completion.Stock([9, 5, 4], 20), 9, 20, 9, 100) == [(0, (9,))]


def test_encoder_agrees_with_the_tokenizer(tokenizers_path):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizers_path("word_bpe_49k.json")), tokens.encoder(tokenizers_path("word_bpe_49k.json"))
    rng = random.Random(2)
    fuzz = ["".join(rng.choice("aBé Ωs'.,\n\t½7́İ-日<|>") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    ids, lengths = own.encode(ODD + fuzz, None)
    stops = np.cumsum(lengths)
    for text, stop, n in zip(ODD + fuzz, stops, lengths, strict=True):
        assert ids[stop - n : stop].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode(["a", ""], 0)[1].tolist() == [2, 1] and isinstance(own, tokens.BlankEncoder)
    assert not isinstance(tokens.encoder(tokenizers_path("byte_bpe_50k.json")), tokens.BlankEncoder)


def test_completion_packs_every_token_once(spark, tokenizers_path):
    from tokenizers import Tokenizer

    path = tokenizers_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate(ODD * 2)] + [(None, None, "y"), (None, "a b", "y"), (100, "a", "z"), (100, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Piece string").repartition(3)
    got = completion.pack(df, path, size=64, pool_tokens=300).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 64 and r.start == 64 * r.piece
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in got) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for i, t in enumerate(ODD * 2):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        ids = b"".join(r.ids for r in parts)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 64 for r in parts[:-1])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and sum(r.length for r in parts) <= 64
    assert completion.pack(df.limit(0), path).count() == 0


# threshold search ---------------------------------------------------------------


def ranked(docs, items, k=10):
    """The formula, document by document."""
    cut = lambda t: threshold.TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(key, Counter(cut(t))) for key, t in docs if cut(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for key, t in items:
        asked.setdefault(key, set()).update(cut(t))
    out = []
    for key, terms in asked.items():
        scores = []
        for doc, c in held:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t]), doc))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(key, n, doc, s) for n, (s, doc) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block_terms", "shard_postings"), [(200_000, 1_000_000), (9, 20)])
def test_search_agrees_with_brute_force(spark, block_terms, shard_postings):
    rng = random.Random(block_terms)
    words = [f"w{i}" for i in range(40)] + ["É", "Ünï", "42", "日本"]
    text = lambda n: "".join(rng.choice(words)[: rng.randint(1, 4)].replace("w", rng.choice("wW")) + rng.choice([" ", "\n", ", ", "\x00", "\t"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 10, 60]))) for i in range(120)] + [(None, text(20)), (None, None), (7, "w1 w1"), (7, "w1 w1"), (500, None), (501, "!!"), (502, "w3 " * 20_000)]
    docs += [(600 + i, "w5 w6 w7") for i in range(25)]  # ties
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(90, None), (91, "!"), (92, "w5"), (92, "w6 W6"), (None, "w7"), (93, "nowhere")]
    found = threshold.search(
        spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, Score string, item_id int").repartition(4),
        spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string"), block_terms=block_terms, shard_postings=shard_postings,
    )
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, items)


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert threshold.search(docs.limit(0), items).collect() == [] == threshold.search(docs, items.limit(0)).collect()
    assert [f.dataType.simpleString() for f in threshold.search(docs, items.limit(0)).schema] == ["int", "int", "bigint", "bigint"]


def test_lists_are_not_read_to_their_end():
    rng = np.random.default_rng(3)
    n, v = 4000, 30
    terms = np.sort(rng.random((n, v)).argsort(axis=1)[:, :10], axis=1)
    impacts = rng.integers(1, 1000, n * 10).reshape(n, 10)
    impacts[:20] *= 50  # as planted passages: some documents stand out
    shard = threshold.Shard(np.arange(n + 1) * 10, terms.ravel().astype(np.int64), impacts.ravel().astype(np.int64), v)
    query, asked = np.arange(6), np.zeros(v, dtype=np.int64)
    asked[query] = 1
    full = (asked[terms] * impacts).sum(axis=1)
    docs, scores = shard.search(query, asked, 10, 0)
    assert (full[docs] == scores).all() and shard.seen.sum() < n / 4
    kth = np.sort(full)[-10]
    assert {*np.flatnonzero(full >= kth)} <= {*docs}


# prefix trie ---------------------------------------------------------------------


def nodes_of(rows):
    """Every node by its sequence of turns."""
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in held.items()}
    built = {}
    for c in held:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        built[c] = held.get(base, [])[:h] + held[c][h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    words = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in members if len(p) == len(path) + 1 and p[:-1] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(path))))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["owner", "depth", "parent_owner", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("block", "most"), [(4096, 10_000), (2, 3)])
def test_trie_agrees_with_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    numbered = common.numbered
    monkeypatch.setattr(prefix_trie, "numbered", lambda *a: numbered(*a, most=most))
    rng = random.Random(block)
    rows = []
    for c in [*range(0, 50), -3, -25, 103, 2000, 2019]:
        if c in (20, 100):  # families without their first
            continue
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a b", "a  b\tc", "d", None])) for t in range(rng.choice([1, 2, 3, 5, 8]))]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 2, "x", "tie"), (None, 1, "user", "lost"), (41, 9, "u", "w " * 30_000)]
    rows += [(c, t, "user", f"same {t}") for c in range(60, 75) for t in range(6)]  # copies
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, Depth int").repartition(3)
    turns = common.materialise(prefix_trie.read(df, "conv_id", "turn", "role", "text"), "test-turns")
    found = prefix_trie.trie(*prefix_trie.regrouped(turns)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr) == nodes_of(rows)
    by_place = sorted(found, key=lambda r: r.preorder)
    assert [r.preorder for r in by_place] == list(range(len(found)))
    for r in found:  # intervals nest: a subtree's nodes are those from its top to its end
        inside = by_place[r.preorder : r.subtree_end + 1]
        assert all(x.depth > r.depth for x in inside[1:]) and sum(x.n_children == 0 for x in inside) == r.n_leaves


def test_trie_of_conversations_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "u", "c")], "conv_id long, turn long, role string, text string")
    turns = common.materialise(prefix_trie.read(df, "conv_id", "turn", "role", "text"), "test-turns")
    got = {(r.owner, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefix_trie.trie(*prefix_trie.plain(turns)).collect()}
    assert got == {(1, 0): (3, 1, 2, 2), (1, 1): (3, 2, 2, 2), (1, 2): (1, 0, 1, 0), (3, 2): (1, 0, 1, 0)}
    none = common.materialise(prefix_trie.read(df.limit(0), "conv_id", "turn", "role", "text"), "test-turns")
    assert prefix_trie.trie(*prefix_trie.regrouped(none)).collect() == []
