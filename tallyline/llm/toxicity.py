"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as an embedding of its own (hashed) beside one summed over its
character n-grams (hashed, two to five characters, word edges marked). Two gated
recurrent layers read a window of words in either direction, attention pools their
states, a logistic unit scores the window. Every text is covered by windows that
overlap by half, all of them are scored, and the text's score is that of its worst window.
The network is trained in numpy; in training a text's windows share its label by a
log-sum-exp, so that the windows at fault are found without being marked. As labels may be few, one
component of each embedding starts from how much more often the sample's texts labelled 1 hold the word or
n-gram than those labelled 0, in standard errors. Products are added up in a fixed
order and padding weighs nothing, so a score depends on the text alone, whatever it is scored with.

Defined results: null and empty texts and texts without a word score 0; repeated rows are
scored one by one. Without labels of both kinds every score is 0. A null key is held out. Other
columns are passed on; one that has the name of the score raises ValueError.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, discard_frames, gather, map_arrow, materialise, ranges, remainder, unit_hash, without_gc, word_ids

WORD = re.compile(r"\w+")
GRAMS = (2, 3, 4, 5)
#: Bytes of text scored at once.
SLICE_BYTES = 4_000_000


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, added up column by column: a row's result depends on that row alone, not on the batch's shape as BLAS's does."""
    out = x[..., :1] * w[0]
    for k in range(1, len(w)):
        out += x[..., k : k + 1] * w[k]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class WordTable:
    """Hashed features of distinct words: a bucket for the word, buckets for its character n-grams."""

    def __init__(self, words: list[str], buckets: int):
        self.n = len(words)
        raw = [w.encode() for w in words]
        self.own = np.fromiter(map(zlib.crc32, raw), dtype=np.int64, count=self.n) % buckets
        codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=self.n) + 2
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters up to the word's end
        word = np.repeat(np.arange(self.n), sizes)
        grams, words_at = [], []
        for size in GRAMS:
            if len(codes) < size:
                continue
            h = np.full(len(codes) - size + 1, size, dtype=np.uint64)
            for j in range(size):
                h = (h ^ codes[j : len(codes) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            fits = left[: len(h)] >= size
            grams.append((h[fits] % np.uint64(buckets)).astype(np.int32))
            words_at.append(word[: len(h)][fits])
        self.grams, self.word_of = grams, words_at

    def sums(self, table: np.ndarray) -> np.ndarray:
        """By word, the sum of its n-grams' rows, over the root of their number."""
        out = np.zeros((self.n, table.shape[1]), dtype=np.float32)
        count = np.zeros(self.n, dtype=np.float32)
        for grams, words in zip(self.grams, self.word_of, strict=True):
            if len(grams):
                first = np.flatnonzero(np.diff(words, prepend=-1))
                out[words[first]] += np.add.reduceat(table[grams], first, axis=0)
                count[words[first]] += np.diff(first, append=len(words))
        return out / np.sqrt(np.maximum(count, 1))[:, None]

    def gradients(self, d: np.ndarray, buckets: int) -> np.ndarray:
        """What sums() hands back to the table for gradients d by word."""
        count = sum((np.bincount(w, minlength=self.n) for w in self.word_of), np.zeros(self.n, dtype=np.int64))
        d = d / np.sqrt(np.maximum(count, 1))[:, None]
        out = np.zeros((buckets, d.shape[1]), dtype=np.float32)
        for grams, words in zip(self.grams, self.word_of, strict=True):
            for k in range(d.shape[1]):
                out[:, k] += np.bincount(grams, weights=d[words, k], minlength=buckets)
        return out


class GatedNetwork:
    """The network; its size is fixed by the constructor's parameters, whatever it learns from."""

    def __init__(self, buckets: int = 1 << 17, char_dim: int = 8, word_dim: int = 4, hidden: int = 6, window: int = 24, step: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets, self.hidden, self.window, self.step = buckets, hidden, window, step
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"chars": normal(buckets, char_dim, scale=0.1), "words": normal(buckets, word_dim, scale=0.1), "v": normal(2 * hidden, scale=0.3), "out": normal(2 * hidden, scale=0.5), "bias": np.array([-1.0], dtype=np.float32)}
        for way in "fb":
            self.p[f"W{way}"] = normal(char_dim + word_dim, 3 * hidden, scale=0.4)
            self.p[f"W{way}"][[0, char_dim], 2 * hidden] = 1  # what the components that start from counts say reaches a state
            self.p[f"U{way}"] = normal(hidden, 3 * hidden, scale=0.3)
            self.p[f"b{way}"] = np.zeros(3 * hidden, dtype=np.float32)
        self.trained = False

    # windows ---------------------------------------------------------------

    def windows(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and text of every window; the last of a text ends with it."""
        over = np.maximum(counts - self.window, 0)
        number = np.where(counts > 0, -(-over // self.step) + 1, 0)
        text = np.repeat(np.arange(len(counts)), number)
        k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        start = np.minimum(k * self.step, over[text])
        return start + (np.cumsum(counts) - counts)[text], np.minimum(counts, self.window)[text], text

    # forward ---------------------------------------------------------------

    def _inputs(self, table: WordTable) -> np.ndarray:
        return np.concatenate([table.sums(self.p["chars"]), self.p["words"][table.own]], axis=1)

    def _gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Input parts of the gates by word, and a last row for padding, whose update gate keeps the state."""
        out = []
        for way in "fb":
            g = np.vstack([_product(x, self.p[f"W{way}"]) + self.p[f"b{way}"], np.zeros((1, 3 * self.hidden), dtype=np.float32)])
            g[-1, self.hidden : 2 * self.hidden] = 30
            out.append(g)
        return out

    def _run(self, gates: np.ndarray, at: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of one direction, (steps, windows, hidden); at: word of each (step, window)."""
        h, n = self.hidden, at.shape[1]
        state, u = np.zeros((n, h), dtype=np.float32), self.p[f"U{way}"]
        states = np.empty((len(at), n, h), dtype=np.float32)
        for t in range(len(at)) if way == "f" else range(len(at) - 1, -1, -1):
            g, s = gates[at[t]], _product(state, u)
            rz = 1.0 / (1.0 + np.exp(-(g[:, : 2 * h] + s[:, : 2 * h])))
            r, z = rz[:, :h], rz[:, h:]
            new = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, r, z, new, s[:, 2 * h :]))
            state = new + z * (state - new)
            states[t] = state
        return states

    def _pool(self, states: np.ndarray, pads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = _product(states, self.p["v"][:, None])[..., 0]
        e[pads] = -np.inf
        a = np.exp(e - e.max(axis=0))
        a[pads] = 0  # exactly, so that it doesn't matter how many there are
        total, pooled = np.zeros(a.shape[1], dtype=np.float32), np.zeros(states.shape[1:], dtype=np.float32)
        for weight in a:  # step by step: sums over an axis take another order where there is one window alone
            total += weight
        a /= total
        for weight, state in zip(a, states, strict=True):
            pooled += weight[:, None] * state
        return a, pooled, _product(pooled, self.p["out"][:, None])[:, 0] + self.p["bias"][0]

    def _at(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
        steps = np.arange(int(length.max()))[:, None]
        return np.where(steps < length, ids[np.minimum(start + steps, len(ids) - 1)], pad)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The worst window's probability by text."""
        out = np.zeros(len(texts))
        for low, high in ranges(texts, SLICE_BYTES) if self.trained else ():
            ids, counts, words = word_ids(texts.slice(low, high - low), WORD)
            if not len(ids):
                continue
            gates = self._gates(self._inputs(WordTable(words, self.buckets)))
            start, length, text = self.windows(counts)
            order = np.argsort(length, kind="stable")
            logits = np.empty(len(start), dtype=np.float32)
            for k in range(0, len(order), 4096):
                own = order[k : k + 4096]
                at = self._at(ids, start[own], length[own], len(words))
                states = np.concatenate([self._run(g, at, way, None) for g, way in zip(gates, "fb", strict=True)], axis=2)
                logits[own] = self._pool(states, at == len(words))[2]
            worst = np.full(high - low, -np.inf)
            np.maximum.at(worst, text, logits)
            out[low:high] = np.where(counts > 0, _sigmoid(worst), 0.0)
        return out

    # training --------------------------------------------------------------

    def train(self, texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, negatives: int = 12, least_rounds: int = 40, seed: int = 11) -> None:
        """Adam on the log loss of texts; of a text labelled 0 some windows are drawn anew in each epoch."""
        if len({*labels.tolist()}) < 2:
            return
        rng = np.random.default_rng(seed)
        ids, counts, words = word_ids(pa.array(texts, pa.string()), WORD)
        self._start(ids, np.repeat(np.arange(len(texts)), counts), words, labels)
        start, length, text = self.windows(counts)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            yes, no = rng.permutation(np.flatnonzero(labels == 1)), rng.permutation(np.flatnonzero(labels == 0))
            rounds = max(least_rounds, -(-2 * max(len(yes), len(no)) // batch))
            for k in range(rounds):
                docs = np.concatenate([np.take(x, np.arange(k * batch // 2, (k + 1) * batch // 2), mode="wrap") for x in (yes, no)])
                own, doc = [], []
                for j, d in enumerate(docs):
                    some = np.arange(first[d], first[d + 1])
                    if not labels[d] and len(some) > negatives:
                        some = rng.choice(some, negatives, replace=False)
                    own.append(some)
                    doc += [j] * len(some)
                own, doc = np.concatenate(own), np.array(doc)
                if not len(own):
                    continue
                grads = self._backward(ids, start[own], length[own], doc, labels[docs].astype(np.float32), words)
                step += 1
                pace = rate * (1 - 0.8 * epoch / epochs)
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[name] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.trained = True

    def _start(self, ids: np.ndarray, doc: np.ndarray, words: list[str], labels: np.ndarray, most: float = 3.0, scale: float = 0.5) -> None:
        """First components of the tables: the log of the odds ratio over its standard error, 0 if it is below."""
        table = WordTable(words, self.buckets)
        grams, word_of = np.concatenate(table.grams), np.concatenate(table.word_of)
        order = np.argsort(word_of, kind="stable")
        ends = np.searchsorted(word_of[order], np.arange(len(words) + 1))
        grams = grams[order]
        starts, sizes = ends[:-1], np.diff(ends)
        texts = np.searchsorted(doc, np.arange(len(labels) + 1))
        counts = {name: np.full((2, self.buckets), 0.5) for name in ("words", "chars")}
        for k, label in enumerate(labels):  # a bucket counts once a text
            own = np.unique(ids[texts[k] : texts[k + 1]])
            counts["words"][int(label), np.unique(table.own[own])] += 1
            counts["chars"][int(label), np.unique(gather(grams, starts, sizes, own)[0])] += 1
        for name, (no, yes) in counts.items():
            z = (np.log(yes / ((labels == 1).sum() + 1)) - np.log(no / ((labels == 0).sum() + 1))) / np.sqrt(1 / yes + 1 / no)
            self.p[name][:, 0] = np.clip(z, 0, most) * scale

    def _backward(self, ids, start, length, doc, labels, words) -> dict[str, np.ndarray]:
        h, p = self.hidden, self.p
        at = self._at(ids, start, length, -1)
        used, inverse = np.unique(at, return_inverse=True)
        pad = int(used[0] == -1)
        at = inverse.reshape(at.shape) - pad
        real = used[pad:]
        at[at < 0] = len(real)
        table = WordTable([words[i] for i in real], self.buckets)
        x = self._inputs(table)
        gates, kept, states = self._gates(x), {"f": [], "b": []}, []
        for g, way in zip(gates, "fb", strict=True):
            states.append(self._run(g, at, way, kept[way]))
        states = np.concatenate(states, axis=2)
        a, pooled, logit = self._pool(states, at == len(real))
        top = np.full(len(labels), -np.inf, dtype=np.float32)
        np.maximum.at(top, doc, logit)
        weight = np.exp(logit - top[doc])
        sums = np.bincount(doc, weights=weight, minlength=len(labels))
        present = sums > 0
        total = np.where(present, np.where(present, top, 0) + np.log(np.maximum(sums, 1e-30)), 0)
        wrong = np.where(present, _sigmoid(total) - labels, 0) / len(labels)
        d_logit = (wrong[doc] * weight / sums[doc]).astype(np.float32)
        d_pool = d_logit[:, None] * p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * p["v"]
        grads = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()]), "v": np.einsum("tn,tnh->h", d_e, states)}
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            u, own = p[f"U{way}"], d_states[:, :, i * h : (i + 1) * h]
            d_gates, d_u, carry = np.zeros((len(real) + 1, 3 * h), dtype=np.float32), np.zeros_like(u), np.zeros((at.shape[1], h), dtype=np.float32)
            later = np.empty((*at.shape, 3 * h), dtype=np.float32)
            for t, before, r, z, new, s in reversed(kept[way]):
                d = own[t] + carry
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * s * r * (1 - r)
                d_s = np.concatenate([d_r, d_z, d_new * r], axis=1)
                d_u += before.T @ d_s
                carry = d * z + d_s @ u.T
                d_in = np.concatenate([d_r, d_z, d_new], axis=1)
                later[t] = d_in
            flat = at.ravel()
            for k in range(3 * h):
                d_gates[:, k] = np.bincount(flat, weights=later[:, :, k].ravel(), minlength=len(real) + 1)
            d_gates = d_gates[:-1]
            grads[f"U{way}"], grads[f"W{way}"], grads[f"b{way}"] = d_u, x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ p[f"W{way}"].T
        chars = p["chars"].shape[1]
        grads["chars"] = table.gradients(d_x[:, :chars], self.buckets)
        words_grad = np.zeros_like(p["words"])
        for k in range(words_grad.shape[1]):
            words_grad[:, k] = np.bincount(table.own, weights=d_x[:, chars + k], minlength=self.buckets)
        grads["words"] = words_grad
        return grads


def learnable(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, label) of the keys that may be learned from: those with crc32(key) mod 3 other than 1; of several labels the largest."""
    return labels.filter(F.col(label).isin(0, 1) & (remainder(key, 3) != 1)).groupBy(key).agg(F.max(label).alias(label))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = 800, negatives: int = 1280, max_chars: int = 6000, **network) -> GatedNetwork:
    """Fits on about that many keys of each label (one row a key in ``labels``), chosen by a hash of the key.

    Longer texts than max_chars and null texts are left out of the fit (not of the
    scoring); of texts that share a key the smallest counts. The driver receives the
    chosen texts alone; to choose them only keys are shuffled, and the chosen keys, bounded by
    the two numbers, are broadcast. Texts are learned in order of the key, so equal tables give equal networks.
    """
    usable = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= max_chars))
    known = materialise(usable.select(key).distinct().join(labels.select(key, label), key), "labelled-keys")
    held = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    model = GatedNetwork(**network)
    if len(held) == 2:
        share = F.when(F.col(label) == 1, min(1.0, positives / held[1])).otherwise(min(1.0, negatives / held[0]))
        chosen = F.broadcast(known.filter(unit_hash(key) < share))
        rows = sorted(usable.select(key, text).join(chosen, key).groupBy(key, label).agg(F.min(text).alias(text)).select(key, text, label).collect())
        model.train([r[1] for r in rows], np.array([r[2] for r in rows]))
    discard_frames(known)
    return model


def score(docs: DataFrame, model: GatedNetwork, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1 added as column ``name``; ValueError if the input has one of that name."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column named {name}; give another name")
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in batches:
                texts = arrow_texts(batch.column(at))
                for low, high in ranges(texts, SLICE_BYTES):
                    found = model.score(texts.slice(low, high - low))
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return map_arrow(docs, run, schema)
