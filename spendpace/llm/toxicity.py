"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words (bytes between ASCII punctuation and
white space, A-Z lower-cased) and their stems, hashed to ``2**bits`` columns.
The machine scores

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

over the set, so a pair of terms (an insult and the mention of a group) has a
weight of its own beside what each term adds. It is fitted by AdaGrad on the
logistic loss over at most ``sample`` labelled documents, whose hashed terms
(not texts) come to the driver; the fitted table (``2**bits`` rows at most) is
shipped to the tasks that score all whole texts.

Terms seen in few of the fitted documents, and terms about as frequent in
either class, get no column: a text of any length then has few active terms,
and its length alone does not move the score.

Defined results: a null text is empty; an empty text scores the machine's bias;
with no labelled document, or with one class only, every score is the share of
label 1 among the fitted ones (0 without any). Rows are scored one by one, so
repeated ids and ties need no rule; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import labelled_sample, scored, unwrap, utf8, wrap

FOLDS, HELD = 3, 1

#: Length in bytes of the stem that stands for a word's inflected forms.
STEM = 5

_CLEAN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_CLEAN).split())


def hashes(word: bytes, bits: int) -> tuple[int, ...]:
    """Hashed terms of a word: the word and, if it is longer, its stem."""
    mask = (1 << bits) - 1
    whole = zlib.crc32(word) & mask
    return (whole, zlib.crc32(b"^" + word[:STEM]) & mask) if len(word) >= STEM else (whole,)


@dataclass
class Machine:
    bits: int
    bias: float
    index: dict[int, int]  # hashed term -> row of w and v
    w: np.ndarray
    v: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, at, found = [], [], {}
        index = self.index
        for r, text in enumerate(texts):
            active = set()
            for t in words(text):
                k = found.get(t)
                if k is None:
                    k = found[t] = tuple(index[h] for h in hashes(t, self.bits) if h in index)
                if k:
                    active.update(k)
            rows += [r] * len(active)
            at += sorted(active)
            if len(found) > 500_000:
                found.clear()
        return _sigmoid(_raw(self.bias, self.w, self.v, np.array(rows, np.int64), np.array(at, np.int64), len(texts))[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _raw(bias, w, v, rows, at, n):
    """Raw scores of n documents given (row, column) of their terms, and the
    per-document sums of factors."""
    s = np.stack([np.bincount(rows, v[at, f], n) for f in range(v.shape[1])], 1)
    q = np.bincount(rows, (v[at] ** 2).sum(1), n)
    return bias + np.bincount(rows, w[at], n) + 0.5 * ((s ** 2).sum(1) - q), s


def _columns(hashed: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of the documents' terms among the sorted ``names``."""
    parts = []
    for h in hashed:
        k = np.searchsorted(names, h)
        parts.append(k[names[np.minimum(k, len(names) - 1)] == h])
    return np.repeat(np.arange(len(hashed)), [len(x) for x in parts]), np.concatenate(parts)


def _descend(doc, col, y, v, epochs, rate, decay, blank, rng, base=None):
    """AdaGrad on the logistic loss: bias, w and v of the columns, on top of the
    raw scores ``base`` if given."""
    n, pos = len(y), float(y.sum())
    factors = v.shape[1]
    w, bias = np.zeros(len(v)), np.log(pos / (n - pos)) if base is None else 0.0
    base = np.zeros(n) if base is None else base
    gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    start = np.searchsorted(doc, np.arange(n + 1))
    weight = np.where(y > 0, 0.5 * n / pos, 0.5 * n / (n - pos)) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            some = order[i:i + 256]
            pieces = [np.arange(start[d], start[d + 1]) for d in some]
            nz = np.concatenate(pieces)
            rows, at = np.repeat(np.arange(len(some)), [len(p) for p in pieces]), col[nz]
            here = rng.random(len(nz)) >= blank
            rows, at = rows[here], at[here]
            raw, s = _raw(bias, w, v, rows, at, len(some))
            g = (_sigmoid(base[some] + raw) - y[some]) * weight[some] / len(some)
            cols, inv = np.unique(at, return_inverse=True)
            dw = np.bincount(inv, g[rows], len(cols)) + decay * w[cols]
            dv = np.stack([np.bincount(inv, g[rows] * (s[rows, f] - v[at, f]), len(cols)) for f in range(factors)], 1) + decay * v[cols]
            gw[cols] += dw ** 2
            gv[cols] += dv ** 2
            gb += g.sum() ** 2
            w[cols] -= rate * dw / np.sqrt(gw[cols])
            v[cols] -= rate * dv / np.sqrt(gv[cols])
            bias -= rate * g.sum() / np.sqrt(gb)
    return float(bias), w, v


#: How strongly the pairs' weights are held back in each step.
PAIR_DECAY = 1e-3


def telling_pairs(hashed: list[np.ndarray], y: np.ndarray, p: np.ndarray, names: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms among ``names`` that are in a pair whose documents the scores
    ``p`` miss by more than chance would, and the pairs' z-scores among them. A
    pair counts if at least ``least`` documents hold both terms and its z is
    beyond what the largest of that many random ones reaches."""
    miss, var, both = np.zeros((3, len(names), len(names)), np.float32)
    for i in range(0, len(y), 2048):
        q = p[i:i + 2048].astype(np.float32)
        b = np.zeros((len(q), len(names)), np.float32)
        b[_columns(hashed[i:i + 2048], names)] = 1
        miss += b.T @ (b * (y[i:i + 2048].astype(np.float32) - q)[:, None])
        var += b.T @ (b * np.maximum(q * (1 - q), 1e-3)[:, None])
        both += b.T @ b
    often = np.diag(both)
    # terms that always come together (a word and its stem) are one term
    apart = both < 0.95 * np.minimum(often[:, None], often[None, :])
    z = np.where((both >= least) & apart, miss / np.sqrt(np.maximum(var, 1e-6)), 0)
    pairs = np.count_nonzero(np.triu(z, 1))
    hit = np.abs(z) > np.sqrt(2 * np.log(max(pairs, 2)))
    some = np.flatnonzero(hit.any(0))
    return names[some], np.where(hit, z, 0)[np.ix_(some, some)]


def train(hashed: list[np.ndarray], y: np.ndarray, bits: int = 24, factors: int = 4, min_docs: int | None = None,
          min_z: float | None = None, epochs: int = 20, rate: float = 0.5, decay: float = 1e-6, blank: float = 0.5, seed: int = 3,
          pair_terms: int = 2048) -> Machine:
    """Fit on documents given as arrays of distinct hashed terms. ``blank`` is
    the share of a document's terms that each step leaves out, so that one
    telling term suffices where most of the fitted documents hold several.

    Columns go to terms that are associated with the label by themselves (a z of
    ``min_z``: 6, less for few documents), and then to terms in a telling pair
    (``telling_pairs``) among the ``pair_terms`` most frequent ones. Where pairs
    were found, further factors are fitted on top of the first ones, on whole
    documents, starting from the pairs' strongest directions."""
    n, pos = len(y), float(y.sum()) if len(y) else 0.0
    if n == 0 or pos == 0 or pos == n:
        share = pos / n if n else 0.0
        bias = -35.0 if share == 0 else 35.0
        return Machine(bits, bias, {}, np.zeros(0), np.zeros((0, factors)))
    # document frequencies, over all and over label 1, in two counting tables
    df, dp = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint32)
    for h, label in zip(hashed, y):
        df[h] += 1
        if label:
            dp[h] += 1
    least = max(2, min(4, n // 16), int(n ** 0.5 / 8)) if min_docs is None else min_docs
    known = np.nonzero(df >= least)[0]
    if not len(known):
        return Machine(bits, float(np.log(pos / (n - pos))), {}, np.zeros(0), np.zeros((0, factors)))
    df, dp = df[known].astype(float), dp[known].astype(float)
    rate_all = df / n
    z = np.abs(dp / pos - (df - dp) / (n - pos)) / np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-12) * (1 / pos + 1 / (n - pos)))
    least_z = min(6.0, 1.5 * n ** 0.2) if min_z is None else min_z
    names, rng = known[z >= least_z], np.random.default_rng(seed)
    bias, w, v = float(np.log(pos / (n - pos))), np.zeros(0), np.zeros((0, factors))
    p = np.full(n, pos / n)
    if len(names):
        doc, col = _columns(hashed, names)
        bias, w, v = _descend(doc, col, y, rng.normal(0, 0.05, (len(names), factors)), epochs, rate, decay, blank, rng)
        p = _sigmoid(_raw(bias, w, v, doc, col, n)[0])
    frequent = known[df <= n / 2]
    frequent = np.sort(frequent[np.argsort(-df[df <= n / 2], kind="stable")[:pair_terms]])
    paired, strength = telling_pairs(hashed, y, p, frequent, least) if len(frequent) > 1 else (known[:0], None)
    if len(paired):
        value, vector = np.linalg.eigh(strength.astype(float))
        top = np.argsort(-value)[:factors]
        v2 = rng.normal(0, 0.05, (len(paired), factors))
        v2[:, :len(top)] += vector[:, top] * np.sqrt(np.maximum(value[top], 0) / max(value[top[0]], 1e-9))
        raw = np.full(n, bias)
        if len(names):
            doc, col = _columns(hashed, names)
            raw = _raw(bias, w, v, doc, col, n)[0]
        doc, col = _columns(hashed, paired)
        more, w2, v2 = _descend(doc, col, y, v2, epochs, rate, PAIR_DECAY, 0.0, rng, raw)
        # one machine: the factors of both fits side by side
        both = np.union1d(names, paired)
        at, at2 = np.searchsorted(both, names), np.searchsorted(both, paired)
        w_all, v_all = np.zeros(len(both)), np.zeros((len(both), 2 * factors))
        w_all[at] += w
        w_all[at2] += w2
        v_all[at, :factors], v_all[at2, factors:] = v, v2
        names, bias, w, v = both, bias + more, w_all, v_all
    elif not len(names):
        # nothing stands out: the strongest terms, strongly held back
        names = np.sort(known[np.argsort(-z, kind="stable")[:32]])
        doc, col = _columns(hashed, names)
        bias, w, v = _descend(doc, col, y, rng.normal(0, 0.05, (len(names), factors)), epochs, rate, 1e-2, blank, rng)
    return Machine(bits, bias, {int(h): i for i, h in enumerate(names)}, w, v)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, bits: int = 24, **how) -> Machine:
    """The machine of at most ``sample`` labelled documents outside the held
    fold; only hashed terms reach the driver."""
    import pyarrow as pa

    def hashed(batches):
        for b in batches:
            sets = [sorted({h for t in words(x) for h in hashes(t, bits)}) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(s, "<u4").tobytes() for s in sets], pa.binary()), b.column("y")], ["h", "y"])

    rows = labelled_sample(docs, labels, "toxic", FOLDS, HELD, sample).mapInArrow(hashed, "h binary, y int").collect()
    return train([np.frombuffer(r["h"], "<u4") for r in rows], np.array([r["y"] for r in rows], float), bits, **how)


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs, fit(docs, labels, **how).score, FOLDS, HELD)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they were."""
    import pyarrow as pa

    score = fit(docs, labels, **how).score
    rows = wrap(docs, "text").select(utf8(F.col("text")).alias("bytes"), "row")

    def run(batches):
        for b in batches:
            keep = pa.array(score(b.column("bytes").to_pylist()) < threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("row")], ["row"]).filter(keep)

    kept = rows.mapInArrow(run, rows.select("row").schema)
    return unwrap(kept, docs)
