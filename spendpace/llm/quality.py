"""Quality classifier learned from trusted positives and unlabelled text.

Non-negative positive-unlabelled learning: with the class prior p, positives P
and unlabelled text U, the risk of a scorer g under the logistic loss l is

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

The second part estimates the risk on the unseen negatives; where a batch
drives it below zero, the step goes against that part instead, so the model
cannot win by overfitting the positives. Labels 0 are not used at all: the
trusted positives are rows labelled 1 outside the held fold, and the unlabelled
text is a sample of all documents.

The prior is estimated from the same two samples: a first scorer tells P from
U, and since U holds the positives with share p, U's tail above any score is at
least p times P's tail. The smallest ratio of the tails (over tails holding
enough of P to be measured) is taken as p.

A document is described by the shape of its text only: shares of character
classes, of word shapes (letters a, capitals A, digits 9, other bytes u, runs
shortened, punctuation kept) hashed to ``SHAPES`` columns, of repeated words
and lines, and mean lengths. Fitting uses at most ``sample`` positives and as
many unlabelled rows (only feature vectors reach the driver); scoring reads all
whole texts.

Defined results: a null text is empty, an empty text scores from all-zero
shares; without positives or without unlabelled rows every score is 0.5.
Rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import first_by_hash, labelled_sample, pick, scored, utf8

FOLDS, HELD, SHAPES = 4, 2, 256

_CLASS = bytearray(b"u" * 256)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = ord("a" if _s.islower() else "A" if _s.isupper() else "9" if _s.isdigit() else _s if _c > 32 else "\n" if _c == 10 else " ")
_CLASS = bytes(_CLASS)
_RUN = re.compile(rb"([aAu9!-/:-@\[-`{-~])\1+")
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.lru_cache(100_000)
def _column(shape: bytes) -> int:
    return zlib.crc32(_RUN.sub(rb"\1", shape)) % SHAPES


def features(text: bytes) -> np.ndarray:
    """Shares and means of one text, all within about 0 to 1."""
    x = np.zeros(SHAPES + 48)
    if not text.strip():
        return x
    shape = text.translate(_CLASS)
    n = len(shape)
    d = x[SHAPES:]
    for i, c in enumerate(_SIGNS):
        d[i] = shape.count(c) / n
    d[32], d[33], d[34], d[35] = (shape.count(c) / n for c in (b"A", b"9", b"u", b"\n"))
    words = text.split()
    k = len(words)
    d[36] = len(set(words)) / k
    d[37] = min(1.0, n / k / 20)
    lines = [ln for ln in text.split(b"\n") if ln.strip()]
    d[38] = 1 - len(set(lines)) / len(lines)
    d[39] = 1 / (1 + k)
    d[40] = min(1.0, k / len(lines) / 100)
    d[41] = min(1.0, np.log1p(k) / 12)
    top = Counter(words).most_common(1)[0][1]
    d[42] = top / k
    d[43] = 1.0
    for s, c in Counter(shape.split()).items():
        x[_column(s)] += c / k
    x[:SHAPES] = np.sqrt(x[:SHAPES])
    d[:36] = np.sqrt(d[:36])
    return x


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts]) if texts else np.zeros((0, SHAPES + 48))


def _sigmoid(g):
    return 1 / (1 + np.exp(-np.clip(g, -35, 35)))


def _descend(grad, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def class_prior(xp: np.ndarray, xu: np.ndarray, least: float = 0.3, steps: int = 300) -> float:
    """Share of positives in U: the least ratio of U's to P's upper tails."""
    half_p, half_u = len(xp) // 2, len(xu) // 2  # fit on one half, measure on the other
    a, b = xp[:half_p], xu[:half_u]
    w = _descend(lambda w: -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + 1e-4 * w, xp.shape[1], steps, 0.05)
    sp, su = np.sort(xp[half_p:] @ w), np.sort(xu[half_u:] @ w)
    cuts = np.quantile(sp, np.linspace(0, 1 - least, 60))
    tail_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    return float(np.clip((tail_u / tail_p).min(), 0.02, 0.98))


def train(xp: np.ndarray, xu: np.ndarray, prior: float | None = None, steps: int = 1500, rate: float = 0.03,
          decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights, prior) minimising the non-negative risk over mini-batches."""
    if len(xp) < 4 or len(xu) < 4:
        return np.zeros(SHAPES + 48), 0.5
    rng = np.random.default_rng(seed)
    xp, xu = rng.permutation(xp), rng.permutation(xu)  # the prior's halves must be alike
    p = class_prior(xp, xu) if prior is None else prior

    def grad(w):
        a, b = xp[rng.integers(0, len(xp), min(len(xp), 1024))], xu[rng.integers(0, len(xu), min(len(xu), 1024))]
        ga, gb = a @ w, b @ w
        positive = -p * a.T @ (1 - _sigmoid(ga)) / len(a)
        negative = b.T @ _sigmoid(gb) / len(b) - p * a.T @ _sigmoid(ga) / len(a)
        risk = np.logaddexp(0, gb).mean() - p * np.logaddexp(0, ga).mean()
        return (positive + negative if risk >= 0 else -negative) + decay * w

    return _descend(grad, xp.shape[1], steps, rate), p


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> np.ndarray:
    """Weights from at most ``sample`` positives and ``sample`` unlabelled rows."""
    import pyarrow as pa

    def described(batches):
        for b in batches:
            x = matrix(b.column("text").to_pylist()).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("y")], ["x", "y"])

    def rows(df):
        got = df.mapInArrow(described, "x binary, y int").collect()
        return np.array([np.frombuffer(r["x"], "<f4") for r in got], float).reshape(-1, SHAPES + 48)

    positive = labelled_sample(docs, pick(labels, "doc_id", "quality").where("quality = 1"), "quality", FOLDS, HELD, sample)
    ids = first_by_hash(pick(docs, "doc_id").where("doc_id is not null"), sample, "doc_id").distinct()
    text = pick(docs, "doc_id", "text").select("doc_id", utf8(F.col("text")).alias("text"))
    unlabelled = text.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(sample)
    return train(rows(positive), rows(unlabelled.select("text", F.lit(0).alias("y"))))[0]


def quality(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    w = fit(docs, labels, sample)

    def score(texts):
        return _sigmoid(matrix(texts) @ w)

    return scored(docs, score, FOLDS, HELD)
