"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes maximum-likelihood estimates of orders 2 and 1 with a uniform
one, with weights by how often the context was seen:

    p(w | h) = a(b) * c(h w) / c(h) + b(b) * c(w) / N + u(b) / (V + 1)

where b is the bucket of c(h) (its binary logarithm). The weights are learned
by expectation-maximisation on held-out counts made by deletion: every training
occurrence is predicted by the counts without itself, and the occurrences are
gathered into a table of bounded size over (bucket, the two estimates), so the
iteration neither depends on the corpus size nor reads it again.

Counts cover all training documents and grow with the corpus, so they are never
held in one place. Texts are read in blocks of about ``block`` tokens. A block
sends each slot of the hash range its distinct n-grams, packed and sorted; a
slot adds up what all blocks sent and answers each block with the totals in the
block's own order. Only distinct n-grams of a block travel, 8 bytes each, and
answers are a few bytes. The blocks are read again to score their documents
with the answers, which name the order-dependent checksum of the request, so a
block that was read differently raises an error instead of scoring wrongly.

Words are runs of non-blank characters with A-Z lower-cased; an end token
follows each document and counts as a token. N-grams are named by 64-bit hashes.

Defined results: a null text is empty and scores its end token; a null
``doc_id`` belongs to the fold of the empty text; without training documents
counts are zero and all probability is uniform; documents are scored one by
one, so repeated rows score alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import fold, pick, stage, utf8

FOLDS, HELD = 5, 1
#: Tokens of one block, and n-grams one slot should hold.
BLOCK, SLOT = 2_000_000, 2_000_000
#: Buckets of context frequency, and steps per doubling of an estimate.
BUCKETS, FINE, LOWEST = 24, 4, 40

START, STOP = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFA0C1E57)


def _pair(h, w):
    """64-bit name of a two-word sequence."""
    x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Block:
    """The tokens of some documents: the sorted distinct words' names, each
    token's place among them, and the documents' lengths."""

    def __init__(self, texts: list[bytes]):
        places: dict[bytes, int] = {}
        parts, lengths = [], []
        for t in texts:
            words = t.lower().split()
            parts.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int32, len(words)))
            lengths.append(len(words) + 1)
        names = np.array([xxhash.xxh64_intdigest(w, 1) for w in places] + [int(STOP)], np.uint64)
        stop = np.array([len(places)], np.int32)
        self.lengths = np.array(lengths, np.int64)
        self.words, place = np.unique(names, return_inverse=True)
        self.at = place[np.concatenate([x for p in parts for x in (p, stop)])].astype(np.int32)

    def checksum(self) -> int:
        return xxhash.xxh64_intdigest(self.words.tobytes() + self.at.tobytes() + self.lengths.tobytes()) >> 1


def pairs(words: np.ndarray, at: np.ndarray, lengths: np.ndarray):
    """(distinct pair names, each token's place among them, place of each
    token's context among the words, -1 at a document's start)."""
    context = np.empty_like(at)
    context[1:] = at[:-1]
    context[np.cumsum(lengths) - lengths] = -1
    before = np.where(context < 0, START, words[np.maximum(context, 0)])
    names, place = np.unique(_pair(before, words[at]), return_inverse=True)
    return names, place, context


def _cuts(names: np.ndarray, slots: int):
    """The ranges of sorted names that fall into each slot of the hash range."""
    which = ((names >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    ends = np.searchsorted(which, np.arange(slots + 1, dtype=np.uint64))
    return [(s, ends[s], ends[s + 1]) for s in range(slots) if ends[s + 1] > ends[s]]


def _packed_names(names: np.ndarray) -> bytes:
    """Sorted names as byte planes of their differences, compressed."""
    import zstandard

    steps = np.diff(names, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _names(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _packed_counts(counts: np.ndarray) -> bytes:
    import zstandard

    planes = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _counts(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.int64)


def _blocks(batches, block: int):
    """(block id, ids as text, held_out, Block) over a task's documents."""
    from pyspark import TaskContext

    base, ids, held, texts, size = TaskContext.get().partitionId() << 20, [], [], [], 0
    for b in batches:
        for i, h, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            ids.append(i)
            held.append(h)
            texts.append(t)
            size += len(t) // 6 + 1
            if size >= block:
                yield base, ids, held, Block(texts)
                base, ids, held, texts, size = base + 1, [], [], [], 0
    if ids:
        yield base, ids, held, Block(texts)


def em(table: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Mixture weights by bucket from rows (bucket, p2, p1, p0, count)."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    if not len(table):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    bucket, p, n = table[:, 0].astype(int), table[:, 1:4], table[:, 4]
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(1))[:, None]
        total = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], 1) + [0.05, 0.05, 0.05]
        weights = total / total.sum(1, keepdims=True)
    return weights


def _bucket(c):
    return np.minimum(BUCKETS - 1, np.log2(np.maximum(c, 0) + 1).astype(int))


def score(docs: DataFrame, block: int = BLOCK, slot: int = SLOT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    import pandas as pd
    import pyarrow as pa

    rows = pick(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), utf8(F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    slots = max(8, rows.rdd.getNumPartitions() * block // slot)

    def ask(batches):
        for base, _, held, b in _blocks(batches, block):
            train = np.repeat(~np.array(held, bool), b.lengths)
            names, place, _ = pairs(b.words, b.at, b.lengths)
            got = []
            for order, names, place in ((1, b.words, b.at), (2, names, place)):
                counts = np.bincount(place, train, len(names)).astype(np.int64)
                got += [(order, s, _packed_names(names[lo:hi]), _packed_counts(counts[lo:hi])) for s, lo, hi in _cuts(names, slots)]
            order, s, packed, counts = zip(*got)
            k = len(got)
            yield pa.RecordBatch.from_arrays([pa.array([base] * k, pa.int64()), pa.array([b.checksum()] * k, pa.int64()), pa.array(order, pa.int32()),
                                              pa.array(s, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())],
                                             ["block", "mark", "ngram", "slot", "names", "counts"])

    def answer(pdf):
        sent = [_names(x) for x in pdf["names"]]
        names, at = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(at, np.concatenate([_counts(x) for x in pdf["counts"]]), len(names)).astype(np.int64)
        known = int((total > 0).sum()) if pdf["ngram"].iloc[0] == 1 else 0
        ends = np.cumsum([len(x) for x in sent])
        back = [_packed_counts(total[at[e - len(x):e]]) for x, e in zip(sent, ends)]
        some = int(total.sum()) if pdf["ngram"].iloc[0] == 1 else 0
        return pd.DataFrame({"block": pdf["block"], "mark": pdf["mark"], "ngram": pdf["ngram"], "slot": pdf["slot"], "totals": back,
                             "distinct": [known] + [0] * (len(pdf) - 1), "tokens": [some] + [0] * (len(pdf) - 1)})

    asked = rows.mapInArrow(ask, "block long, mark long, ngram int, slot long, names binary, counts binary")
    answers = stage(asked.groupBy("ngram", "slot").applyInPandas(
        answer, "block long, mark long, ngram int, slot long, totals binary, distinct long, tokens long"))
    size = answers.agg(F.sum("distinct"), F.sum("tokens")).first()
    v, n = int(size[0] or 0), int(size[1] or 0)
    uniform = 1.0 / (v + 1)

    def tokens(batches):
        """A block's documents and tokens, to meet the totals."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(3).compress
        for base, ids, held, b in _blocks(batches, block):
            planes = b.at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([base], pa.int64()), pa.array([b.checksum()], pa.int64()), pa.array([ids], pa.list_(pa.string())),
                 pa.array([held], pa.list_(pa.bool_())), pa.array([b.lengths.tolist()], pa.list_(pa.int64())),
                 pa.array([_packed_names(b.words)], pa.binary()), pa.array([squeeze(planes)], pa.binary())],
                ["block", "mark", "ids", "held", "lengths", "words", "at"])

    again = stage(rows.mapInArrow(tokens, "block long, mark long, ids array<string>, held array<boolean>, lengths array<long>, words binary, at binary"))
    # a document's start is a context seen once per training document
    started = again.select(F.sum(F.aggregate("held", F.lit(0), lambda a, h: a + F.when(h, 0).otherwise(1)))).first()[0] or 0

    def joined(left, right):
        """A block's documents, and by token the counts of the word, of the
        pair and of the context."""
        import zstandard

        if len(left) != 1 or not len(right) or (right["mark"] != left["mark"].iloc[0]).any():
            raise RuntimeError("a block was read differently the second time")
        row = left.iloc[0]
        one, two = (np.concatenate([_counts(x) for x in right[right["ngram"] == o].sort_values("slot")["totals"]]) for o in (1, 2))
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["at"]), np.uint8).reshape(4, -1)
        at = np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int32)
        lengths = np.asarray(row["lengths"], np.int64)
        _, place, context = pairs(_names(row["words"]), at, lengths)
        return row["ids"], np.asarray(row["held"], bool), lengths, one[at], two[place], np.where(context >= 0, one[np.maximum(context, 0)], started)

    def estimates(left, right):
        """Held-out counts by deletion: each training token against the counts
        without itself, gathered by bucket and rounded estimates."""
        ids, held, lengths, c1, c2, ch = joined(left, right)
        use = np.repeat(~held, lengths)
        c1, c2, ch = c1[use] - 1, c2[use] - 1, ch[use] - 1
        fine = lambda p: np.where(p > 0, np.clip(np.rint(-FINE * np.log2(np.maximum(p, 1e-300))), 0, FINE * LOWEST), -1).astype(np.int64)
        p2, p1 = fine(np.where(ch > 0, c2 / np.maximum(ch, 1), 0)), fine(c1 / max(n - 1, 1))
        cell, count = np.unique((_bucket(ch) * 1000 + p2 + 1) * 1000 + p1 + 1, return_counts=True)
        return pd.DataFrame({"cell": cell, "n": count})

    def scores(left, right):
        ids, held, lengths, c1, c2, ch = joined(left, right)
        w = weights[_bucket(ch)]
        p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] * uniform
        # a context never seen leaves its share to the lower orders
        p = np.where(ch > 0, p, (w[:, 1] * c1 / max(n, 1) + w[:, 2] * uniform) / (w[:, 1] + w[:, 2])) if n else np.full(len(p), uniform)
        base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
        at = np.cumsum(lengths) - lengths
        return pd.DataFrame({"doc_id": list(ids), "held_out": held, "n_tokens": lengths,
                             "n_known": np.add.reduceat((c1 > 0).astype(np.int64), at),
                             "train_tokens": n, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at)})

    read = again.groupBy("block").cogroup(answers.drop("distinct", "tokens").groupBy("block"))
    cells = read.applyInPandas(estimates, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    lists = [(c // 1_000_000, c // 1000 % 1000 - 1, c % 1000 - 1, k) for c, k in cells]
    value = lambda x: 0.0 if x < 0 else 2.0 ** (-x / FINE)
    weights = em(np.array([(b, value(x), value(y), uniform, k) for b, x, y, k in lists], float).reshape(-1, 5))
    out = read.applyInPandas(scores, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
