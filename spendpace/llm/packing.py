"""Lexical retrieval packing: documents are packed into token sequences beside
the documents that share their words.

Tokens come from a public byte-level BPE vocabulary, with an end id after each
document. Whole windows of a long document are sequences of their own; its
remainder is packed with others. Document frequencies and the mean length are
counted once over all remainders; one number for each id of the vocabulary
reaches the driver.

The index is sharded by topic. Each remainder has a direction, the mean of its
ids' fixed random vectors (rarer ids weigh more), and goes to the shard of the
nearest of ``topics`` centres, fitted on a sample of at most ``sample``
directions. A shard of many documents is split by a min-hash of their ids, and a
min-hash value of more than ``block`` documents at random. Close shards lie side
by side in the ranges that tasks read. Within a range, every
``block`` documents form an inverted index with BM25 weights (tokens are the
terms; a query is a seed's ``query_terms`` best weighted ones). Documents are
taken as seeds in order; the best ranked unused neighbours that fit are
appended, and the next one is cut to fill the window to the last token, its rest
staying available. Without neighbours left that share a term, the following
documents are used. What is left in a task at the end is cut at powers of two,
which need no padding.

All rows are packed and every token lies in exactly one piece. ``block`` bounds
the memory of an index and with it the retrieval: a seed finds neighbours only
in its own block. A partition is a chain of blocks, and an unfinished window
goes on in the next one.

Defined results: a null text is empty and packs as its end id alone; rows that
repeat an id or a text are packed each; a null ``doc_id`` stays null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import first_by_hash, pick, stage

WINDOW, END = 2048, 1
#: Documents of one inverted index, and terms of one query.
BLOCK, QUERY_TERMS = 2048, 24
#: Ids of the vocabulary, and of a direction's numbers.
VOCABULARY, DIMENSIONS = 50_257, 64
#: Shards of the index, and directions that their centres are fitted on.
TOPICS, SAMPLE = 256, 4096


#: The special token that the vocabulary adds to its ranks, and its id. Fixed
#: values.
MARKER, _MARKER_ID = "<|endoftext|>", (50256).to_bytes(4, "little")


class Encoder:
    """Ids of a text as little-endian uint32 bytes."""

    def __init__(self, vocabulary: str, pattern: str):
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if MARKER in text:  # the vocabulary's one special token, wherever it stands
            return _MARKER_ID.join(map(self._ids, text.split(MARKER)))
        return self._ids(text)


def _encoder(cached={}):  # one per Python worker
    if "e" not in cached:
        import public_tokenizers as tokenizers

        cached["e"] = Encoder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return cached["e"]


def _vectors(cached={}):  # one per Python worker
    """A random vector for each id. Ids are in order of frequency, so the
    logarithm of an id stands for its rarity."""
    if "v" not in cached:
        v = np.random.default_rng(1).standard_normal((VOCABULARY, DIMENSIONS), np.float32)
        cached["v"] = v * np.log1p(np.arange(VOCABULARY, dtype=np.float32))[:, None]
    return cached["v"]


def tokenized(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, the checksums of whole windows, the remainder's
    compressed ids, its min-hash and its direction; and for each task one
    further row (n_tokens null) with ``df``, the number of its remainders that
    hold each id."""
    import pyarrow as pa

    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "whole", "rest", "minhash", "direction", "df"]

    def run(batches):
        import zstandard

        squeeze, encode, end, vectors = zstandard.ZstdCompressor(1), _encoder(), np.array([END], "<u4").tobytes(), _vectors()
        df, at, id_type = np.zeros(VOCABULARY, "<i8"), np.zeros(VOCABULARY, np.int64), None

        def batch(ids, *cols):
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, kinds)], names)

        for b in batches:
            id_type = b.column("doc_id").type
            n, whole, rest, key, direction = [], [], [], [], []
            for text in b.column("text").to_pylist():
                ids = encode(text) + end
                k = len(ids) // 4
                full = k // window
                n.append(k)
                whole.append([zlib.crc32(ids[i * window * 4:(i + 1) * window * 4]) for i in range(full)])
                left = np.frombuffer(ids, "<u4")[full * window:]
                if not len(left):
                    rest.append(None), key.append(0), direction.append(None)
                    continue
                rest.append(squeeze.compress(left.tobytes()))
                # each id once: the place that was written last
                place = np.arange(len(left))
                at[left] = place
                left = left[at[left] == place]
                df[left] += 1
                direction.append((vectors[left].sum(0) / np.float32(len(left))).tobytes())
                mixed = (left.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                key.append(int((mixed ^ mixed >> np.uint64(32)).min() >> np.uint64(1)))
            yield batch(b.column("doc_id"), n, whole, rest, key, direction, [None] * len(n))
        if id_type is not None:
            yield batch(pa.nulls(1, id_type), [None], [None], [None], [None], [None], [squeeze.compress(df.tobytes())])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, whole array<long>, rest binary, minhash long, direction binary, df binary")


def statistics(tokens: DataFrame, window: int = WINDOW) -> tuple[np.ndarray, float]:
    """BM25's idf of each id and the mean length, over all remainders."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for x in b.column("df").to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    counts = tokens.where("df is not null").select("df").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(VOCABULARY)
    for term, n in counts:  # one row for each id of the vocabulary at most
        df[term] = n
    left = F.col("n_tokens") % window
    docs, mean = tokens.where(left > 0).agg(F.count(F.lit(1)), F.avg(left)).first()
    return np.log1p((docs - df + 0.5) / (df + 0.5)), mean or 1.0


def centres(directions: np.ndarray, topics: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The mean direction, and centres of the centred directions by spherical
    k-means, in an order that puts close centres side by side."""
    mean = directions.mean(0)
    x = directions - mean
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    c = x[np.random.default_rng(2).choice(len(x), min(topics, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-9

    def ordered(some):  # halves along the direction in which they differ most
        if len(some) < 3:
            return list(some)
        axis = np.linalg.svd(c[some] - c[some].mean(0), full_matrices=False)[2][0]
        some = some[np.argsort(c[some] @ axis, kind="stable")]
        return ordered(some[:len(some) // 2]) + ordered(some[len(some) // 2:])

    return mean, c[ordered(np.arange(len(c)))]


def dealt(tokens: DataFrame, block: int, topics: int = TOPICS, sample: int = SAMPLE) -> DataFrame:
    """The documents of ``tokenized`` (stored) by shard, in order of length."""
    import pyarrow as pa

    docs = tokens.where("n_tokens is not null").select("doc_id", "n_tokens", "whole", "rest", "minhash", "direction")
    known = first_by_hash(docs.where("direction is not null").select("direction"), sample, "direction").collect()
    mean, c = centres(np.frombuffer(b"".join(r[0] for r in known), np.float32).reshape(-1, DIMENSIONS), topics) if known else (None, None)

    def run(batches):
        for b in batches:
            topic = np.zeros(b.num_rows, np.int64)
            raw = b.column("direction")
            there = np.flatnonzero(~np.asarray(raw.is_null()))
            if len(there):
                x = np.frombuffer(b"".join(raw.drop_null().to_pylist()), np.float32).reshape(-1, DIMENSIONS) - mean
                topic[there] = (x @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(topic)], [*b.schema.names[:5], "topic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, whole array<long>, rest binary, minhash long, topic long"))
    # stored, so that Spark knows its size before it plans the joins
    values = stage(rows.groupBy("topic", "minhash").agg(F.count(F.lit(1)).alias("n")))
    crowd = values.where(F.col("n") > block).select("topic", "minhash", F.ceil(F.col("n") / block).alias("salts"))
    shards = values.where(F.col("n") <= block).groupBy("topic").agg(F.ceil(F.sum("n") / block).alias("parts"))
    crowded = F.col("salts").isNotNull()
    rows = rows.join(crowd, ["topic", "minhash"], "left").join(shards, "topic", "left").select(
        "doc_id", "n_tokens", "whole", "rest", "topic",
        F.when(crowded, F.col("minhash")).otherwise(-1).alias("value"),
        F.when(crowded, F.pmod(F.xxhash64("doc_id", "rest"), F.col("salts")))
        .otherwise(F.pmod(F.xxhash64("minhash"), F.col("parts"))).alias("part"))
    # ranges keep close shards in one chain of blocks
    return rows.repartitionByRange("topic", "value", "part").sortWithinPartitions("topic", "value", "part", "n_tokens", "doc_id")


def _index(ids: list[np.ndarray], query_terms: int, idf: np.ndarray, mean: float):
    """Postings with BM25 weights over the documents of a block, and each
    document's query: (documents, weights, starts) by term, and term lists."""
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    pair, tf = np.unique(doc.astype(np.int64) << 32 | np.concatenate(ids).astype(np.int64), return_counts=True)
    doc, term = pair >> 32, pair & 0xFFFFFFFF
    length = np.bincount(doc, tf, len(ids))
    weight = idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / mean))
    here = np.bincount(term, minlength=VOCABULARY)
    names = np.flatnonzero(here)
    shared = here[term] > 1
    term = (np.cumsum(here > 0) - 1)[term]
    # the best terms of a document that another one shares
    rank = np.argsort((doc << 32) + (1 << 31) - np.rint(np.where(shared, weight, 0) * (1 << 20)).astype(np.int64))
    first = np.searchsorted(doc, np.arange(len(ids)))
    nth = np.empty(len(doc), np.int64)
    nth[rank] = np.arange(len(doc)) - first[doc[rank]]
    best = (nth < query_terms) & shared
    queries = np.split(term[best], np.searchsorted(doc[best], np.arange(1, len(ids))))
    order = np.argsort((term.astype(np.int64) << 32) + doc)
    return doc[order], weight[order], np.searchsorted(term[order], np.arange(len(names) + 1)), queries


class Packer:
    """Greedy filling of windows within one task; pieces are (document, its
    ids, start, sequence, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.open, self.fill = window, first, [], 0

    def add(self, doc, ids, start) -> list:
        """Append ids (which fit) to the open window; a full one is returned."""
        self.open.append((doc, ids, start, self.sequence, self.fill))
        self.fill += len(ids)
        return self.close() if self.fill == self.window else []

    def close(self) -> list:
        out, self.open, self.fill = self.open, [], 0
        self.sequence += 1
        return out

    def block(self, ids: list[np.ndarray], starts: list[int], query_terms: int, idf: np.ndarray, mean: float):
        """Pack the documents of one index; yields full windows. Documents are
        named by position."""
        docs, weights, at, queries = _index(ids, query_terms, idf, mean)
        left = [[x, s] for x, s in zip(ids, starts)]
        sizes, seed = np.array([len(x) for x in ids]), 0  # ids still to pack

        def take(i):
            x, s = left[i]
            room = self.window - self.fill
            part, left[i] = x[:room], [x[room:], s + min(room, len(x))]
            sizes[i] = len(left[i][0])
            return self.add(i, part, s)

        while True:
            while seed < len(ids) and not sizes[seed]:
                seed += 1
            if seed == len(ids):
                return
            query = queries[seed]
            here = self.sequence
            yield take(seed)
            if self.sequence != here or not len(query):
                continue
            score = np.bincount(np.concatenate([docs[at[t]:at[t + 1]] for t in query]),
                                np.concatenate([weights[at[t]:at[t + 1]] for t in query]), len(ids))
            score[sizes == 0] = 0
            near = np.flatnonzero(score)
            ranked = fitting = near[np.argsort(-score[near], kind="stable")]
            while self.sequence == here:  # those that fit whole, best first
                fitting = fitting[sizes[fitting] <= self.window - self.fill]
                if not len(fitting):
                    break
                yield take(fitting[0])
                fitting = fitting[1:]
            if self.sequence == here:
                for i in ranked[sizes[ranked] > 0][:1]:  # the best of the others is cut
                    yield take(i)

    def rest(self) -> list:
        """The open window, cut at powers of two."""
        out, todo, self.open = [], self.open, []
        total, self.fill = self.fill, 0
        for bit in reversed(range(total.bit_length())):
            need = 1 << bit if total >> bit & 1 else 0
            offset = 0
            while offset < need:
                doc, ids, start, _, _ = todo[0]
                part = ids[:need - offset]
                out.append((doc, part, start, self.sequence, offset))
                offset += len(part)
                todo[0] = (doc, ids[len(part):], start + len(part), 0, 0)
                if not len(todo[0][1]):
                    todo.pop(0)
            self.sequence += need > 0
        return out


def pack(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, query_terms: int = QUERY_TERMS) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, the
    piece's ``ids_crc32`` and its ``ids`` (null for whole windows, whose ids
    are the document's own from ``start``)."""
    import pyarrow as pa
    from pyspark import TaskContext

    tokens = stage(tokenized(docs, window))
    idf, mean = statistics(tokens, window)
    rows = dealt(tokens, block)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names[1:-1])}, ids binary"

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        held, out, kinds = [], [], []

        def flush(final=False):
            nonlocal held, out
            done = []
            if held:
                ids = [np.frombuffer(expand.decompress(h[2]), "<u4") for h in held]
                for pieces in packer.block(ids, [h[1] // window * window for h in held], query_terms, idf, mean):
                    done += pieces
                packer.open = [(held[d] if isinstance(d, (int, np.integer)) else d, *x) for d, *x in packer.open]
                done = [(held[d] if isinstance(d, (int, np.integer)) else d, *x) for d, *x in done]
                held = []
            if final:
                done += packer.rest()
            for d, ids, start, sequence, offset in done:
                raw = ids.tobytes()
                out.append((d[0], start, len(ids), zlib.crc32(raw), d[1], sequence, offset, raw))

        def batch():
            nonlocal out
            cols = list(zip(*out)) if out else [[]] * len(names)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            kinds = [b.column("doc_id").type, *[pa.int64()] * 6, pa.binary()]
            for doc_id, n, whole, rest in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "whole", "rest"))):
                for i, crc in enumerate(whole):
                    out.append((doc_id, i * window, window, crc, n, packer.sequence, 0, None))
                    packer.sequence += 1
                    packer.open = [(d, x, s, packer.sequence, o) for d, x, s, _, o in packer.open]
                if rest is not None:
                    held.append((doc_id, n, rest))
                if len(held) >= block:
                    flush()
                    yield batch()
        if kinds:
            flush(final=True)
            yield batch()

    return rows.mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
