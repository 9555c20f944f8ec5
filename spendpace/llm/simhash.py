"""SimHash near-duplicates found exactly with vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles (repeats counted; all-zero without words). Fingerprints link at
``max_bits`` or fewer differing bits.

Linking works on distinct fingerprints, so a group of copies is one row. A
vantage-point tree on the whole 64 bits cannot be cut into few-overlap shards
by itself: distances to any vantage point crowd around 32 with deviation 4, so
at radius 4 two thirds of all points lie in the overlap of a median split. The
first level therefore takes Hamming distance on parts of the bits: of
``max_bits + 1`` disjoint parts of a fingerprint at least one is at distance
zero from any neighbour's. Each fingerprint joins one shard per part (those at
distance zero there), so every linked pair meets in a shard. A shard with more
members than ``SHARD`` is dealt again the same way over its remaining bits,
until shards fit. Inside a shard a vantage-point tree over the full distance
finds all exact pairs: members are split at the median distance to a vantage
point, and the triangle inequality leaves only the shell around the split to be
compared across. The shard then reports links to each linked set's smallest
member, not all pairs of it; a distributed connected-components step joins the
shards' findings.

Defined results: null text is empty; fewer words than a shingle hash the whole
sequence; documents without words share fingerprint zero and link like any
other. Repeated ids appear once per row. A null ``doc_id`` is never a
component's smallest id unless all its ids are null. An empty table gives an
empty result; further columns are ignored by ``near_duplicates`` and kept by
``keep_one``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace.llm.common import components, pick, stage, unwrap, utf8, wrap

#: Distinct fingerprints that one shard's tree may hold.
SHARD = 20_000
#: Members compared directly instead of being split further.
LEAF = 128


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned fingerprint of a text's bytes."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):  # a bounded block of bits at a time, for texts of any length
        ones += np.unpackbits(hashes[i:i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and ``fp``, the fingerprint's bits as a signed long."""
    return _with_fingerprint(pick(docs, "doc_id", "text").select("doc_id", utf8(F.col("text")).alias("text")), shingle)


def _with_fingerprint(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with ``fp`` in place of the bytes ``text``."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            rest = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fp, pa.int64())], [*rest.schema.names, "fp"])

    kept = rows.drop("text")
    return rows.mapInArrow(run, StructType(kept.schema.fields).add("fp", LongType()))


def linked(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of the distinct ``fps`` the position of its linked set's first
    member, by a vantage-point tree."""
    parent = np.arange(len(fps))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def compare(a, b):
        for lo in range(0, len(a), 512):
            part = a[lo:lo + 512]
            near = np.bitwise_count(fps[part, None] ^ fps[None, b]) <= max_bits
            for i in np.nonzero(near.any(1))[0]:
                # a row's neighbours are soon in one set: only distinct parents are joined
                ends = {root(x) for x in np.unique(parent[b[near[i]]])} | {root(part[i])}
                first = min(ends)
                for x in ends:
                    parent[x] = first

    todo = [(np.arange(len(fps)), None)]
    while todo:
        a, b = todo.pop()
        if b is None:  # pairs within a
            if len(a) <= LEAF:
                compare(a, a)
                continue
            d = np.bitwise_count(fps[a] ^ fps[a[0]]).astype(np.int64)
            cut = int(np.median(d))
            if d.max() <= cut:
                cut -= 1
            near, far = d <= cut, d > cut
            if not near.any() or not far.any():
                compare(a, a)
                continue
            todo += [(a[near], None), (a[far], None),
                     (a[near & (d > cut - max_bits)], a[far & (d <= cut + max_bits)])]
        elif len(a) and len(b):  # pairs across the split
            if len(a) * len(b) <= LEAF * LEAF * 4:
                compare(a, b)
                continue
            v = fps[a[0]]
            da, db = np.bitwise_count(fps[a] ^ v).astype(np.int64), np.bitwise_count(fps[b] ^ v).astype(np.int64)
            cut = int(np.median(np.concatenate((da, db))))
            parts = [(a[da <= cut], b[db <= cut]), (a[da > cut], b[db > cut]),
                     (a[(da <= cut) & (da > cut - max_bits)], b[(db > cut) & (db <= cut + max_bits)]),
                     (a[(da > cut) & (da <= cut + max_bits)], b[(db <= cut) & (db > cut - max_bits)])]
            if any(len(x) * len(y) > 0.7 * len(a) * len(b) for x, y in parts):
                compare(a, b)
            else:
                todo += parts
    return np.array([root(i) for i in range(len(fps))], np.int64)


def masks(bits: int, parts: int) -> list[int]:
    """The set bits of ``bits`` dealt round to ``parts`` disjoint masks."""
    out, n = [0] * parts, 0
    for i in range(64):
        if bits >> i & 1:
            out[n % parts] |= 1 << i
            n += 1
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(fps: DataFrame, max_bits: int = 4, shard: int = SHARD) -> DataFrame:
    """(fp, used, value): the shards each distinct fingerprint belongs to;
    ``used`` is the set of bits on which a shard's members are equal."""
    open_, done, level = [(0, fps.select("fp"))], [], 0
    while open_:
        ahead = []
        for used, members in open_:
            rest = masks(~used & (1 << 64) - 1, max_bits + 1)
            keys = F.array(*[F.struct(F.lit(_signed(used | m)).alias("used"),
                                      F.col("fp").bitwiseAND(F.lit(_signed(used | m))).alias("value")) for m in rest])
            dealt = members.select("fp", F.explode(keys).alias("s")).select("fp", "s.used", "s.value")
            sizes = stage(dealt.groupBy("used", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            done.append(dealt.join(sizes.where(F.col("n") <= shard).select("used", "value"), ["used", "value"]))
            for (m,) in sizes.where(F.col("n") > shard).select("used").distinct().collect():  # at most max_bits + 1 masks
                big = dealt.where(F.col("used") == m).join(sizes.where(F.col("n") > shard).select("used", "value"), ["used", "value"])
                ahead.append((m & (1 << 64) - 1, big.select("fp").distinct()))
        open_, level = ahead, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def links(fps: DataFrame, max_bits: int = 4, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) that connect exactly the linked sets of the distinct
    fingerprints ``fps``: within each shard, every member with its set's first.

    A task takes a bundle of whole shards, about ``shard`` members in all."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["used", "value", "fp"])
        f, key = pdf["fp"].to_numpy(), pdf[["used", "value"]].to_numpy()
        ends = np.append(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1, len(f))
        u, v, at = [], [], 0
        for end in ends:
            own = f[at:end]
            r = linked(own.view(np.uint64), max_bits)
            tied = r != np.arange(len(own))
            u.append(own[tied])
            v.append(own[r[tied]])
            at = end
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    members = stage(shards(fps, max_bits, shard))
    bundles = max(1, 2 * members.count() // shard)
    bundle = F.pmod(F.xxhash64("used", "value"), F.lit(bundles)).alias("bundle")
    return members.select(bundle, "*").groupBy("bundle").applyInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = stage(fingerprints(docs, shingle))
    found = _component_ids(rows, max_bits)
    out = rows.join(found, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _roots(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, root): the distinct fingerprints of ``rows`` with their
    smallest id and their component's smallest fingerprint."""
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps, max_bits))
    at = fps.join(roots, fps["fp"] == roots["node"], "left")
    return at.select("fp", "least", F.coalesce("root", "fp").alias("root"))


def _component_ids(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``rows``."""
    at = _roots(rows, max_bits)
    return at.join(at.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest
    id, all columns as they were."""
    rows = wrap(docs, "doc_id", "text")
    fp = _with_fingerprint(rows.select("doc_id", utf8(F.col("text")).alias("text"), "row"), shingle)
    fp = stage(fp)
    per = _roots(fp.select("doc_id", "fp"), max_bits)
    keep = per.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("k"))
    keep = keep.select(F.col("k.fp").alias("keep_fp"), F.col("k.least").alias("keep_id"))
    kept = fp.join(keep, (fp["fp"] == keep["keep_fp"]) & fp["doc_id"].eqNullSafe(keep["keep_id"])).select("doc_id", "fp", "row")
    # rows that repeat both id and fingerprint: the first by content stays
    nth = F.row_number().over(Window.partitionBy("fp", "doc_id").orderBy(F.xxhash64("row")))
    return unwrap(kept.withColumn("nth", nth).where("nth = 1").select("row"), docs)
