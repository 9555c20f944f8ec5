"""Exact duplicates of whole texts through an extendible-hash index on shared
files (DataFrame operations only).

Keys are 64-bit hashes of the normalised text (A-Z lower-cased, null read as
empty). ``directory`` grows the index's directory: it starts at the depth at
which the mean bucket is half full and, as long as a bucket holds more keys
than fit, doubles: the overfull buckets alone are split by one more leading
hash bit. The result says for each bucket its depth and leading bits, and is
stored with the slim entries (hash, digest, id) on the shared files. Each
bucket is a key range, so one shuffle by bucket gives every range an owner
task. A key that several rows share is a chain; the owner compares the chain's
texts byte by byte (grouping by the text itself), so texts that merely share a
hash stay apart, as separate links of the chain.

Only rows on chains of two or more bring their text to that comparison, and
equal texts are combined before the shuffle: a text that makes up a third of
all rows is one row per task there.

Defined results: null text equals empty text; a null ``doc_id`` loses to any
other, and the group's ``keep_id`` is null only if all are; of rows that repeat
the kept id and the text, one is kept; an empty table gives an empty result;
further columns are ignored by ``duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace.llm.common import lowered, pick, stage, unwrap, wrap

#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 65_536


def _prefix(hash_col, depth: int):
    """The hash's leading ``depth`` bits as a number."""
    return F.shiftrightunsigned(hash_col, 64 - depth) if depth else F.lit(0).cast("long")


def entries(docs: DataFrame) -> DataFrame:
    """Index entries (doc_id, hash, digest, n) of all rows, n counting rows
    that repeat an id and a text."""
    norm = pick(docs, "doc_id", "text").select("doc_id", lowered(F.col("text")).alias("t"))
    return (norm.select("doc_id", F.xxhash64("t").alias("hash"), F.sha2("t", 256).alias("digest"))
            .groupBy("hash", "digest", "doc_id").agg(F.count(F.lit(1)).alias("n")))


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Buckets (depth, prefix, n_keys) over the distinct ``hash`` of ``keys``.

    Each doubling counts only keys below overfull buckets; a bucket stops at
    64 bits, where it is one key and its chain."""
    total = keys.count()
    depth = max(0, (2 * total // bucket_keys).bit_length())
    done, open_keys = None, keys
    while True:
        at = open_keys.groupBy(_prefix(F.col("hash"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n_keys"))
        at = stage(at.select(F.lit(depth).alias("depth"), "prefix", "n_keys"))
        full = at.where((F.col("n_keys") > bucket_keys) & F.lit(depth < 64))
        settled = at.where((F.col("n_keys") <= bucket_keys) | F.lit(depth >= 64))
        done = settled if done is None else done.unionByName(settled)
        if full.isEmpty():
            return done
        open_keys = keys.join(full.select(F.col("prefix").alias("p")), _prefix(F.col("hash"), depth) == F.col("p"), "left_semi")
        depth += 1


def with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows with the bucket (``depth``, ``prefix``) that owns their ``hash``:
    one equi-join per distinct depth of the directory (a few)."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    parts = [rows.withColumn("prefix", _prefix(F.col("hash"), d)).join(
        buckets.where(F.col("depth") == d).select("depth", "prefix"), "prefix") for d in depths]
    out = parts[0] if parts else rows.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _chains(docs: DataFrame, bucket_keys: int):
    """(entries, links): all entries, and per text on a shared key one link
    (hash, digest, link, keep_id, group_size, ties) after comparing bytes."""
    index = stage(entries(docs))
    keys = stage(index.groupBy("hash").agg(F.sum("n").alias("rows")).select("hash", "rows"))
    chained = with_bucket(keys.where("rows > 1"), directory(keys, bucket_keys)).select("depth", "prefix", "hash")
    texts = pick(docs, "doc_id", "text").select("doc_id", lowered(F.col("text")).alias("t"))
    texts = texts.withColumn("hash", F.xxhash64("t"))
    # copies combine within each task before the owner of the range sees them
    seen = texts.join(chained, "hash").groupBy("depth", "prefix", "hash", "t").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = seen.select("hash", F.sha2("t", 256).alias("digest"), "keep_id", "group_size",
                        F.row_number().over(Window.partitionBy("depth", "prefix", "hash").orderBy("t")).alias("link"))
    return index, stage(links)


def duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256,
    and ``link``, the text's place on its key's chain (1 without collisions).

    The largest ``doc_id`` of equal texts is kept."""
    index, links = _chains(docs, bucket_keys)
    out = index.join(links, ["hash", "digest"], "left").select(
        "doc_id", "n", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("link", F.lit(1)).alias("link"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return out.select("*", copy.alias("copy")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"), "link")


def keep_one(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The documents without their copies, all columns as they were."""
    index, links = _chains(docs, bucket_keys)
    rows = wrap(docs, "doc_id", "text").withColumn("t", lowered(F.col("text")))
    rows = rows.select("doc_id", "row", F.xxhash64("t").alias("hash"), F.sha2("t", 256).alias("digest"))
    # kept ids that several rows bear beside the same text
    repeated = stage(index.where("n > 1").join(links, ["hash", "digest"]).where("doc_id <=> keep_id")
                     .select("hash", "digest", F.lit(True).alias("repeated")))
    if repeated.isEmpty():
        rows = rows.join(links, ["hash", "digest"], "left")
        return unwrap(rows.where("group_size is null or doc_id <=> keep_id").select("row"), docs)
    marked = links.join(repeated, ["hash", "digest"], "left")
    kept = rows.join(marked, ["hash", "digest"], "left").where("group_size is null or doc_id <=> keep_id")
    same = Window.partitionBy("hash", "digest").orderBy(F.xxhash64("row"))
    one = kept.where("repeated").withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row")
    return unwrap(kept.where("repeated is null").select("row").unionByName(one), docs)
