"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendpace.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but space, tab, line feed, vertical tab, form
#: feed and carriage return (what ``bytes.split()`` does in Python).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns. They are found by position, so further
    columns of any name (also one that differs only in case) do not matter."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"c{df.columns.index(n)}"].alias(n) for n in names])


def wrap(df: DataFrame, *names: str) -> DataFrame:
    """The named columns beside ``row``, a struct of all columns by position;
    ``unwrap`` gives the rows their own columns back."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"c{df.columns.index(n)}"].alias(n) for n in names],
                       F.struct(*flat.columns).alias("row"))


def unwrap(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """Rows of ``wrap`` with the columns of ``like``; ``replaced`` gives new
    values for some of them."""
    cols = [replaced[n] if n in replaced else F.col(f"row.c{i}") for i, n in enumerate(like.columns)]
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).toDF(*like.columns)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read
    back: later uses neither recompute it nor depend on a lost executor."""
    return materialize(df)


def lowered(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n (a null id counts as empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def utf8(text: Column) -> Column:
    """The text's bytes for a Python task; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v): root is
    the smallest node of its component.

    Alternating star contraction: each node's neighbours are hung on the
    smallest one, first for larger neighbours, then for smaller ones, until
    nothing changes (logarithmically many rounds in practice). A round is two
    aggregates and two joins on the node; minima combine before the shuffle,
    skewed hubs are split by the join, and the edges are written to the shared
    folder after each round. Only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    cur = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stage(hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    # a star per component is left: every node points to its smallest one
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def first_by_hash(df: DataFrame, rows: int, by: str, *then: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of the column ``by``. Of many
    values only those below a hash that about four times ``rows`` of them pass
    go to the sort, so what its one last task gets does not grow."""
    h = F.xxhash64(by)
    values = df.agg(F.approx_count_distinct(by)).first()[0]
    if values > 8 * rows:
        df = df.where(h < int(-2**63 + 2**66 * rows // values))
    return df.orderBy(h, by, *then).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents, the first by a hash
    of the id; ids whose fold is ``held`` are never looked at. Of conflicting
    labels of one id the larger counts. The bound makes the broadcast safe."""
    known = pick(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = first_by_hash(known, rows, "doc_id")
    text = pick(docs, "doc_id", "text").select("doc_id", utf8(F.col("text")).alias("text"))
    return text.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(rows).select("text", "y")


def scored(docs: DataFrame, score, folds: int, held: int, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``score`` maps a
    list of byte strings to an array and is shipped with the task."""
    import pyarrow as pa

    rows = pick(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"),
                                               utf8(F.col("text")).alias("text"))

    def run(batches):
        for b in batches:
            s = pa.array(score(b.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), s], ["doc_id", "held_out", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
