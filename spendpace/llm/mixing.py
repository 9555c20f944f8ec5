"""Mixing sources to target weights by capped water-filling (DataFrame
operations only).

``targets`` gives each source its words: the whole budget is poured by weight,
a source stops at ``max_epochs`` times its own size, and what it cannot take is
shared among the others by weight until nobody is above. Sorted by the level at
which they fill up (cap over weight), the full sources are a prefix, so the
level is found from running sums over the sources; the documents are not
touched again for it.

``mix`` then gives every document of a source its whole repetitions and one
further repetition to documents in seeded order until the target's words are
met; the document at the end gets the part that is left. The seeded order is a
running sum in two steps, over slices of the order and within each slice, so a
source that holds a third of all rows is spread over many tasks.

Defined results: a null text has size 0 and takes nothing; null ``source`` is
a source of its own, the last one; sources without words get target 0; a null
``doc_id`` is ordered as empty text; rows that repeat id and size are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace.llm.common import WORD, pick, stage, unwrap, wrap

#: Documents in a slice of the seeded order, on average.
SLICE_ROWS = 4096


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Windows here run over the list of sources, not over documents."""
    everything = Window.partitionBy(F.lit(1))
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("nth"))
    ranked = ranked.select("source", "source_size", (F.col("nth") % 3 + 1).cast("long").alias("weight"), "nth",
                           (F.col("source_size") * max_epochs).alias("cap"))
    # a source is full once the level (words per unit of weight) passes cap / weight
    before = (Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "nth")
              .rowsBetween(Window.unboundedPreceding, -1))
    filled = ranked.select("*", F.sum("source_size").over(everything).alias("total"),
                           F.sum("weight").over(everything).alias("weights"),
                           F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")).alias("cap_before"),
                           F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long")).alias("weight_before"))
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    filled = filled.select("*", level.alias("level"), (F.col("cap") <= F.col("weight") * level).alias("is_full"))
    # the level at which the first source that never fills up stands holds for all after it
    final = F.min(F.when(~F.col("is_full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "nth", "level"))).over(everything)
    return filled.select("source", "source_size", "weight", F.when(
        F.col("is_full"), F.col("cap").cast("double")).otherwise(F.col("weight") * final["level"]).alias("target"))


def plan(rows: DataFrame, seed: int = 7, max_epochs: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with source_size, target and taken."""
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    total = stage(total)
    goal = targets(total.select("source", "source_size"), max_epochs)
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"),
                       (words - whole * F.col("source_size")).alias("rest"))
    n = total.agg(F.max("n_docs")).first()[0] or 0
    bits = min(56, max(0, (n // slice_rows).bit_length()))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # the order's leading bits name the slice
    cut = F.shiftrightunsigned(F.conv(F.substring(key, 1, 14), 16, 10).cast("long"), 56 - bits) if bits else F.lit(0).cast("long")
    keyed = rows.select("*", key.alias("order_key"), cut.alias("slice"))
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("slice").alias("sl"),
                       F.coalesce(F.sum("slice_size").over(run), F.lit(0).cast("long")).alias("slice_before"))
    sums = sums.join(goal, sums["s"].eqNullSafe(goal["s"])).select(sums["s"], "sl", "slice_before", "source_size", "target", "whole", "rest")
    ties = [c for c in ("tie",) if c in rows.columns]
    inside = Window.partitionBy("source", "slice").orderBy("order_key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("here", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    out = keyed.join(sums, keyed["source"].eqNullSafe(sums["s"]) & (keyed["slice"] == sums["sl"]))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("slice_before") - F.col("here")))
    return out.select(*[out[c] for c in rows.columns], "source_size", "target", "whole", part.alias("part"),
                      (F.col("whole") * F.col("size") + part).alias("taken"))


def mix(docs: DataFrame, seed: int = 7, max_epochs: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, whole, part."""
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return plan(stage(rows), seed, max_epochs).select("doc_id", "size", "source_size", "target", "taken", "whole", "part")


def mixed(docs: DataFrame, seed: int = 7, max_epochs: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is repeated, all columns
    as they were. The document that is taken in part is cut after its last
    word taken, and its ``n_chars``, if it has that column, is the cut text's."""
    rows = wrap(docs, "doc_id", "text", "source")
    rows = rows.select("doc_id", "source", "row", size_of(F.col("text")).alias("size"), F.xxhash64("row").alias("tie"))
    at = plan(rows, seed, max_epochs).where("taken > 0")
    text = F.col(f"row.c{docs.columns.index('text')}")
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")), lambda i: F.lit(None).cast("long"))
    copies = F.when(F.col("whole") > 0, copies).otherwise(F.array().cast("array<bigint>"))
    last = F.when(F.col("part") == F.col("size"), F.array(F.lit(None).cast("long"))).when(
        F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>"))
    at = at.select("row", F.explode(F.concat(copies, last)).alias("words"))
    # pieces of one word each, with the white space before it
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("words").isNull(), text).otherwise(F.concat_ws("", F.slice(pieces, F.lit(1), F.col("words").cast("int"))))
    new = {"text": cut}
    if "n_chars" in docs.columns:
        kept = F.col(f"row.c{docs.columns.index('n_chars')}")
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("words").isNull(), kept).otherwise(F.length(cut).cast(kind))
    return unwrap(at, docs, **new)
