"""Secret scans with corpus-wide ownership frequency.

``scan`` finds candidate spans in each whole text by fixed patterns: the three
base kinds, and further kinds that the method may add. ``ownership`` counts for
each candidate value (its hash) how many distinct owners (sources) hold it. A
further candidate becomes a span unless more owners hold it than ``widely``
allows, 2 and more the more owners there are: a value copied that widely is an
example, a test vector or a licence number, not a live credential. How many
documents of an owner hold a value does not matter, so neither a repeated
configuration nor a group of copies takes a credential away. Base spans always
stay; ``live`` counts those of a document's spans whose value is not widely
copied.

Candidates are a small part of the corpus: texts are read once and never
shuffled, candidate rows are reduced to distinct (value, owner) pairs within
each task before they are counted, so a value that occurs in a third of all
rows is one row per task and owner.

Defined results: a null text is empty; documents without spans have zero
counts, the hash of the empty string and an empty ``spans``; a null source is
an owner of its own; rows that repeat an id are scanned each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import pick, stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Kinds the method adds: published prefixes of service tokens, signed web
#: tokens, and mixed runs of letters and digits.
FURTHER = {
    "service": re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}"),
    "signed": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "mixed": re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{24,}"),
}


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base kinds, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(out)]


def entropy(value: str) -> float:
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def further_spans(text: str, taken: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int, str]]:
    """Candidates of the further kinds that overlap no earlier span."""
    out, busy = [], [(s, e) for s, _, e, _ in taken]
    for kind, pattern in FURTHER.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            if entropy(m[0]) >= 3.5 and all(e <= a or s >= b for a, b in busy):
                out.append((s, kind, e, m[0]))
                busy.append((s, e))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``spans``, an array of (start, kind, end, value hash,
    whether the kind is a base one), in order."""
    import pyarrow as pa

    rows = pick(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    span = "spans array<struct<start:long,kind:string,end:long,value:string,base:boolean>>"

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                found = [(*x, True) for x in base] + [(*x, False) for x in further_spans(text, base)]
                out.append([{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()[:32], "base": own}
                            for s, k, e, v, own in sorted(found, key=lambda x: (x[0], not x[4], KINDS.index(x[1]) if x[4] else x[1]))])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(out, kind)], ["doc_id", "source", "spans"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, {span}")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners) from candidate rows (value, source)."""
    return candidates.select("value", F.struct("source").alias("s")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))


def widely(owners: int) -> int:
    """Of so many owners, how many may hold a value that is not an example."""
    return max(2, round(owners ** 0.5 / 2))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts and hash, ``spans``, and how many
    spans hold a live (``n_live``) or widely copied value (``n_copied``)."""
    scanned = stage(scan(docs).withColumn("row", F.expr("uuid()")))
    found = scanned.where(F.size("spans") > 0)
    each = found.select("row", "source", F.explode("spans").alias("s")).select("row", "source", "s.*")
    most = widely(scanned.select(F.struct("source")).distinct().count())
    owned = ownership(each).select("value", (F.col("owners") <= most).alias("live"))
    judged = each.join(owned, "value").where("base or live")
    place = F.struct("start", (~F.col("base")).alias("later"), F.when(F.col("kind") == "assign", 0).when(
        F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3).alias("nth"), "kind", "end", "live")
    per = judged.groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("s"))
    text = F.concat_ws(",", F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    per = per.select("row", text.alias("all_spans"), F.size(F.filter("s", lambda x: x["live"])).cast("long").alias("n_live"),
                     F.size(F.filter("s", lambda x: ~x["live"])).cast("long").alias("n_copied"))
    line = F.concat_ws(",", F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    none = F.lit(0).cast("long")
    return scanned.join(per, "row", "left").select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line, 256).alias("base_sha256"), F.coalesce("all_spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_copied", none).alias("n_copied"))
