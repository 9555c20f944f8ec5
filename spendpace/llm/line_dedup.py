"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line without white space (space, tab, line feed, vertical
tab, form feed, carriage return) at both ends, A-Z lower-cased. A key of at
least ``min_chars`` code points found in at least ``min_docs`` documents loses
its lines everywhere except in the largest doc_id that holds it (all of them
stay there). Shorter and rarer lines are not touched.

* Every line long enough becomes (128-bit hash of its key, doc_id, position);
  texts do not move.
* These are partitioned by ranges of (hash, doc_id) and sorted by hash, doc_id
  descending and position. Ranges split inside a hash, so a line of a third of
  all documents is spread over many tasks.
* Each task streams its rows: the first document of a run of equal hashes keeps
  its lines, the lines of later ones are dropped from the ``min_docs``-th
  document on, and those before it are held till then. Memory is a batch and
  the held lines of at most ``min_docs`` documents.
* A run at either end of a task may go on in the next one. Such a run gives a
  summary (documents, largest id), at most two a task; the summaries add up by
  hash and decide the lines that were left pending.
* The dropped positions of a document become one compressed bitmap
  (``keep_bitmaps``), which is joined with the document's text where the text
  is wanted (``kept_lines``).

Defined results: a null or empty text is one empty line; a document all of
whose lines go has the empty text; rows that share a doc_id count as one
document, and rows equal in id and text get the same bitmap; a null doc_id is
one document, smaller than any other; an empty table gives an empty result;
texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spendpace.llm.common import pick, stage, unwrap, utf8, wrap

MIN_CHARS, MIN_DOCS = 40, 5

_DROP, _PENDING, _RUN = 0, 1, 2


def _long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, position, h1, h2 of every line that is long enough."""
    import pyarrow as pa

    rows = pick(docs, "doc_id", "text").select("doc_id", utf8(F.col("text")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            row, at, keys = [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                if len(text) < min_chars:
                    continue
                for p, line in enumerate(text.lower().split(b"\n")):
                    if len(line) >= min_chars:
                        line = line.strip()
                        if _long_enough(line, min_chars):
                            row.append(r)
                            at.append(p)
                            keys.append(digest(line))
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(row), b.column("text_hash").take(row), pa.array(at, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                ["doc_id", "text_hash", "position", "h1", "h2"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, position int, h1 long, h2 long")


class Run:
    """The run of equal hashes that a task's stream is in. ``first``: it began
    with the task, so an earlier task may hold its largest document."""

    def __init__(self, key, top, first):
        self.key, self.top, self.first, self.docs, self.last, self.held = key, top, first, 0, None, []


def drops(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, position of the lines of ``occurrences`` to drop."""
    import pyarrow as pa

    kind = rows.schema["doc_id"].dataType.simpleString()
    late_first = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange("h1", "h2", late_first).sortWithinPartitions("h1", "h2", late_first, "position")

    def run(batches):
        names = ["kind", "doc_id", "text_hash", "position", "h1", "h2", "docs"]
        now, doc_type = None, None

        def lines(what, part):
            n = part.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, what, np.int8)), *(part.column(c) for c in names[1:6]), pa.nulls(n, pa.int64())], names)

        def summary(r):
            kinds = [pa.int8(), doc_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            row = [_RUN, r.top, None, None, *r.key, r.docs]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for b in batches:
            if not b.num_rows:
                continue
            doc, h1, h2 = b.column("doc_id"), b.column("h1").to_numpy(), b.column("h2").to_numpy()
            doc_type = doc.type
            code = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
            n = b.num_rows
            new_run, new_doc = np.ones(n, bool), np.ones(n, bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc[1:] = new_run[1:] | (code[1:] != code[:-1])
            if now is not None and now.key == (int(h1[0]), int(h2[0])):
                new_run[0], new_doc[0] = False, doc[0].as_py() != now.last
            starts = np.nonzero(new_run)[0]
            count = np.cumsum(new_doc)
            base = np.concatenate([[-now.docs if now is not None else 0], count[starts] - 1])
            of = np.cumsum(new_run)
            rank = count - base[of]
            ends = np.concatenate([starts[1:] - 1, [n - 1]]) if len(starts) else np.array([], int)
            # the run that was open
            head = int(starts[0]) if len(starts) else n
            if now is not None:
                if head:
                    part = b.slice(0, head)
                    now.docs, now.last = int(rank[head - 1]), doc[head - 1].as_py()
                    if now.first:
                        yield lines(_PENDING, part)
                    else:
                        now.held.append(part.filter(pa.array(rank[:head] > 1)))
                        if now.docs >= min_docs:
                            yield from (lines(_DROP, x) for x in now.held)
                            now.held = []
                if len(starts) and now.first:
                    yield summary(now)
            if not len(starts):
                continue
            # runs that begin and end here, and the last one, which stays open
            total = rank[ends]
            drop = (rank > 1) & (of > 0)
            drop &= np.concatenate([[0], total])[of] >= min_docs
            begin = int(starts[-1])
            last = Run((int(h1[begin]), int(h2[begin])), doc[begin].as_py(), now is None and len(starts) == 1)
            last.docs, last.last = int(total[-1]), doc[n - 1].as_py()
            if now is None:  # the task's first run, which an earlier task may have begun
                drop[:int(ends[0]) + 1] = False
                yield lines(_PENDING, b.slice(0, int(ends[0]) + 1))
                if len(starts) > 1:
                    first = Run((int(h1[0]), int(h2[0])), doc[0].as_py(), True)
                    first.docs = int(total[0])
                    yield summary(first)
            yield lines(_DROP, b.filter(pa.array(drop)))
            if not last.first and last.docs < min_docs:
                last.held.append(b.slice(begin).filter(pa.array(rank[begin:] > 1)))
            now = last
        if now is not None:
            yield from (lines(_PENDING, x) for x in now.held)
            yield summary(now)

    told = stage(dealt.mapInArrow(run, f"kind byte, doc_id {kind}, text_hash long, position int, h1 long, h2 long, docs long"))
    # at most two runs of a task are told, so the sums are few
    runs = told.where(F.col("kind") == _RUN).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("doc_id").alias("top"))
    runs = runs.where(F.col("total") >= min_docs)
    late = told.where(F.col("kind") == _PENDING).drop("docs").join(F.broadcast(runs), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    cols = ["doc_id", "text_hash", "position"]
    return told.where(F.col("kind") == _DROP).select(*cols).unionByName(late.select(*cols))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, keep of every document that loses lines; ``keep`` is a
    deflated bitmap with a 1 for each line that stays, up to the last one
    dropped (all lines after it stay)."""
    import pyarrow as pa

    lost = drops(stage(occurrences(docs, min_chars)), min_docs)
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("lost"))
    kind = lost.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            maps = []
            for lost in b.column("lost").to_pylist():
                keep = np.ones((max(lost) // 8 + 1) * 8, bool)
                keep[lost] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "keep"])

    return lost.mapInArrow(run, f"doc_id {kind}, text_hash long, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The kept lines of a text, its number of lines and of dropped ones."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:len(lines)]
    gone = set(np.nonzero(stays == 0)[0].tolist())
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _beside(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) with their documents' bitmaps. The bitmaps are
    the small side, so the texts need no sort."""
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    maps = maps.select(F.col("doc_id").alias("map_id"), F.col("text_hash").alias("map_hash"), "keep").hint("shuffle_hash")
    return rows.join(maps, (F.col("text_hash") == F.col("map_hash")) & F.col("doc_id").eqNullSafe(F.col("map_id")), "left")


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns as they were, ``text`` without its dropped
    lines (a text that loses none stays as it is, null included)."""
    import pyarrow as pa

    maps = stage(keep_bitmaps(docs, min_chars, min_docs))
    rows = _beside(wrap(docs, "doc_id", "text").select("doc_id", utf8(F.col("text")).alias("text"), "row"), maps)

    def run(batches):
        for b in batches:
            text = [None if k is None else apply_bitmap(t, k)[0].decode("utf-8", "replace")
                    for t, k in zip(b.column("text").to_pylist(), b.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), b.column("row")], ["kept", "row"])

    kept = rows.select("text", "keep", "row").mapInArrow(run, StructType([StructField("kept", StringType()), rows.schema["row"]]))
    return unwrap(kept, docs, text=F.coalesce("kept", F.col(f"row.c{docs.columns.index('text')}")))


def digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    import pyarrow as pa

    maps = stage(keep_bitmaps(docs, min_chars, min_docs))
    rows = _beside(pick(docs, "doc_id", "text").select("doc_id", utf8(F.col("text")).alias("text")), maps)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [apply_bitmap(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.select("doc_id", "text", "keep").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
