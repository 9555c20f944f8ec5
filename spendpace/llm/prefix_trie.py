"""The prefix trie of conversations as a z-fast trie kept in tables.

A conversation is a string of turns. Its prefix of d turns is named by a chained
128-bit hash, so a prefix is found by one equality and texts do not move. The
trie is compacted: a node's edge runs from depth ``a`` (its parent's extent) to
its own extent at depth ``b``, where prefixes branch or a conversation ends.
Its handle is the prefix at the two-fattest depth of (a, b], the one divisible
by the largest power of two.

* Conversations that are the same string are inserted once; strings are inserted
  in batches, each a multiple of the one before, so that what most strings share
  is in the trie before most strings come.
* A batch finds its exit nodes by fat binary search: for the depths (a, b] still
  open, a string asks for its prefix at the two-fattest depth among the nodes'
  handles. A node found moves ``a`` to its extent, none moves ``b`` below. A
  step is one equality join of the whole batch, their number the logarithm of
  the longest string. The edge that a string then follows is found by its first
  prefix, and the hashes along it give the depth where the string leaves it.
* Edges that strings leave or end in are split there; the strings' rests beyond
  the exit depth are compacted among themselves (prefixes with more than one
  continuation, or an end) and added.
* Members, leaves and sizes of subtrees are added up by pointer doubling over
  the compacted tree (a node adds its sum to its ancestor 2^k edges up), so the
  rounds are the logarithm of its height, whatever a node's number of children.
* Edges are expanded to one row per depth at the end.

A prefix shared by a third of all conversations is one row of the trie after the
first batch, and within a batch its copies combine before each shuffle.

The hash of the members that end in a node is taken over their ids in order:
ids are sorted by ranges of (node, id) and joined to text piecewise in all
tasks; only nodes that reach over a task's ends go on to a second step, which
reads the pieces (a few per task) in order.

Defined results: conversations are ordered by turn (null first); of equal turns
by the MD5 of role and text; a null role or text is empty; a null conv_id is a
conversation of empty decimal form (which keeps all its own turns), and counts
as the smallest in a member list, though ``conv_id`` is the smallest that is
not null; equal rows are turns each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import pick, stage

#: Shares of the strings, by hash, that the first batches take; the last takes
#: what is left.
BATCHES = (16, 4, 1)
ROOT = b"\0" * 16

_NODE = "ext binary, up binary, a int, b int, hs array<binary>, sizes array<long>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: (digest of role and text, bytes of the text) in order."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.struct("turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("t"),
                                           F.octet_length(text).cast("long").alias("n")).alias("x"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return turns.select("conv_id", F.transform("x", lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns of every conversation c: the first h turns of conversation
    c - c % 5, then its own after its first h; h is the CRC-32 of c modulo 9."""
    decimal = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    own = stage(turns.withColumn("h", (F.crc32(decimal.cast("binary")) % 9).cast("int")))
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("donor"), F.slice("turns", 1, 8).alias("head"))
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("donor"), "left")
    none = F.array().cast(own.schema["turns"].dataType)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def strings(turns: DataFrame) -> DataFrame:
    """conv_id, n, hs, sizes: the hashes of its prefixes of 0 to n turns, and
    the bytes of each turn's text."""
    import pyarrow as pa

    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        chain = xxhash.xxh3_128_digest
        for b in batches:
            hashes, sizes = [], []
            for conversation in b.column("turns").to_pylist():
                h = [ROOT]
                for turn in conversation:
                    h.append(chain(h[-1] + turn["t"]))
                hashes.append(h)
                sizes.append([turn["n"] for turn in conversation])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([len(s) for s in sizes], pa.int32()), pa.array(hashes, pa.list_(pa.binary())),
                                              pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "n", "hs", "sizes"])

    return turns.mapInArrow(run, f"conv_id {kind}, n int, hs array<binary>, sizes array<long>")


def fattest(a: Column, b: Column) -> Column:
    """The two-fattest number of (a, b]: b without the bits below the highest
    one in which it differs from a."""
    low = F.pow(F.lit(2), F.floor(F.log2(F.greatest(a.bitwiseXOR(b), F.lit(1)).cast("double")))).cast("int")
    return b - F.pmod(b, low)


def at(hs: Column, depth: Column) -> Column:
    """The prefix hash at a depth (arrays hold depth 0 first)."""
    return F.get(hs, depth)


def exits(batch: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """The batch (end, n, hs, sizes) with ``l``, the depth where each string
    leaves the trie, and ``inside``, the extent of the node in whose edge that
    is (null at an extent)."""
    handle = F.get("hs", fattest(F.col("a"), F.col("b")) - F.col("a") - 1)
    handles = trie.where("b > 0").select(handle.alias("handle"), F.col("ext").alias("found"), F.col("a").alias("from"), F.col("b").alias("to"))
    now = batch.select("*", F.lit(0).alias("a"), F.col("n").alias("b"))
    for _ in range(max(1, longest).bit_length()):
        asked = F.when(F.col("a") < F.col("b"), at(F.col("hs"), fattest(F.col("a"), F.col("b"))))
        now = now.withColumn("key", asked).join(handles, F.col("key") == F.col("handle"), "left")
        whole = F.coalesce(at(F.col("hs"), F.col("to")) == F.col("found"), F.lit(False))
        now = now.select(
            *batch.columns,
            F.when(F.col("found").isNull(), F.col("a")).when(whole, F.col("to")).otherwise(F.col("from")).alias("a"),
            F.when(F.col("key").isNull(), F.col("b")).when(F.col("found").isNull(), fattest(F.col("a"), F.col("b")) - 1).when(whole, F.col("b")).otherwise(F.col("from")).alias("b"))
    # the node whose edge begins with the string's next prefix, if there is one
    edges = trie.where("b > 0").select(F.get("hs", F.lit(0)).alias("first"), F.col("ext").alias("edge"), F.col("hs").alias("along"), F.col("a").alias("from"), F.col("b").alias("to"))
    now = now.withColumn("next", at(F.col("hs"), F.col("a") + 1)).join(edges, F.col("next") == F.col("first"), "left")
    same = F.size(F.filter(F.zip_with("along", F.slice("hs", F.col("a") + 2, F.greatest(F.size("along"), F.lit(1))), lambda x, y: x.eqNullSafe(y)), lambda x: x))
    leave = F.when(F.col("edge").isNull(), F.col("a")).otherwise(F.col("a") + same)
    return now.select(*batch.columns, leave.alias("l"), F.when(leave < F.col("to"), F.col("edge")).alias("inside"))


def compacted(batch: DataFrame) -> DataFrame:
    """Nodes for the strings' rests beyond depth ``l``."""
    rest = batch.where("l < n").select("end", "hs", "n", F.explode(F.sequence(F.col("l") + 1, F.col("n"))).alias("d"))
    rest = rest.select("end", "d", F.get("hs", F.col("d")).alias("h"), F.get("hs", F.col("d") + 1).alias("next"))
    extents = rest.groupBy("h").agg(F.min("next").alias("p"), F.max("next").alias("q"), F.max(F.col("next").isNull()).alias("ends"))
    extents = extents.where("ends or p <> q").select("h")
    cuts = rest.join(extents, "h", "left_semi").groupBy("end").agg(F.sort_array(F.collect_list("d")).alias("cuts"))
    edges = batch.join(cuts, "end").select(
        "hs", "sizes", F.explode(F.zip_with(F.concat(F.array("l"), F.slice("cuts", 1, F.size("cuts") - 1)), "cuts", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    return _nodes(edges, "hs", "sizes", F.col("e.a"), F.col("e.b")).dropDuplicates(["ext"])


def _nodes(rows: DataFrame, hs: str, sizes: str, a: Column, b: Column) -> DataFrame:
    """Nodes with edges (a, b] of strings whose hashes begin at depth 0."""
    return rows.select(F.get(hs, b).alias("ext"), F.get(hs, a).alias("up"), a.alias("a"), b.alias("b"),
                       F.slice(hs, a + 2, b - a).alias("hs"), F.slice(sizes, a + 1, b - a).alias("sizes"))


def split(trie: DataFrame, cuts: DataFrame) -> DataFrame:
    """The trie with edges split at ``cuts`` (inside, l)."""
    cuts = cuts.where("inside is not null").groupBy("inside").agg(F.sort_array(F.collect_set("l")).alias("cuts"))
    both = trie.join(cuts, F.col("ext") == F.col("inside"), "left")
    pieces = F.concat(F.array("a"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("b"))
    both = both.withColumn("cuts", F.when(F.col("b") > 0, pieces).otherwise(F.array("a", "b")))
    e = F.explode(F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("x"), b.alias("y")))).alias("e")
    both = both.select("ext", "up", "a", "b", "hs", "sizes", e)
    x, y, a = F.col("e.x"), F.col("e.y"), F.col("a")
    return both.select(F.when(y == F.col("b"), F.col("ext")).otherwise(F.get("hs", y - a - 1)).alias("ext"),
                       F.when(x == a, F.col("up")).otherwise(F.get("hs", x - a - 1)).alias("up"), x.alias("a"), y.alias("b"),
                       F.slice("hs", x - a + 1, F.greatest(y - x, F.lit(0))).alias("hs"), F.slice("sizes", x - a + 1, F.greatest(y - x, F.lit(0))).alias("sizes"))


def build(texts: DataFrame, batches=BATCHES) -> DataFrame:
    """The compacted trie (ext, up, a, b, hs, sizes) of ``strings``."""
    distinct = stage(texts.select(F.get("hs", F.col("n")).alias("end"), "n", "hs", "sizes").dropDuplicates(["end"]))
    longest = distinct.agg(F.max("n")).first()[0]
    if longest is None:
        return texts.sparkSession.createDataFrame([], _NODE)
    trie = texts.sparkSession.createDataFrame([(ROOT, None, 0, 0, [], [])], _NODE)
    share, before = F.pmod(F.xxhash64("end"), F.lit(batches[0])), 0
    for i, part in enumerate(batches):
        upto = batches[0] // part
        batch = distinct.where((share >= before) & (share < upto))
        before = upto
        batch = batch.withColumn("l", F.lit(0)).withColumn("inside", F.lit(None).cast("binary")) if i == 0 else stage(exits(batch, trie, longest))
        grown = compacted(batch) if i == 0 else split(trie, batch.select("inside", "l")).unionByName(compacted(batch))
        trie = stage(grown.unionByName(trie) if i == 0 else grown)
    return trie


def summed(values: DataFrame, links: list[DataFrame], how: dict) -> DataFrame:
    """Subtree totals of ``values`` (ext, ...): ``how`` maps a column to F.sum or
    F.min; ``links[k]`` leads from a node to its ancestor 2^k edges up."""
    names = list(how)
    total = values
    for link in links:
        lifted = link.join(total, "ext").select(F.col("anc").alias("ext"), *names)
        total = stage(total.unionByName(lifted).groupBy("ext").agg(*[f(n).alias(n) for n, f in how.items()]))
    return total


def ancestors(trie: DataFrame) -> list[DataFrame]:
    """(ext, anc) for ancestors 1, 2, 4, ... edges up, as long as there are any."""
    out = [stage(trie.where(F.col("up").isNotNull()).select("ext", F.col("up").alias("anc")))]
    while True:
        step = out[-1]
        further = stage(step.join(step.select(F.col("ext").alias("anc"), F.col("anc").alias("far")), "anc").select("ext", F.col("far").alias("anc")))
        if further.isEmpty():
            return out
        out.append(further)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(ext, ends_sha256): SHA-256 of the ids in order, joined by commas, of the
    conversations (ext, conv_id) that end in each node."""
    import pyarrow as pa

    ids = ends.select("ext", F.col("conv_id").alias("id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary").alias("text"))
    dealt = ids.repartitionByRange("ext", "id").sortWithinPartitions("ext", "id")

    def pieces(batches):
        """Nodes inside a task are whole; the others are given in pieces."""
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        now, held, size, first = None, [], 0, True

        def give(whole):
            nonlocal held, size, count
            count += 1
            data = b",".join(held)
            held, size = [], 0
            return now, task << 33 | count, hashlib.sha256(data).digest() if whole else data, whole

        def rows():
            nonlocal now, size, first
            broken = False
            for b in batches:
                for ext, text in zip(b.column("ext").to_pylist(), b.column("text").to_pylist()):
                    if ext != now:
                        if held:
                            yield give(not first and not broken)
                        if now is not None:
                            first, broken = False, False
                        now = ext
                    held.append(text)
                    size += len(text) + 1
                    if size > 1 << 18:
                        broken = True
                        yield give(False)
            if held:
                yield give(False)

        for some in _some(rows(), 256):
            ext, place, data, whole = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(ext, pa.binary()), pa.array(place, pa.int64()), pa.array(data, pa.binary()), pa.array(whole, pa.bool_())],
                                             ["ext", "place", "piece", "whole"])

    told = stage(dealt.mapInArrow(pieces, "ext binary, place long, piece binary, whole boolean"))

    def joined(batches):
        def rows():
            now, sha = None, None
            for b in batches:
                for ext, piece in zip(b.column("ext").to_pylist(), b.column("piece").to_pylist()):
                    if ext != now:
                        if now is not None:
                            yield now, sha.hexdigest()
                        now, sha = ext, hashlib.sha256(piece)
                    else:
                        sha.update(b"," + piece)
            if now is not None:
                yield now, sha.hexdigest()

        for some in _some(rows(), 4096):
            ext, name = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(ext, pa.binary()), pa.array(name, pa.string())], ["ext", "ends_sha256"])

    late = told.where("not whole").select("ext", "place", "piece").repartition("ext").sortWithinPartitions("ext", "place")
    return told.where("whole").select("ext", F.lower(F.hex("piece")).alias("ends_sha256")).unionByName(late.mapInArrow(joined, "ext binary, ends_sha256 string"))


def _some(rows, n):
    while some := list(itertools.islice(rows, n)):
        yield some


def trie_nodes(texts: DataFrame, batches=BATCHES) -> DataFrame:
    """Every prefix of ``strings`` as a node: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    texts = stage(texts)
    trie = build(texts, batches)
    ends = texts.select(F.get("hs", F.col("n")).alias("ext"), "conv_id")
    links = ancestors(trie)
    kids = trie.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("ext")).agg(F.count(F.lit(1)).alias("kids"))
    own = ends.groupBy("ext").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("low"))
    nodes = stage(trie.join(kids, "ext", "left").join(own, "ext", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    values = nodes.select("ext", F.coalesce("n_convs", F.lit(0)).alias("n_convs"), "low", (F.col("kids") == 0).cast("long").alias("n_leaves"))
    total = summed(values, links, {"n_convs": F.sum, "low": F.min, "n_leaves": F.sum})
    nodes = stage(nodes.drop("n_convs", "low").join(total, "ext"))
    width = F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)
    saved = summed(nodes.select("ext", ((F.col("n_convs") - 1) * width).alias("saved")), links, {"saved": F.sum})
    nodes = nodes.join(saved, "ext").join(ends_hashes(ends), "ext", "left")
    above = total.select(F.col("ext").alias("up"), F.col("low").alias("up_low"))
    nodes = nodes.join(above, "up", "left")
    # the edges' depths; the root is a row of its own
    depth = F.explode(F.when(F.col("b") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("a") + 1, F.greatest("b", F.col("a") + 1)))).alias("depth")
    out = nodes.select("*", depth)
    before = F.aggregate(F.slice("sizes", 1, F.greatest(F.col("depth") - F.col("a") - 1, F.lit(0))), F.lit(0).cast("long"), lambda x, y: x + y)
    last = F.col("depth") == F.col("b")
    return out.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("a") + 1, F.col("up_low")).when(F.col("depth") > 0, F.col("low")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * before).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends_sha256")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
