"""Near-duplicate vectors by NN-descent.

Vectors are compared only under equal labels (and equal length). Identical
vectors are one node with a count, so a vector that makes up a third of all
rows is compared once. Every node keeps a list of its nearest neighbours found
so far:

1. Start: each of ``trees`` random partitions (signs of random projections)
   orders the nodes; the order is cut by range over tasks, so a crowded cell
   spreads, and overlapping windows of it are compared directly. The rows at
   a cut are compared across it as well.
2. Descent: each node joins its neighbours and the nodes that list it, and
   compares them with each other; better ones replace the list's last. Rounds
   go on until at most one entry in a thousand changes. Entries of any
   similarity stay, so that a node without links has a way to others too.
3. Saturated lists: a list whose every entry is over the threshold has no room
   for the rest. It is enlarged to its node's whole linked set: the set is cut
   into tiles, and pairs of tiles are compared block by block, each node
   reporting a count. No pair is written out.
4. Audit: a sample of nodes is compared with all nodes; it grows until it
   holds ``LINKED`` nodes that have links. Every such node has a recall of its
   own, and what counts is the lowest mean over the nodes with about as many
   links (by powers of two), so large sets do not hide small ones. Under
   ``least_recall`` the search is repeated with doubled lists and partitions.
5. If two repeats do not reach it, or links are too rare for an audit (under
   ``LINKED`` nodes of ``MOST``), all pairs of equal label are compared tile by
   tile. This grows with the square of a label and is exact.

Only cosines of at least the threshold, in double precision, become links.
Tasks see windows, neighbour lists or pairs of tiles, all of bounded size.
``audit_recall`` is the audit's figure; 1 after the exact comparison.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components, and one without a label, links with nothing and is its
own component; rows that repeat an id are rows of their own, and a component's
id is the smallest id in it (null if it has none); an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace.llm.common import components, first_by_hash, pick, stage

THRESHOLD, LIST, TREES, WINDOW, TILE = 0.98, 8, 3, 512, 512
#: Nodes that the audit compares with all others: at first, and at most.
AUDIT, MOST = 1000, 16_000
#: Nodes with links that an audit needs, and that a size class needs to count.
LINKED, CLASS = 200, 30


def _unit(column) -> np.ndarray:
    """Vectors as rows of norm 1 in double precision; shorter ones end in
    zeros, which changes no cosine. Each is first divided by its largest
    component, so that no square overflows or vanishes."""
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    width = max(map(len, rows))
    x = np.array([r if len(r) == width else [*r, *[0.0] * (width - len(r))] for r in rows], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(near: np.ndarray) -> np.ndarray:
    """The smallest position among those linked with each one."""
    root = np.arange(len(near))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(near)).min(1))
        if (low == root).all():
            return root
        root = low


def nodes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: rid, label, dim, vec, n (copies), least (id)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    good = good.where(~bad).where(F.exists("embedding", lambda x: x != 0))
    one = good.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return one.select(F.monotonically_increasing_id().alias("rid"), "label", F.size("embedding").alias("dim"), F.col("embedding").alias("vec"), "n", "least")


def _by_dim(batch):
    """A batch's rows by vector length: (rows, unit vectors)."""
    dims = np.array(batch.column("dim").to_pylist())
    for d in np.unique(dims):
        at = np.nonzero(dims == d)[0]
        yield at, _unit(batch.column("vec").take(__import__("pyarrow").array(at)))


def start(all_nodes: DataFrame, threshold: float, k: int, trees: int, bits: int) -> DataFrame:
    """(u, v, cos) of close nodes in windows of random orders; rows with a null
    ``cos`` join linked nodes of a window."""
    import pyarrow as pa
    from pyspark import TaskContext

    label = all_nodes.schema["label"].dataType.simpleString()

    def orders(batches):
        for b in batches:
            for at, x in _by_dim(b):
                part = b.take(pa.array(at))
                for t in range(trees):
                    planes = np.random.default_rng([t, x.shape[1]]).normal(size=(x.shape[1], bits + 1))
                    y = x @ planes
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), part.column("label"), part.column("dim"), pa.array(code, pa.int64()),
                                                      pa.array(y[:, bits]), part.column("rid"), part.column("vec")],
                                                     ["tree", "label", "dim", "code", "at", "rid", "vec"])

    vec = all_nodes.schema["vec"].dataType.simpleString()
    order = ["tree", "label", "dim", "code", "at", "rid"]
    ordered = stage(all_nodes.mapInArrow(orders, f"tree int, label {label}, dim int, code long, at double, rid long, vec {vec}"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(rid, key, x):
        """Best neighbours within a window of one tree."""
        sim = x @ x.T
        sim[key[:, None] != key[None, :]] = -2
        np.fill_diagonal(sim, -2)
        u, v, c = [], [], []
        near = sim >= threshold
        if near.any():
            root = _linked(near)
            own = root != np.arange(len(x))
            u, v, c = [rid[own]], [rid[root[own]]], [np.full(own.sum(), np.nan)]
        top = np.argpartition(-sim, min(k, len(x) - 1), axis=1)[:, :k]
        row = np.repeat(np.arange(len(x)), top.shape[1])
        col = top.ravel()
        good = sim[row, col] > -1.5
        return u + [rid[row[good]]], v + [rid[col[good]]], c + [sim[row[good], col[good]]]

    half, place = WINDOW // 2, ["tree", "label", "dim", "rid", "vec"]

    def whole(schema, n, cols):
        kinds = {"u": pa.int64(), "v": pa.int64(), "cos": pa.float64(), "part": pa.int64(), "tail": pa.bool_(), **{c: schema.field(c).type for c in place}}
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    def windows(batches):
        part, held, head = TaskContext.get().partitionId(), None, None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            if head is None or head.num_rows < half:  # no row was let go yet
                head = t.slice(0, half)
            at = 0
            while t.num_rows - at >= WINDOW:
                for c in out(t.slice(at, WINDOW)):
                    yield whole(t.schema, c.num_rows, {n: c.column(n) for n in c.schema.names})
                at += half
            held = t.slice(at)  # half a window at least, if one was compared
        if held is None:
            return
        for c in out(held):
            yield whole(held.schema, c.num_rows, {n: c.column(n) for n in c.schema.names})
        for t, tail in ((head, False), (held.slice(max(0, held.num_rows - half)), True)):
            for c in t.combine_chunks().to_batches():
                sides = {"part": pa.array(np.full(c.num_rows, part), pa.int64()), "tail": pa.array(np.full(c.num_rows, tail), pa.bool_())}
                yield whole(t.schema, c.num_rows, sides | {n: c.column(n) for n in place})

    def across(t):
        none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["u", "v", "cos"])
        return pa.Table.from_batches([none, *out(t)])

    def out(t):
        keys = list(zip(*(t.column(c).to_pylist() for c in ("tree", "label", "dim"))))
        dims, rid = np.array([x[2] for x in keys]), np.array(t.column("rid").to_pylist(), np.int64)
        names = {x: i for i, x in enumerate(dict.fromkeys(keys))}
        key = np.array([names[x] for x in keys])
        for d in np.unique(dims):
            at = np.nonzero(dims == d)[0]
            if len(at) < 2:
                continue
            u, v, c = compare(rid[at], key[at], _unit(t.column("vec").take(pa.array(at)).combine_chunks()))
            u, v, c = (np.concatenate(z) for z in (u, v, c))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(c, from_pandas=True)], ["u", "v", "cos"])

    found = stage(ordered.mapInArrow(windows, f"u long, v long, cos double, part long, tail boolean, tree int, label {label}, dim int, rid long, vec {vec}"))
    # the last rows of a task beside the first of the next one that has any
    ends = found.where("part is not null").select("part", "tail", *place)
    cuts = ends.select("part").distinct().withColumn("before", F.lag("part").over(Window.orderBy("part")))
    ends = ends.join(cuts, "part").withColumn("cut", F.when(F.col("tail"), F.col("part")).otherwise(F.col("before"))).where("cut is not null")
    over = stage(ends.select("cut", *place).groupBy("cut").applyInArrow(across, "u long, v long, cos double"))
    return found.where("part is null").select("u", "v", "cos").unionByName(over)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries of each list, with the list's worst cosine."""
    once = pairs.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return once.withColumn("nth", nth).where(F.col("nth") <= k).select("u", "v", "cos")


def descend(graph: DataFrame, all_nodes: DataFrame, k: int) -> DataFrame:
    """One round: candidate entries (u, v, cos) among the neighbours of each
    node's neighbours, and links between them."""
    import pandas as pd

    back = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    reverse = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos").withColumn("nth", back).where(F.col("nth") <= k)
    around = graph.select("u", "v").unionByName(reverse.select("u", "v")).distinct()
    around = around.unionByName(around.select("u", F.col("u").alias("v")).distinct())
    members = around.join(all_nodes.select(F.col("rid").alias("v"), "vec"), "v")
    total = stage(graph.groupBy("u").agg(F.count(F.lit(1)).alias("size"))).count()
    bundle = F.pmod(F.xxhash64("u"), F.lit(max(1, total // 512))).alias("bundle")

    def local(pdf):
        pdf = pdf.sort_values(["u", "v"])
        centre, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        x = _unit(pdf["vec"])
        ends = np.append(np.nonzero(centre[1:] != centre[:-1])[0] + 1, len(centre))
        a, b, c, at = [], [], [], 0
        for end in ends:
            sim = x[at:end] @ x[at:end].T
            np.fill_diagonal(sim, -2)
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(end - at), top.shape[1])
            col = top.ravel()
            good = row != col
            a.append(v[at + row[good]])
            b.append(v[at + col[good]])
            c.append(sim[row[good], col[good]])
            at = end
        return pd.DataFrame({"u": np.concatenate(a), "v": np.concatenate(b), "cos": np.concatenate(c)})

    return members.select(bundle, "u", "v", "vec").groupBy("bundle").applyInPandas(local, "u long, v long, cos double")


def tiled(all_nodes: DataFrame, roots: DataFrame, threshold: float, joins: bool = False) -> DataFrame:
    """All pairs of the nodes of a set (node, root) compared tile by tile:
    (rid, links, other) with the rows linked to a node in one pair of tiles;
    with ``joins`` also rows with ``other``, which join a pair's linked nodes."""
    import pandas as pd

    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    placed = roots.join(sizes, "root").select("root", F.col("node").alias("rid"), "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    paired = placed.select("root", "rid", "tile", other).select("root", "rid", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    paired = stage(paired)
    bundle = F.pmod(F.xxhash64("root", "a", "b"), F.lit(max(1, paired.count() // 4096))).alias("bundle")
    rows = paired.select(bundle, "*").join(all_nodes.select("rid", "vec", "n"), "rid")

    def tiles(pdf):
        rid, links, one_end, other_end = [], [], [], []
        for (_, a, b), g in pdf.groupby(["root", "a", "b"]):
            x, n, tile, r = _unit(g["vec"]), g["n"].to_numpy(), g["tile"].to_numpy(), g["rid"].to_numpy()
            one, two = np.nonzero(tile == a)[0], np.nonzero(tile == b)[0]
            near = x[one] @ x[two].T >= threshold
            if a == b:
                np.fill_diagonal(near, False)
            else:
                rid.append(r[two])
                links.append(n[one] @ near)
            rid.append(r[one])
            links.append(near @ n[two])
            if joins and near.any():
                square = np.zeros((len(r), len(r)), bool)
                square[np.ix_(one, two)] = near
                root = _linked(square | square.T)
                own = root != np.arange(len(r))
                one_end.append(r[own])
                other_end.append(r[root[own]])
        more = sum(map(len, one_end))
        return pd.DataFrame({"rid": np.concatenate(rid + one_end), "links": np.concatenate(links + [np.zeros(more, np.int64)]),
                             "other": pd.array(np.concatenate([np.full(sum(map(len, rid)), -1), *other_end]), "Int64")})

    return rows.groupBy("bundle").applyInPandas(tiles, "rid long, links long, other long")


def counted(all_nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rid, links): rows linked to a node among its linked set's other nodes."""
    return tiled(all_nodes, roots, threshold).groupBy("rid").agg(F.sum("links").alias("links"))


def exact(all_nodes: DataFrame, threshold: float):
    """(roots, counts) of all pairs of equal label and length."""
    sets = all_nodes.groupBy("label", "dim").agg(F.min("rid").alias("root"))
    pairs = stage(tiled(all_nodes, all_nodes.join(sets, ["label", "dim"]).select(F.col("rid").alias("node"), "root"), threshold, joins=True))
    edges = pairs.where("other >= 0").select(F.col("rid").alias("u"), F.col("other").alias("v"))
    return stage(components(edges)), stage(pairs.groupBy("rid").agg(F.sum("links").alias("links")))


def recall(all_nodes: DataFrame, found: DataFrame, threshold: float, queries: int, most: int = MOST, enough: int = LINKED) -> float | None:
    """Mean recall of the sampled nodes that have links, where it is lowest
    among nodes with about as many; ``found`` is (rid, links). None if ``most``
    nodes hold too few with links to tell."""
    import pyarrow as pa

    def compared(asked):
        groups = {}
        for r in asked:
            groups.setdefault((r["label"], r["dim"]), []).append(r)
        packed = {key: (np.array([r["rid"] for r in rs]), _unit([r["vec"] for r in rs])) for key, rs in groups.items()}

        def run(batches):
            for b in batches:
                labels = np.array(b.column("label").to_pylist(), object)
                n = np.array(b.column("n").to_pylist())
                rid = np.array(b.column("rid").to_pylist())
                for at, x in _by_dim(b):
                    for key, (ids, q) in packed.items():
                        some = np.array([i for i, j in enumerate(at) if labels[j] == key[0]], np.int64)
                        if key[1] != x.shape[1] or not len(some):
                            continue
                        sums = np.zeros(len(ids), np.int64)
                        for i in range(0, len(some), 1024):
                            few = some[i:i + 1024]
                            near = q @ x[few].T >= threshold
                            near &= ids[:, None] != rid[at[few]][None, :]
                            sums += near @ n[at[few]]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())], ["rid", "links"])

        return all_nodes.mapInArrow(run, "rid long, links long").groupBy("rid").agg(F.sum("links").alias("true"))

    while True:
        asked = first_by_hash(all_nodes, queries, "rid").select("rid", "label", "dim", "vec").collect()
        true = stage(compared(asked).where(F.col("true") > 0))
        linked = true.count()
        if linked >= enough or len(asked) < queries:
            break
        if queries >= most:
            return None
        queries = min(most, 4 * queries)
    own = F.coalesce("links", F.lit(0)) / F.col("true")
    sizes = true.join(found, "rid", "left").groupBy(F.floor(F.log2(F.col("true"))).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("share")).collect()
    means = [sum(r["share"] for r in sizes) / linked] if linked else [1.0]
    return min(means + [r["share"] / r["n"] for r in sizes if r["n"] >= CLASS])


def search(all_nodes: DataFrame, threshold: float, k: int, trees: int):
    """(roots, counts) of one whole search."""
    largest = all_nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (largest // WINDOW).bit_length())
    first = start(all_nodes, threshold, k, trees, bits)
    graph = stage(_best(first.where("cos is not null"), k))
    joined = [first.where("cos is null").select("u", "v")]
    while True:
        found = stage(descend(graph, all_nodes, k))
        joined.append(found.where(F.col("cos") >= threshold).select("u", "v"))
        better = stage(_best(graph.unionByName(found), k))
        changed, size = better.join(graph, ["u", "v"], "left_anti").count(), better.count()
        graph = better
        if changed <= 0.001 * size:  # ends: lists only get better
            break
    joined.append(graph.where(F.col("cos") >= threshold).select("u", "v"))
    edges = joined[0]
    for e in joined[1:]:
        edges = edges.unionByName(e)
    roots = stage(components(edges))
    return roots, stage(counted(all_nodes, roots, threshold))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = LIST, trees: int = TREES,
                    least_recall: float = 0.95, audit: int = AUDIT) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall."""
    rows = pick(vectors, "vec_id", "embedding", "label")
    all_nodes = stage(nodes(rows))
    for _ in range(3):
        roots, counts = search(all_nodes, threshold, k, trees)
        share = recall(all_nodes, counts, threshold, audit)
        if share is None or share >= least_recall:
            break
        k, trees = 2 * k, 2 * trees
    if share is None or share < least_recall:
        (roots, counts), share = exact(all_nodes, threshold), 1.0
    at = all_nodes.join(roots, all_nodes["rid"] == roots["node"], "left").select("rid", "least", F.coalesce("root", "rid").alias("root"))
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    of = at.join(least, "root").join(counts, "rid", "left").select("rid", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    of = stage(of.join(all_nodes.select("rid", "label", "vec", "n"), "rid").select(
        F.col("label").alias("l"), "vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable")))
    # a row finds its node by the vector itself
    out = rows.join(of, (F.xxhash64("embedding") == F.xxhash64("vec")) & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("vec")), "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(float(share)).alias("audit_recall"))
