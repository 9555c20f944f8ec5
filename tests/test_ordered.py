"""Positions and running sums over ranges against a plain loop."""

import random

from pyspark.sql import functions as F

from spendpace.operators.ordered import running

COLUMNS = "budget_id int, place int, label string, cost decimal(18,4)"


def _rows(n, seed):
    r = random.Random(seed)
    # budget 0 holds most rows; places tie
    return [(0 if r.random() < 0.8 else r.randrange(1, 4), r.randrange(n // 4), f"x{i:05d}", r.randrange(0, 50) / 4) for i in range(n)]


def _plain(rows):
    out, state = {}, {}
    for b, place, label, cost in sorted(rows, key=lambda x: (x[0], -x[1], x[2])):
        pos, total = state.get(b, (0, 0.0))
        out[label] = (pos + 1, total)
        state[b] = (pos + 1, total + cost)
    return out


def test_several_ranges_equal_a_loop(spark):
    rows = _rows(4000, 5)
    df = spark.createDataFrame(rows, COLUMNS.replace("decimal(18,4)", "double")).withColumn("cost", F.col("cost").cast("decimal(18,4)"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("place").desc(), F.col("label")]
        got = running(df, ["budget_id"], order, "pos", {"spent": F.col("cost")})
        plain = _plain(rows)
        assert {r.label: (r.pos, float(r.spent)) for r in got.collect()} == plain
        # a stop drops whole ranges only, and no row from before it
        some = running(df, ["budget_id"], order, "pos", {"spent": F.col("cost")}, stop=F.col("spent") >= 1000).collect()
        found = {r.label: (r.pos, float(r.spent)) for r in some}
        assert all(plain[k] == v for k, v in found.items())
        assert {k for k, v in plain.items() if v[1] < 1000} <= set(found)
        assert len(found) < len(plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    got = running(spark.createDataFrame([], COLUMNS), ["budget_id"], [F.col("place")], "pos", {"spent": F.col("cost")})
    assert got.columns == ["budget_id", "place", "label", "cost", "pos", "spent"] and got.count() == 0
