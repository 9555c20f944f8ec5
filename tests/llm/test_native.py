"""Exact dedup and mixing against plain Python and their SQL."""

from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import pytest

from spendpace.llm import exact_dedup, mixing
from spendpace.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, Size string"


def frame(spark, rows):
    """(doc_id, text, source) rows with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows],
                                 SCHEMA.replace("Size", "size"))


ODD = [(1, "Hello World", "a"), (2, "hello world", "b"), (3, None, "a"), (4, "", None), (5, "hello  world", "a"), (2, "hello world", "b"),
       (6, "É", "a"), (7, "é", "b"), (None, "hello world", "a"), (None, None, None), (8, "x " * 30_000, "b"), (9, "X " * 30_000, "b")]


def expected_duplicates(rows):
    groups = collections.defaultdict(list)
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen = seen or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_keys", [2, 65_536])
def test_duplicates(spark, bucket_keys):
    rng = random.Random(1)
    rows = ODD + [(100 + i, f"text {rng.randint(0, 40)}", "c") for i in range(200)]
    got = exact_dedup.duplicates(frame(spark, rows), bucket_keys).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected_duplicates(rows)


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(5000).selectExpr("shiftrightunsigned(xxhash64(id), if(id % 2 = 0, 8, 0)) as hash")
    got = exact_dedup.directory(keys, 100).collect()
    assert sum(r["n_keys"] for r in got) == 5000 and max(r["n_keys"] for r in got) <= 100 and len({r["depth"] for r in got}) > 1


def test_keep_one(spark):
    df = frame(spark, ODD)
    got = exact_dedup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]) for r in got.collect())) == sorted(["2", "4", "5", "6", "7", "9"])
    assert exact_dedup.keep_one(df.limit(0)).count() == 0


def expected_targets(sizes):
    """Pour, fix what is above its cap, pour the rest again."""
    total, w = sum(sizes.values()), {}
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        w[s] = i % 3 + 1
    full = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weight = sum(w[s] for s in sizes if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else w[s] * rest / weight for s in sizes}
        over = {s for s in sizes if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix(spark):
    rng = random.Random(2)
    rows = ODD + [(1000 + i, "w " * rng.randint(0, 30), rng.choice(["big"] * 30 + ["tiny", "mid", "mid", None, "é"])) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = expected_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert taken == collections.Counter({(sizes[s], round(want[s], 6)): int(want[s] + 0.5) for s in sizes})
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows[::-1])).collect()))
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " a\tb  c d" * (i % 5), "s1" if i % 4 else "s2") for i in range(40)]
    df = frame(spark, rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got, texts = out.collect(), {i: t for i, t, _ in rows}
    words = collections.Counter()
    for r in got:
        words[r["doc_id"]] += len(r["text"].split())
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert words == +collections.Counter({r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()})


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
