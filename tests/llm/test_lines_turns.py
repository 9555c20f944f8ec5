"""Line dedup, role repair and the prefix trie against plain Python and SQL."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from spendpace.llm import line_dedup, prefix_trie, role_repair
from spendpace.llm.common import stage
from spendpace.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- line dedup ----------------------------------------------------------

def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_lines(rows):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in top or top[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(4)
    common = ["A line that very many of the documents hold, number %d" % k for k in range(12)]
    wide = "é" * 39, "é" * 40, "x" * 39, " \t" + "x" * 40 + "\v\r"
    rows = [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "\n".join(wide * 2)), (None, common[0] + "\nown"), (None, common[0].upper())]
    rows += [(-10 - k, "\n".join(wide)) for k in range(6)]
    for i in range(300):
        lines = [rng.choice(common[:1] * 20 + common) if rng.random() < 0.5 else f"only in {i} " + "w" * rng.randint(0, 60) for _ in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(rng.choice([x, x, "  " + x, x.upper()]) for x in lines)))
    rows += [rows[20], rows[21], (7, common[1]), (1000, (common[2] + "\n") * 5000 + "end")]
    rows += [(2000 + k, "held by four documents only, so that it stays there") for k in range(4)]
    return rows


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, Text_Hash string, h1 int")


@pytest.mark.parametrize("partitions", [1, 23])
def test_lines(spark, partitions):
    rows = line_rows()
    want = plain_lines(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = line_dedup.digests(doc_frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, n, d, sha(t))) for i, n, d, t in want)


def test_kept_lines(spark):
    rows = line_rows()
    df = doc_frame(spark, rows)
    out = line_dedup.kept_lines(df)
    assert out.columns == df.columns
    want = [(i, t if not d else kept) for (i, t), (_, _, d, kept) in zip(rows, plain_lines(rows))]
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(map(str, want))
    assert line_dedup.digests(df.limit(0)).count() == 0 and line_dedup.kept_lines(df.limit(0)).count() == 0


def test_runs_over_many_batches(spark):
    """One line of all documents, in batches of a few rows."""
    rows = [(i, "the one line that all of these documents hold " + str(i % 2)) for i in range(60)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = line_dedup.drops(stage(line_dedup.occurrences(doc_frame(spark, rows)))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r["doc_id"] for r in got) == list(range(58))


# ---- role repair ---------------------------------------------------------

def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for part in out.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def fault(rows, i):
    _, role, text = rows[i]
    if not text.strip(SPACE):
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "truncated" if text.strip(SPACE)[-1] not in ".!?" else ""


def good(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or rest != "" and rest == "ua" * (len(rest) // 2)


def plain_repair(rows):
    """Tries every script whose cost is at most that of deleting everything."""
    faults = [fault(rows, i) for i in range(len(rows))]
    best = (4 * len(rows), "D" * len(rows), [])
    todo = [(0, "", [], 0)]
    while todo:
        cost, audit, out, i = todo.pop()
        if cost > best[0]:
            continue
        if i == len(rows) and good("".join(r[:1] or "?" for r, _ in out)) and (cost, audit) < best[:2]:
            best = (cost, audit, out)
        for role in ("user", "assistant"):
            todo.append((cost + 3, audit + "I", out + [(role, "")], i))
        if i < len(rows):
            more, (_, role, text) = 3 * (faults[i] == "truncated"), rows[i]
            todo.append((cost + 4, audit + "D", out, i + 1))
            if faults[i] in ("", "truncated"):
                todo.append((cost + more, audit + "K", out + [(role, text)], i + 1))
                todo += [(cost + 3 + more, audit + "R", out + [(r, text)], i + 1) for r in ("user", "assistant")]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best[:2], sha("\n".join(f"{r}:{t}" for r, t in best[2]))), best[2]


def turn_rows(n, seed=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = None if c == 0 else c
        for t in range(rng.randint(1, 5)):
            turn = rng.choice([t, t, t, t, t + 3, None, 1])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "éa"])
            text = rng.choice(["Yes.", "No", "Why? ", " \t", "", None, "é!\n", "x" * 3000 + "."])
            rows.append((conv, turn, role, text))
        if rng.random() < 0.3:
            rows.append(rows[-1])
    return rows


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, gone int, Role string".replace("Role", "hit"))


def test_repair(spark):
    rows = turn_rows(150)
    want = plain_damage(rows)
    damaged = role_repair.damaged(turn_frame(spark, rows))
    got = {r["conv_id"]: tuple(r)[1:] for r in role_repair.repair(damaged).collect()}
    plain = {c: plain_repair(x) for c, x in want.items()}
    assert got == {c: p[0] for c, p in plain.items()}
    assert any(not x for x in want.values())  # a conversation without rows
    turns = collections.defaultdict(list)
    for r in role_repair.repaired(damaged).orderBy("conv_id", "place").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: turns.get(c, []) for c in plain} == {c: p[1] for c, p in plain.items()}
    empty = role_repair.damaged(turn_frame(spark, rows).limit(0))
    assert role_repair.repair(empty).count() == 0 and role_repair.repaired(empty).count() == 0


def test_long_conversations_settle_their_audits(monkeypatch):
    """Heads cut every few rows give the audits that whole strings give."""
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice([b"user", b"assistant", b"system", b"x"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 40))]
        told = []
        for settle in (3, 10 ** 9):
            monkeypatch.setattr(role_repair, "SETTLE", settle)
            p = role_repair.Parser()
            for i, (role, gone, cut) in enumerate(rows):
                p.row(role, b"text %d" % i, gone, cut)
            way = p.finish()
            told.append((way.cost, way.audit(), way.sha.hexdigest()))
        assert told[0] == told[1]
        assert len(p.tops) <= 12


def test_tables_accept_the_grammar():
    p = role_repair.Parser
    for word in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(7))):
        tops = [role_repair.Top(0, None, None)]
        for s in word:
            tops = [x for t in tops for x in p._shifted(p(), t, s, None)]
        accepted = any(-1 in p.REDUCE[x.state].get("", ()) for t in tops for x in p._reduced(p(), t, ""))
        assert accepted == good(word), word


# ---- prefix trie ---------------------------------------------------------

def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        r, t = role or "", text or ""
        convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest(), r, t))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 9
        donor = turns.get(c - c % 5, []) if c is not None else []
        built[c] = donor[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    low = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted((c for c in m if len(built[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        out.append((low[p], len(p), low[p[:-1]] if p else None, len(m), len(kids), leaves, saved, sha(",".join("" if c is None else str(c) for c in ends))))
    return sorted(map(str, out))


def trie_rows(n, seed=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        k = rng.choice([1, 2, 3, 5, 9, 14])
        for t in range(k):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "a", "a", "é", "bb", ""])))
    rows += [(None, 0, None, None), (None, 0, None, None), (None, None, "user", "a"), (n + 7, None, "user", None), (n + 7, 3, "user", "z" * 5000)]
    rows += [(n + 20 + k, t, "user", "same") for k in range(30) for t in range(12)]  # one string, many conversations
    rows += [(n + 100, t, "user", f"{t}") for t in range(60)] + [(n + 101, t, "user", f"{t}") for t in range(47)]
    return rows


@pytest.mark.parametrize("batches", [prefix_trie.BATCHES, (1,), (40, 20, 10, 4, 2, 1)])
def test_trie(spark, batches):
    rows = trie_rows(70)
    turns = prefix_trie.rebuilt(prefix_trie.ordered_turns(turn_frame(spark, rows)))
    got = prefix_trie.trie_nodes(prefix_trie.strings(turns), batches).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    turns = prefix_trie.rebuilt(prefix_trie.ordered_turns(turn_frame(spark, trie_rows(1)).limit(0)))
    assert prefix_trie.trie_nodes(prefix_trie.strings(turns)).count() == 0


def test_handles_are_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for a, b, f in df.select("a", "b", prefix_trie.fattest(df["a"], df["b"])).collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_hashes_of_members_in_pieces(spark):
    """Nodes that reach over tasks, and one with many members."""
    rows = [(bytes([k % 7]) * 16, i) for i, k in enumerate([3] * 4000 + list(range(200)))]
    ends = spark.createDataFrame([(bytearray(e), i) for e, i in rows], "ext binary, conv_id long")
    got = {bytes(r["ext"]): r["ends_sha256"] for r in prefix_trie.ends_hashes(ends).collect()}
    want = collections.defaultdict(list)
    for e, i in rows:
        want[e].append(str(i))
    assert got == {e: sha(",".join(v)) for e, v in want.items()}


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_role_repair", "op13_prefix_trie"])
def test_sql_of_odd_rows(spark, name, tmp_path):
    """The twins on rows with nulls, repeated rows and repeated ids."""
    doc_frame(spark, line_rows()).drop("Text_Hash", "h1").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turn_rows(60) + trie_rows(30)[-40:], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(map(str, want.fetchall()))
