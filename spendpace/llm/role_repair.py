"""Conversation structure repair: a generalised LR parser over the roles.

A conversation should read ``(s?(ua)+)?`` by its roles' initials: nothing, or
an optional system turn and then pairs of a user and an assistant turn. The
grammar is

    S -> (empty) | H T      H -> (empty) | s      T -> P | T P      P -> u a

Its LR tables are built here from the rules. The parser reads a conversation's
rows in order of turn with a graph-structured stack: a top is a table state, its
links lead to the tops below it, and reductions follow the links. Each row may
be kept (its initial is shifted), reroled to user or assistant, or deleted, and
empty user or assistant turns may be inserted before any row and at the end.
Every top carries the (cost, audit) of the cheapest way to it; equal stack tops
are merged by the smallest (cost, audit), so the stack never holds more than a
dozen of them. An audit is the edits' initials in order (Keep, Rerole, Delete,
Insert). No two ways of equal cost to the same row are prefixes of each other,
so the smallest (cost, audit) of a merged top stays smallest.

Faults, the first that holds: blank (no character but white space; must be
deleted), duplicate (a row of equal role and text came before; must be
deleted), truncated (the last character that is no white space is none of
``.!?``; keeping or reroling it costs 3 more).

Spark deals the rows by conversation and sorts them by turn, role and text (of
repeated turn numbers); each task streams its rows and holds one stack, not the
rows. What a conversation needs besides is its audit and a 16-byte digest for
each of its rows. The digest of the repaired text is a SHA-256 over one
conversation in order and hence is one task's work, whatever its length.
``edits`` gives the script as rows, and ``repaired`` joins it with the turns, so
the texts of a long conversation are spread over tasks again.

Defined results: a null role or text counts as one space (a null text is blank);
an empty role has no initial and fits nowhere (its row is reroled or deleted);
null turns come first and are left out of the gaps; rows of equal turn are
ordered by role and text; equal rows are duplicates of the first; a null
conv_id is a conversation of its own; a conversation without rows gets zeros, an
empty audit and the empty text's hash; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import pick, utf8

RULES = (("S", ""), ("S", "HT"), ("H", ""), ("H", "s"), ("T", "P"), ("T", "TP"), ("P", "ua"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What may be inserted or reroled to.
ROLES = {"u": b"user", "a": b"assistant"}
#: After so many rows, audits are cut and their heads are ranked once.
SETTLE = 512


def tables(rules=RULES, goal="S"):
    """LR(1) tables: shift[state][terminal] and goto[state][nonterminal] ->
    state, reduce[state][lookahead] -> [rule]; the lookahead "" is the end."""
    left = {r[0] for r in rules}

    def firsts(symbols, after):
        """Terminals that ``symbols`` followed by ``after`` can begin with."""
        out = set()
        for s in symbols:
            if s not in left:
                return out | {s}
            out |= begin[s] - {None}
            if None not in begin[s]:
                return out
        return out | {after}

    begin = {n: set() for n in left}
    while True:
        old = {n: set(b) for n, b in begin.items()}
        for n, body in rules:
            begin[n] |= firsts(body, None)
        if old == begin:
            break

    def closed(items):
        items, todo = set(items), list(items)
        while todo:
            n, body, dot, ahead = todo.pop()
            if dot < len(body) and body[dot] in left:
                for k, (m, b) in enumerate(rules):
                    if m == body[dot]:
                        for t in firsts(body[dot + 1:], ahead):
                            if (new := (k, b, 0, t)) not in items:
                                items.add(new)
                                todo.append(new)
        return frozenset(items)

    states = [closed({(-1, goal, 0, "")})]
    shift, goto, reduce = [], [], []
    for state in states:  # grows while it is read
        nexts = {}
        for n, body, dot, ahead in state:
            if dot < len(body):
                nexts.setdefault(body[dot], set()).add((n, body, dot + 1, ahead))
        to = {}
        for s in sorted(nexts):
            new = closed(nexts[s])
            if new not in states:
                states.append(new)
            to[s] = states.index(new)
        shift.append({s: t for s, t in to.items() if s not in left})
        goto.append({s: t for s, t in to.items() if s in left})
        done = {}
        for n, body, dot, ahead in sorted(state):
            if dot == len(body):
                done.setdefault(ahead, []).append(n)  # -1: accepted
        reduce.append(done)
    return shift, goto, reduce


class Way:
    """A way to a stack top: its cost, its audit (the rank of its head among
    the live heads, the head, the tail) and the digest of the repaired text."""

    __slots__ = ("cost", "rank", "tail", "head", "sha", "lines")

    def __init__(self, cost, rank, tail, head, sha, lines):
        self.cost, self.rank, self.tail, self.head, self.sha, self.lines = cost, rank, tail, head, sha, lines

    def key(self):
        return self.cost, self.rank, self.tail

    def then(self, cost, edit, line=None):
        """One more edit; ``line`` is the repaired turn it gives, if any."""
        sha = self.sha
        if line is not None:
            sha = sha.copy()
            sha.update(b"\n" + line if self.lines else line)
        return Way(self.cost + cost, self.rank, self.tail + edit, self.head, sha, self.lines or line is not None)

    def audit(self) -> str:
        parts, head = [self.tail], self.head
        while head:
            head, part = head
            parts.append(part)
        return "".join(reversed(parts))


class Top:
    """A stack top: its state, the tops below it, the cheapest way to it."""

    __slots__ = ("state", "below", "way")

    def __init__(self, state, below, way):
        self.state, self.below, self.way = state, below, way


class Parser:
    """The graph-structured stack of one conversation. A top's identity is its
    state and the states of what can lie below it, so equal tops merge."""

    SHIFT, GOTO, REDUCE = tables()

    def __init__(self):
        self.tops = {}
        self.rows = 0
        self._add(self.tops, Top(0, None, Way(0, 0, "", None, hashlib.sha256(), False)))

    @staticmethod
    def _name(top):
        """The states from the top down; the rules nest at most four deep
        (left recursion folds the pairs that are done)."""
        out = []
        while top is not None:
            out.append(top.state)
            top = top.below
        return tuple(out)

    def _add(self, tops, top) -> bool:
        """Merge into ``tops``; whether it is new or cheaper."""
        name = self._name(top)
        old = tops.get(name)
        if old is not None and old.way.key() <= top.way.key():
            return False
        tops[name] = top
        return True

    def _reduced(self, top, ahead):
        """Tops reached by reductions under the lookahead, itself included."""
        out, todo = [], [top]
        while todo:
            t = todo.pop()
            out.append(t)
            for rule in self.REDUCE[t.state].get(ahead, ()):
                if rule >= 0:
                    n, body = RULES[rule]
                    base = t
                    for _ in body:
                        base = base.below
                    todo.append(Top(self.GOTO[base.state][n], base, t.way))
        return out

    def _shifted(self, top, symbol, way):
        """Tops after shifting ``symbol``, by ``way``."""
        for t in self._reduced(top, symbol):
            to = self.SHIFT[t.state].get(symbol)
            if to is not None:
                yield Top(to, t, way)

    def _insert(self):
        """Empty turns inserted before the next row, as long as that is a new
        or a cheaper way to some top."""
        todo = list(self.tops.values())
        while todo:
            top = todo.pop()
            if self.tops.get(self._name(top)) is not top:
                continue
            for s, role in ROLES.items():
                way = None
                for new in self._shifted(top, s, None):
                    way = new.way = way or top.way.then(INSERT, "I", role + b":")
                    if self._add(self.tops, new):
                        todo.append(new)

    def row(self, role: bytes, text: bytes, gone: bool, truncated: bool):
        """Read one row; ``gone`` rows can only be deleted."""
        self._insert()
        after, more = {}, TRUNCATED if truncated else 0
        for top in self.tops.values():
            self._add(after, Top(top.state, top.below, top.way.then(DELETE, "D")))
            if gone:
                continue
            for edit, cost, s, name in (("K", KEEP, role[:1].decode("utf-8", "replace"), role), *(("R", REROLE, s, r) for s, r in ROLES.items())):
                way = None
                for new in self._shifted(top, s, None):
                    way = new.way = way or top.way.then(cost + more, edit, name + b":" + text)
                    self._add(after, new)
        self.tops = after
        self.rows += 1
        if self.rows % SETTLE == 0:
            # all audits end with a row's edit here, so none is a prefix of
            # another one and their order is final
            order = sorted({(t.way.rank, t.way.tail) for t in after.values()})
            ranks, heads = {k: i for i, k in enumerate(order)}, {}
            for t in after.values():
                w, k = t.way, (t.way.rank, t.way.tail)
                head = heads.setdefault(k, (w.head, w.tail))
                t.way = Way(w.cost, ranks[k], "", head, w.sha, w.lines)

    def finish(self) -> Way:
        """The cheapest way to an accepted conversation."""
        self._insert()
        ends = [t.way for top in self.tops.values() for t in self._reduced(top, "") if -1 in self.REDUCE[t.state].get("", ())]
        return min(ends, key=Way.key)


BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
_SPACE = b" \t\n\v\f\r"


class Conversation:
    """Counts and parser of one conversation, fed row by row."""

    def __init__(self):
        self.parser, self.seen, self.count = Parser(), set(), {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.low = self.high = self.last_turn = self.before = None
        self.turns = self.illegal = 0

    def row(self, turn, role: bytes, text: bytes):
        import xxhash

        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        initial = role.decode("utf-8", "replace")[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        solid, name = text.strip(_SPACE), xxhash.xxh3_128_digest(b"%d:" % len(role) + role + text)
        fault = BLANK if not solid else DUPLICATE if name in self.seen else CUT if solid[-1:] not in b".!?" else None
        self.seen.add(name)
        if fault:
            self.count[fault] += 1
        self.parser.row(role, text, fault in (BLANK, DUPLICATE), fault == CUT)

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a set damage, by crc32 of ``conv_id:turn`` modulo 20 (a
    null is one space): 0 drops the row (``turn``, ``role`` and ``text`` are
    null and ``gone`` is true, so that its conversation is still known), 1
    empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 sets the role
    user."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    rows = rows.withColumn("role", F.coalesce("role", space)).withColumn("text", F.coalesce("text", space))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("hit", F.crc32(key.cast("binary")) % 20)
    hit = F.col("hit")
    return rows.select(
        "conv_id", F.when(hit != 0, F.col("turn")).alias("turn"),
        F.when(hit == 4, F.lit("user")).when(hit != 0, F.col("role")).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate("text", ".!?", "")).when(hit != 0, F.col("text")).alias("text"),
        (hit == 0).alias("gone"), F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by conversation, in order. Rows may carry ``gone``: such a row only
    tells that its conversation exists."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", utf8(F.coalesce("role", F.lit(" "))).alias("role"), utf8(F.coalesce("text", F.lit(" "))).alias("text"), gone.alias("gone"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "gone", F.col("turn").asc_nulls_first(), "role", "text")


def _told(batches, names, kinds, tell):
    """Arrow batches of the records that ``tell`` yields for each conversation,
    given its id and its rows one by one. The first field is the id."""
    import pyarrow as pa

    id_kind = None

    def rows():
        nonlocal id_kind
        for b in batches:
            id_kind = b.column("conv_id").type
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")))

    records = (x for conv_id, part in itertools.groupby(rows(), lambda r: r[0]) for x in tell(conv_id, part))
    while some := list(itertools.islice(records, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), [id_kind, *kinds])], names)


def _parsed(part) -> Conversation:
    c = Conversation()
    for _, turn, role, text, gone in part:
        if not gone:
            c.row(turn, role, text)
    return c


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 of its repaired ``role:text`` lines."""
    import pyarrow as pa

    names = ["conv_id", "gaps", BLANK, DUPLICATE, CUT, "illegal", "cost", "audit", "repaired_sha256"]

    def tell(conv_id, part):
        c = _parsed(part)
        way = c.parser.finish()
        yield conv_id, c.gaps(), *c.count.values(), c.illegal, way.cost, way.audit(), way.sha.hexdigest()

    def run(batches):
        return _told(batches, names, [pa.int64()] * 6 + [pa.string()] * 2, tell)

    longs = ", ".join(f"{n} long" for n in names[1:7])
    return _dealt(rows).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {longs}, audit string, repaired_sha256 string")


def edits(rows: DataFrame) -> DataFrame:
    """The edits in order: conv_id, seq, edit, row (the place of the row it is
    done to, none for Insert), place (of the turn it gives, none for Delete),
    role (of a reroled or inserted turn)."""
    import pyarrow as pa

    names = ["conv_id", "seq", "edit", "row", "place", "role"]

    def tell(conv_id, part):
        audit = _parsed(part).parser.finish().audit()
        odd = (len(audit) - audit.count("D")) % 2  # then a system turn leads
        row = place = 0
        for seq, edit in enumerate(audit):
            role = (b"assistant" if (place - odd) % 2 else b"user").decode() if edit in "RI" else None
            yield conv_id, seq, edit, None if edit == "I" else row, None if edit == "D" else place, role
            row += edit != "I"
            place += edit != "D"

    def run(batches):
        return _told(batches, names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()], tell)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _dealt(rows).mapInArrow(run, f"conv_id {kind}, seq long, edit string, row long, place long, role string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, role, text, edit."""
    import pyarrow as pa

    names = ["conv_id", "row", "role", "text"]

    def tell(conv_id, part):
        for i, (_, _, role, text, gone) in enumerate(part):
            if not gone:
                yield conv_id, i, role.decode("utf-8", "replace"), text.decode("utf-8", "replace")

    def run(batches):
        return _told(batches, names, [pa.int64(), pa.string(), pa.string()], tell)

    kind = rows.schema["conv_id"].dataType.simpleString()
    numbered = _dealt(rows).mapInArrow(run, f"conv_id {kind}, row long, role string, text string")
    numbered = numbered.select(F.col("conv_id").alias("id"), F.col("row").alias("at"), F.col("role").alias("was"), "text")
    script = edits(rows).where(F.col("place").isNotNull())
    both = script.join(numbered, (F.col("row") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return both.select("conv_id", "place", F.coalesce("role", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
