"""Queries of the operators over the whole test tables, and their SQL."""

from __future__ import annotations

from spendpace.llm import (exact_dedup, html, line_dedup, lm, mixing, neighbours, packing, prefix_trie, quality, role_repair, secrets, simhash,
                           toxicity)
from spendpace.llm.common import table


def op1_html_extraction(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("whole", "part")


def op8_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark, sf_dir):
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op12_role_repair(spark, sf_dir):
    return role_repair.repair(role_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_prefix_trie(spark, sf_dir):
    turns = prefix_trie.rebuilt(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie_nodes(prefix_trie.strings(turns))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_lm_scoring, op3_exact_dedup, op4_quality_classifier, op5_simhash_near_dedup, op6_packing, op7_mixing,
    op8_secret_scan, op9_embedding_near_dedup, op10_toxicity, op11_line_dedup, op12_role_repair, op13_prefix_trie)}

#: A-Z lower-cased only, as the contract says.
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = f"list_transform(regexp_extract_all({text}, '.'), lambda z: CAST(unicode(z) AS BIGINT))"
    step = f"lambda r, z: list_reduce(range(8), lambda c, i: {bit}, xor(r, z))"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


ORACLE_SQL = {
    # a line's key, the documents that hold it, and the lines left
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40
                  GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) >= 5),
        m AS (SELECT k.*, often.key IS NOT NULL AND k.doc_id IS DISTINCT FROM often.top AS lost FROM k LEFT JOIN often ON k.key = often.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY r""",
    # the automaton of the role grammar with four states, row by row; a way into
    # a state is the edits before the row's own (insertions) and the row's own
    "op12_role_repair": f"""
        WITH RECURSIVE c AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit FROM conversations),
        w AS (
          SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM c, range(2) AS copy(i) WHERE hit <> 0 AND (i = 0 OR hit = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role COLLATE "C", text COLLATE "C") AS p FROM w),
        f AS (
          SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS j,
                 regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS nth FROM o),
        g AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
        fast(x, s, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins AS (
          SELECT x, x AS z, '' AS edits, '' AS gives FROM range(4) AS t(x)
          UNION ALL
          SELECT ins.x, fast.y, ins.edits || 'I', ins.gives || fast.s FROM ins JOIN fast ON fast.x = ins.z
          WHERE fast.s <> 's' AND len(ins.edits) < 3),
        step AS (
          SELECT g.conv_id, g.p, ins.x, ins.z AS y, ins.edits || 'D' AS edits, 3 * len(ins.edits) + 4 AS cost FROM g, ins
          UNION ALL
          SELECT g.conv_id, g.p, ins.x, fast.y, ins.edits || e.e,
                 3 * len(ins.edits) + CASE WHEN e.e = 'R' THEN 3 ELSE 0 END + CASE WHEN g.fault = 't' THEN 3 ELSE 0 END
          FROM g, ins, fast, (VALUES ('K'), ('R')) AS e(e)
          WHERE fast.x = ins.z AND g.fault NOT IN ('b', 'd') AND (e.e = 'K' AND fast.s = g.i OR e.e = 'R' AND fast.s <> 's')),
        best AS (SELECT conv_id, p, x, y, min(ROW(cost, edits)) AS b FROM step GROUP BY ALL),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        run AS (
          SELECT conv_id, 0 AS p, 0 AS x, CAST(0 AS BIGINT) AS cost, '' AS audit FROM ids
          UNION ALL
          SELECT conv_id, p, y, CAST(struct_extract(b, 1) AS BIGINT), struct_extract(b, 2) FROM (
            SELECT run.conv_id, best.p, best.y, min(ROW(run.cost + struct_extract(best.b, 1), run.audit || struct_extract(best.b, 2))) AS b
            FROM run JOIN best ON run.conv_id IS NOT DISTINCT FROM best.conv_id AND best.p = run.p + 1 AND best.x = run.x GROUP BY ALL)),
        fin AS (
          SELECT run.conv_id, min(ROW(cost + 3 * len(ins.edits), audit || ins.edits)) AS b
          FROM run JOIN ins ON ins.x = run.x AND ins.z IN (0, 3)
          WHERE run.p = (SELECT count(*) FROM g WHERE g.conv_id IS NOT DISTINCT FROM run.conv_id) GROUP BY ALL),
        a AS (SELECT conv_id, struct_extract(b, 1) AS cost, struct_extract(b, 2) AS audit FROM fin),
        q AS (
          SELECT conv_id, audit, n, e, (len(audit) - len(replace(audit, 'D', ''))) AS dels,
                 count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY n) AS p, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY n) AS place
          FROM (SELECT conv_id, audit, unnest(regexp_extract_all(audit, '.')) AS e, unnest(range(len(audit))) AS n FROM a)),
        lines AS (
          SELECT q.conv_id, q.place, CASE WHEN e = 'K' THEN g.role WHEN (place - (len(audit) - dels) % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
                 || ':' || CASE WHEN e = 'I' THEN '' ELSE g.text END AS line
          FROM q LEFT JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.p = g.p WHERE e <> 'D'),
        txt AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS h FROM lines GROUP BY conv_id),
        st AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                 count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                 count(*) FILTER (p > 1 AND j || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(a.cost AS BIGINT) AS cost, a.audit,
               coalesce(h, sha256('')) AS repaired_sha256
        FROM a LEFT JOIN st ON a.conv_id IS NOT DISTINCT FROM st.conv_id LEFT JOIN txt ON a.conv_id IS NOT DISTINCT FROM txt.conv_id""",
    # prefixes by themselves, no compaction: every node's subtree is the nodes
    # whose smallest member has it on its path
    "op13_prefix_trie": f"""
        WITH t AS (
          SELECT conv_id, list(ROW(coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST,
                   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
          FROM conversations GROUP BY conv_id),
        o AS (SELECT *, {_crc32("coalesce(CAST(conv_id AS VARCHAR), '')")} % 9 AS h FROM t),
        r AS (SELECT o.conv_id, coalesce(d.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns FROM o LEFT JOIN t AS d ON d.conv_id = o.conv_id - o.conv_id % 5),
        path AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS d, turns, len(turns) AS n FROM r),
        node AS (
          SELECT *, min(conv_id) OVER w AS rep, count(*) OVER w AS n_convs FROM path WINDOW w AS (PARTITION BY d, turns[1:d])),
        uniq AS (
          SELECT rep, d, any_value(n_convs) AS n_convs, any_value(strlen(struct_extract(turns[d], 2))) AS width,
                 string_agg(coalesce(CAST(conv_id AS VARCHAR), ''), ',' ORDER BY conv_id NULLS FIRST) FILTER (n = d) AS ends
          FROM node GROUP BY rep, d),
        up AS (SELECT u.*, p.rep AS parent FROM uniq AS u LEFT JOIN node AS p ON p.conv_id IS NOT DISTINCT FROM u.rep AND p.d = u.d - 1),
        kids AS (SELECT parent, d - 1 AS d, count(*) AS kids FROM up WHERE d > 0 GROUP BY ALL),
        full_node AS (SELECT up.*, coalesce(kids, 0) AS kids FROM up LEFT JOIN kids ON kids.parent IS NOT DISTINCT FROM up.rep AND kids.d = up.d),
        below AS (
          SELECT p.rep, p.d, sum(CASE WHEN m.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((m.n_convs - 1) * coalesce(m.width, 0)) AS saved
          FROM full_node AS m JOIN node AS p ON p.conv_id IS NOT DISTINCT FROM m.rep AND p.d <= m.d GROUP BY ALL)
        SELECT f.rep AS conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n_convs, f.kids AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM full_node AS f JOIN below AS b ON b.rep IS NOT DISTINCT FROM f.rep AND b.d = f.d""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w
                 AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
               sha256(t) AS text_sha256, CAST(1 AS INTEGER) AS link
        FROM d WINDOW w AS (PARTITION BY t)""",
    # the level is found by pouring again and again: sources above their cap
    # are fixed there and the rest is shared anew
    "op7_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS weight
              FROM d GROUP BY source),
        pour AS (
          SELECT 0 AS round, source, source_size, weight, false AS is_full,
                 sum(source_size) OVER () AS total FROM s
          UNION ALL
          SELECT round + 1, source, source_size, weight,
                 is_full OR 3 * source_size <= weight
                   * ((total - coalesce(sum(3 * source_size) FILTER (WHERE is_full) OVER (), 0)) * 1.0::DOUBLE
                      / sum(weight) FILTER (WHERE NOT is_full) OVER ()),
                 total
          FROM pour WHERE round < (SELECT count(*) FROM s)),
        last AS (SELECT * FROM pour WHERE round = (SELECT max(round) FROM pour)),
        goal AS (
          SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE weight
                 * (CAST(total - coalesce(sum(3 * source_size) FILTER (WHERE is_full) OVER (), 0) AS DOUBLE)
                    / sum(weight) FILTER (WHERE NOT is_full) OVER ()) END AS target FROM last),
        g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words,
                     CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole
              FROM goal),
        o AS (SELECT d.*, g.source_size, g.target, g.words, g.whole,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(whole * size + greatest(0, least(size, words - whole * source_size - before)) AS BIGINT) AS taken
        FROM o""",
}
