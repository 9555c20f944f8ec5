"""Learned operators: held-out accuracy, folds, odd rows; HTML and language model."""

from __future__ import annotations

import collections
import math
import zlib

import duckdb
import numpy as np
import pytest

from spendpace.llm import html, lm, quality, toxicity
from spendpace.llm.common import first_by_hash, table

ODD = [(1, None, "a"), (2, "", "a"), (3, "idiot " * 5, None), (3, "idiot " * 5, None), (None, "the of and", "b"), (4, "w\x85x\tY " * 40_000, "b")]
DOCS = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def sf(spark):
    return lambda name: table(spark, "/root/testdata/sf0.1", name)


def labels():
    con = duckdb.connect()
    return {r[0]: r[1:] for r in con.sql("select doc_id, quality, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall()}


def held_out_accuracy(rows, column, folds, held):
    known, hits = labels(), collections.Counter()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in known:
            hits[known[r["doc_id"]][column], r["predicted"]] += 1
    return hits


def test_toxicity_held_out(sf):
    hits = held_out_accuracy(toxicity.toxicity(sf("documents"), sf("labels")).collect(), 1, 3, 1)
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.85 and hits[0, 1] / (hits[0, 1] + hits[0, 0]) < 0.02


def test_quality_held_out(sf):
    hits = held_out_accuracy(quality.quality(sf("documents"), sf("labels")).collect(), 0, 4, 2)
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.95 and hits[0, 1] / (hits[0, 1] + hits[0, 0]) < 0.05


def test_pairs_carry_a_weight_of_their_own():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 2))
    docs = [np.flatnonzero(np.append(r, 1)).astype(np.uint32) for r in x]
    m = toxicity.train(docs, (x.sum(1) == 2).astype(float), bits=4, blank=0.0, min_z=0, epochs=60)
    raw = lambda *cols: toxicity._raw(m.bias, m.w, m.v, np.zeros(len(cols), int), np.array(cols, int), 1)[0][0]
    assert raw(m.index[0], m.index[1]) > 0 > max(raw(m.index[0]), raw(m.index[1]))


def test_non_negative_risk_finds_the_prior():
    rng = np.random.default_rng(1)
    d = quality.SHAPES + 48
    def make(n, side):
        z = np.zeros((n, d))
        z[:, 0] = rng.normal(2 if side else -2, 0.7, n)
        z[:, d - 5] = 1
        return z
    w, prior = quality.train(make(2000, True), np.concatenate([make(1200, True), make(800, False)]))
    assert 0.5 < prior < 0.7
    assert (make(500, True) @ w > 0).mean() > 0.97 > 0.03 > (make(500, False) @ w > 0).mean()


@pytest.mark.parametrize("score", [lambda d, x: toxicity.toxicity(d, x), lambda d, x: quality.quality(d, x)])
def test_odd_rows_and_no_labels(spark, score):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], DOCS)
    known = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, known).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert score(docs.limit(0), known.limit(0)).count() == 0


def test_bounded_sample_is_the_first_by_hash(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") > 4, F.col("id") % 9_000).alias("k"), "id")
    for n in (1, 50, 5_000):
        want = rows.orderBy(F.xxhash64("k"), "k", "id").limit(n).collect()
        assert first_by_hash(rows, n, "k", "id").collect() == want
    assert first_by_hash(rows.where("k is null"), 3, "k", "id").count() == 3 and first_by_hash(rows.limit(0), 3, "k").count() == 0


def test_clean_keeps_columns(spark, sf):
    docs = sf("documents")
    got = toxicity.clean(docs, sf("labels"))
    assert got.columns == docs.columns and 0.8 * 10_000 < got.count() < 10_000


def test_language_model_against_counts(spark):
    rows = ODD + [(10 + i, f"the cat {'sat' if i % 3 else 'ran'} on mat {i % 7} the end", "s") for i in range(60)]
    got = lm.score(spark.createDataFrame([(*r, "x") for r in rows], DOCS), block=150, slot=20).collect()
    toks = [((t or "").encode().lower().split() + [None], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, i) for i, t, _ in rows]
    c = collections.Counter(w for ws, held, _ in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for ws, held, i in toks)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    seen = [r for r in got if r["doc_id"] and r["doc_id"] >= 10]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_language_model_is_a_distribution():
    w = lm.em(np.array([[3, 0.5, 0.1, 0.01, 30], [3, 0.0, 0.1, 0.01, 20], [0, 0.0, 0.0, 0.01, 5]], float))
    assert np.allclose(w.sum(1), 1) and w[0, 2] > w[3, 2]


def test_language_model_empty(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0


PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header>'
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News today</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies, accept them all.</div>'
        '<article><h1>A &amp; B</h1><p>First <b>bold</b> paragraph,\n with   words.<p>Second one, &eacute;t&eacute; &#8364; <script>x("</p>")</script>ends here.'
        '<div class="ad">Buy now, great offers.</div><p>Third part of the story, after the advert.</p></article>'
        '<aside class="sidebar"><p>Related story, which is long enough to look like one.</p></aside>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I think this is wrong, sadly.</p></div></section>'
        '<form><label>Mail</label><input><button>Send</button></form><footer>&copy; site</footer></body></html>')


def test_html(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    odd = spark.createDataFrame([(-1, "u", PAGE), (-2, "u", None), (-3, None, ""), (-4, "u", "<<p<div>x"), (-5, "u", "<p>" * 5000 + "deep"),
                                 (-6, "u", PAGE.replace("<p>", "<p data-k=x data-k='c'>"))], pages.schema)
    got = {r["page_id"]: r for r in html.main_text(pages.unionByName(odd)).collect()}
    assert got[-1]["text"] == "A & B\nFirst bold paragraph, with words.\nSecond one, été € ends here.\nThird part of the story, after the advert."
    assert got[-6]["text"] == got[-1]["text"]  # pages may have an attribute of the training label's name
    assert got[-2]["text"] == got[-3]["text"] == "" and got[-2]["n_chars"] == 0
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        want = [b for b in (html._blank(html.re.sub(r"<[^>]*>", " ", x.replace("<b>", ""))) for x in html.re.split(r"</?p>|</?h1>", inner)) if b]
        assert got[r["page_id"]]["text"] == "\n".join(want) and got[r["page_id"]]["n_chars"] == len("\n".join(want))


def test_formulas_objects_and_noscript_keep_their_text():
    page = "<article><p>Let <math><mi>x</mi></math> be one.</p><object>A plan of it.</object><noscript>Without script.</noscript><math>y<p>The end.</p></article>"
    text = [n.text for n in html.parse(page) if n.text]
    assert html._blank(text[0]) == "Let x be one."
    assert {"A plan of it.", "Without script.", "The end."} <= {html._blank(t) for t in text}
    late = html.features(html.parse("<div><p>a</p><p>" + "long " * 60 + "\u00a9 site</p></div>"))
    early = html.features(html.parse("<div><p>a</p><p>" + "\u00a9 site " + "long " * 60 + "</p></div>"))
    assert (late[-1] == early[-1]).sum() >= late.shape[1] - 2 and late[:, -4].max() == early[:, -4].max() == 1


def test_decoding_agrees_with_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(200):
        nodes = [html.Node("div", -1 if i == 0 else int(rng.integers(0, i)), 0) for i in range(7)]
        logit = rng.normal(0, 2, 7)
        keep = html.decode(nodes, logit)
        ok = lambda s: s[0] and all(not s[i] or s[nodes[i].parent] for i in range(1, 7))
        best = max(logit[[i for i in range(7) if m >> i & 1]].sum() for m in range(128) if ok([m >> i & 1 for i in range(7)]))
        assert ok(keep) and logit[[i for i in range(7) if keep[i]]].sum() == pytest.approx(best)
