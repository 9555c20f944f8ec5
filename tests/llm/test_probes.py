"""Cases that earlier versions got wrong, at production settings."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest

from spendpace.llm import html, neighbours, packing, quality, toxicity
from spendpace.llm.common import table


def sentences(rng, n):
    words = "the of river stone light moved under old trees and water fell while people walked home again".split()
    return " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))


# ---- HTML ----------------------------------------------------------------

@pytest.mark.parametrize("page, want", [
    ('<p class="foo>Hello</p>', ["Hello"]), ("<p title=it's>Hello", ["Hello"]), ("<p title='a>b'>Hello</p>", ["Hello"]),
    ('<p title="a > b" class=x>One</p><p>Two</p>', ["One", "Two"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("<p>end <b", ["end <b"]),
    ("<p>a<svg>drawing</svg>b</p>", ["ab"]), ("<p>a<svg>b</p><p>c", ["ab", "c"]), ("<title>t<p>c", ["t", "c"]), ("<textarea>t<p>c", ["t", "c"]),
    ("<p>a</p><script>x = '<p>'", ["a"]), ("<p>a<!-- gone </p><p>b", ["a"]), ("<p>a<!-- b --><p>c", ["a", "c"]), ("<br/><p/>x", ["x"])])
def test_tags_by_the_rules_of_html(page, want):
    assert [n.text for n in html.parse(page) if n.text] == want


@pytest.mark.parametrize("piece", ["<a ", "<a x='", '<a x="', "<svg>", "<a b='>' ", "<!-- ", "<p " + "a" * 50, "<" + "p" * 40, "<title>", "</"])
def test_scanning_is_linear(piece):
    def took(n):
        t = time.process_time()
        html.parse(piece * (n // len(piece)))
        return time.process_time() - t

    took(1000)
    assert took(400_000) < 12 * took(50_000) + 0.5


def test_pages_without_an_article_element(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        text = [sentences(rng, 3) for _ in range(rng.randint(2, 6))]
        menu = "".join(f"<a href=/{k}>menu{k}</a> " for k in range(6))
        rows.append((i, "u", f"<html><body><div class=nav>{menu}</div><div class=content>{''.join(f'<p>{t}</p>' for t in text)}</div>"
                             f"<div class=footer>foot note {i}</div></body></html>"))
        want[i] = "\n".join(text)
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_a_table_of_one_very_long_page(spark):
    rng = random.Random(4)
    text = [sentences(rng, 40) for _ in range(120)]
    page = (f"<nav><ul><li><a href=/>menu</a></li><li><a href=/b>more menu</a></li></ul></nav><article>{''.join(f'<p>{t}</p>' for t in text)}</article>"
            "<footer><p>foot note</p></footer>")
    assert len(page) > 200_000
    [row] = html.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert row["text"] == "\n".join(text)


# ---- toxicity --------------------------------------------------------------

def paired(n, seed, kinds=4):
    """Documents whose label depends on a pair of words; each word by itself is
    as frequent in either class."""
    rng = np.random.default_rng(seed)
    docs, y = [], []
    for _ in range(n):
        i, j = rng.integers(0, kinds, 2)
        docs.append(" ".join([f"insult{i}q", f"group{j}q", *(f"filler{t}q" for t in rng.integers(0, 400, 20))]).encode())
        y.append(float((i + j) % 2 == 0))
    return docs, np.array(y)


@pytest.mark.parametrize("n", [400, 4000])
def test_pairs_alone_decide(n):
    # distinct words in full: equal stems would merge them
    docs, y = paired(n, 1)
    hashed = [np.array(sorted({h for t in toxicity.words(d) for h in toxicity.hashes(t, 24)}), np.uint32) for d in docs]
    machine = toxicity.train(hashed, y)
    more, truth = paired(2000, 2)
    assert ((machine.score(more) >= 0.5) == (truth > 0)).mean() > 0.9


def test_few_labels_still_tell_documents_apart(spark):
    sf = "/root/testdata/sf0.001"
    got = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    assert len({r["score"] for r in got}) > 3


# ---- others ----------------------------------------------------------------

def test_quality_labels_with_a_clashing_column(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2, 1, "x") for i in range(30)], "doc_id long, quality int, toxic int, QUALITY string")
    assert quality.quality(docs, known).count() == 30


def test_vectors_of_extreme_length_link(spark):
    base = np.array([0.3, -0.8, 0.52])
    rows = [(i, (base * s + 1e-4 * i * s).tolist(), 1) for i, s in enumerate([1.0, 1e200, 1e-200, 1e307, 1e-300, 5.0])]
    rows += [(10, [1e-200, 1e200, 0.0], 1), (11, [0.0, 1e300, 1e-300], 1)]
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i]["n_links"] for i in range(6)] == [5] * 6 and {got[i]["component_id"] for i in range(6)} == {0}
    assert got[10]["n_links"] == got[11]["n_links"] == 1 and got[11]["component_id"] == 10


def test_the_special_token_in_a_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> hi", "a<|endoftext|>", "a <|endoftext|><|endoftext|>  b\n", "<|endoftext", "x <|endoftext|> y z" * 3]
    encode = packing._encoder()
    assert [np.frombuffer(encode(x), "<u4").tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert zlib.crc32(encode("")) == 0
