"""Blocks in linear time, every word and ancestor of a block, a plain LSTM, and whole pages of the test tables."""

import math
import os
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from thicket.llm import html_blocks


def test_words_in_the_middle_of_a_long_block_count():
    words = [f"w{k}" for k in range(101)]
    plain, other = (html_blocks.Block(" ".join([*words[:50], w, *words[51:]]), ["p"]) for w in ("cookies", "article"))
    span = slice(html_blocks.PATH, html_blocks.PATH + html_blocks.WORDS)
    a, b = (html_blocks.vectors([x])[0, span] for x in (plain, other))
    assert not np.array_equal(a, b)
    assert abs(a.sum() * np.sqrt(101) - 101) < 1e-3


MALFORMED = {
    "unclosed quote": lambda n: "<a " * n + '"',
    "quotes across tags": lambda n: """<p a='b" c="d'>x""" * n,
    "deep": lambda n: "<div class='a b'>x" * n,
    "deep and closed": lambda n: "<div id=q>x" * n + "</div>" * n,
    "script without end": lambda n: "<script>" + "</script" * n,
    "stray ends": lambda n: "</div>" * n + "<i>" * n,
    "comments without end": lambda n: "<p>x" + "<!--" * n,
    "angle brackets": lambda n: "<" * 5 * n,
    "attributes": lambda n: "<p " + "class=" * n + ">x",
    "spaces": lambda n: "<p class" + " " * 5 * n + "=a>x",
}


@pytest.mark.parametrize("kind", MALFORMED)
def test_malformed_pages_take_linear_time(kind):
    """Of a megabyte or so; a quadratic reader would need hours."""
    page = MALFORMED[kind](150_000)
    began = time.process_time()
    found = html_blocks.blocks(page)
    assert time.process_time() - began < 20
    if kind.startswith("deep"):
        assert len(found) == 150_000 and found[-1].above.sum() >= 150_000


def test_tags_are_read_as_browsers_do():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<p title='a > b'>one<p>two") == ["one", "two"]
    assert texts("a<!-- <p>x -->b<!doctype html>c<?pi?>d") == ["abcd"]
    assert texts("<script>a</scripty></script >b") == ["b"] and texts("<style>never closed") == []
    assert texts("x < y <b>z</b>") == ["x < y z"] and texts("<p a='>one") == ["one"]
    assert [b.linked for b in html_blocks.blocks("<p>ab<a href='x'>cde</a>f")] == [3]


def test_ancestors_are_counted_in_full():
    """The path's part of a vector, from the names of all ancestors."""
    page = "<main id=a><div class='x y'><section><div class='x'><ul><li><p>text</p></li></ul></div></section></div></main>"
    (block,) = html_blocks.blocks(page)
    names = ["main", ".a", "div", ".x", ".y", "section", "div", ".x", "ul", "li", "p"]
    assert block.path == names[-html_blocks.NEAR :]
    whole = html_blocks.vectors([html_blocks.Block("text", names)])
    assert np.array_equal(html_blocks.vectors([block])[0], whole[0])
    want = np.zeros(html_blocks.PATH)
    for depth, name in enumerate(reversed(names)):
        want[html_blocks._slot(name, html_blocks.PATH)] += 1.0 if depth < 6 else 0.5
    assert whole[0, : html_blocks.PATH] == pytest.approx(np.minimum(want, 3.0))


def plain_logits(p, x):
    """One page through the network, number by number."""
    h = html_blocks.HIDDEN
    sig = lambda z: 1 / (1 + math.exp(-z))

    def run(rows, d):
        state, cell, out = [0.0] * h, [0.0] * h, []
        for row in rows:
            z = [p["c" + d][j] + sum(v * p["x" + d][i][j] for i, v in enumerate(row) if v) + sum(state[i] * p["h" + d][i][j] for i in range(h)) for j in range(4 * h)]
            cell = [sig(z[h + j]) * cell[j] + sig(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
            state = [sig(z[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            out.append(state)
        return out

    a, b = run(x, "f"), run(x[::-1], "b")[::-1]
    return [sum(u * w for u, w in zip([*s, *t, *row], p["o"], strict=True)) + p["oc"][0] for s, t, row in zip(a, b, x, strict=True)]


def test_the_labeller_against_a_plain_one():
    model = html_blocks.Labeller(5)
    g = html_blocks.Generator(3)
    pages = [[], *sorted((g.page() for _ in range(6)), key=len)[:3]]
    for page, marks in zip(pages, model.label(pages), strict=True):
        x = html_blocks.vectors(page)
        want = plain_logits(model.p, x.tolist()) if len(page) else []
        assert marks.tolist() == [z > 0 for z in want]
        if len(page):
            got = model.logits(*html_blocks.padded([x]))[:, 0]
            assert got == pytest.approx(want, abs=1e-3)


PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables here")
def test_pages_of_the_test_tables():
    """The labeller never sees these pages when it is trained; their articles stand in article tags."""
    pages = [html_blocks.blocks(t or "") for t in pq.read_table(PAGES, columns=["html"]).column(0).to_pylist()]
    exact = [marks.tolist() == ["article" in b.path for b in page] for page, marks in zip(pages, html_blocks.trained().label(pages), strict=True)]
    assert np.mean(exact) >= 0.97


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    out = html_blocks.extract(df, model=html_blocks.Labeller())
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 0
