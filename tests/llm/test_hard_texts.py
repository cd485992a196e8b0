"""Texts that once cost too much or lost parts: common words, long broken tags, anchors of headings, comments."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.llm import decontam, extraction, urlfilter


def common_word_block(items=3000, seed=0):
    """Items that all hold one common content word, and words of their own."""
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(8)] + ["common"] + [f"w{k}" for k in rng.integers(0, 500, 6)])) for i in range(items)]
    b = decontam.load_block(rows, 24)
    b.idf = np.full(len(b.vocabulary) + 1, 6.0)
    b.idf[b.vocabulary[b"common"]] = 1.2
    b.content = b.idf[:-1] > 1.0
    b.index(decontam.LIKELY)
    return b


def test_a_common_word_costs_little():
    b, rng = common_word_block(), np.random.default_rng(1)
    words = np.array([f"z{k}" for k in rng.integers(0, 5000, 20_000)], dtype=object)
    words[rng.choice(20_000, 4000, replace=False)] = "common"
    words[700:715] = "own7x0 own7x1 own7x2 own7x3 own7x4 own7x5 own7x6 own7x7 common a b c d e f".split()
    w = b.numbers(" ".join(words).encode())
    tracemalloc.start()
    began = time.perf_counter()
    found = list(b.stretches(w))
    took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert {int(i) for items, _, first in found for i in items[first]} == {7}
    assert took < 1 and peak < 200e6


def plain_stretches(b, w):
    """(item, start) of the telling words from which on a stretch of the item's reach has as many as a leak needs."""
    out = set()
    for item in range(len(b.words)):
        told = b.telling(item).tolist()
        places = [k for k, x in enumerate(w.tolist()) if x in told]
        for k in places:
            inside = [int(w[j]) for j in places if k <= j < k + b.reach[item]]
            if sum(min(inside.count(x), told.count(x)) for x in set(told)) >= b.needs[item]:
                out.add((item, k))
    return out


@pytest.mark.parametrize("most", [1, 40, 1_000_000])
def test_stretches_lose_none(most):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, int(rng.integers(1, 12))))) for i in range(40)]
    b = decontam.load_block(rows, 6)
    b.idf = rng.random(len(b.vocabulary) + 1) * 3
    b.content = b.idf[:-1] > 1.0
    b.index(decontam.LIKELY)
    some = 0
    for _ in range(60):
        w = b.numbers(" ".join(f"w{k}" for k in rng.integers(0, 60, int(rng.integers(0, 80)))).encode())
        got = {(int(items[f]), int(at[f])) for items, at, first in b.stretches(w, most) for f in first}
        assert got == plain_stretches(b, w)
        some += len(got)
    assert some


def body(inner):
    return f"<html><body><div class='menu-left'><a href='/a'>Home</a> <a href='/b'>More</a></div><article>{inner}</article></body></html>"


LINE = "A sentence of plain words that goes on for a while, as articles do. "


def test_anchors_of_headings_and_sections_stay():
    inner = "".join(f"<h2 id='{i}'>Head {i}</h2><section id='{i}-part' class='social-history-text'><p>{LINE}</p></section>" for i in ("related-work", "social-history", "notice-period", "comments-on-x", "share"))
    got = extraction.main_text(body(inner)).split("\n")
    assert got == [x for i in ("related-work", "social-history", "notice-period", "comments-on-x", "share") for x in (f"Head {i}", LINE.strip())]
    assert "Head" in extraction.main_text(f"<body><h1 class='page-header' id='menu'>Head</h1><div><p>{LINE * 3}</p></div></body>")


def test_widgets_inside_articles_go():
    inner = f"<p>{LINE}</p><div class='box ad'>Buy</div><div class='related-posts'>Else</div><div role='search'>Find</div><aside>Aside</aside><form>Form</form><p>{LINE}</p><div class='comments'><p>{LINE}reader</p></div>"
    assert extraction.main_text(body(inner)) == f"{LINE.strip()}\n{LINE.strip()}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<!--", ""), ("<!-- never closed <p>x</p>", ""), (" <!-- x", ""), ("<!--><p>a</p>", "a"), ("<!---><p>a</p>", "a"), ("<!-- x --><p>a</p>", "a"), ("x<!-- y --> z", "x z"), ("<!", ""), ("<!doctype html><p>a", "a"), ("a<!-- -- > b --><i>c</i>", "ac"),
    ],
)
def test_comments(page, text):
    assert extraction.main_text(page) == text


def test_density_decides_where_no_word_does():
    links = "".join(f"<li><a href='/{i}'>Some other page of this site {i}</a></li>" for i in range(40))
    text = "".join(f"<p>{LINE * 4}</p>" for _ in range(6))
    want = "\n".join([(LINE * 4).strip()] * 6)
    for page in (
        f"<body><div class='x1'><ul>{links}</ul></div><div class='x2'>{text}</div><div class='x3'><ul>{links}</ul></div></body>",
        f"<body><table><tr><td><ul>{links}</ul></td><td><div>{text}</div></td></tr></table></body>",
        f"<body><div><div><ul>{links}</ul></div><div><div>{text}</div></div></div><div>Imprint <a href='/i'>here</a></div></body>",
    ):
        assert extraction.main_text(page) == want


def test_broken_links_cost_their_length(spark):
    pages = spark.createDataFrame([("a", "<a " * 60_000), ("b", "<a x='" * 30_000), ("c", "<a " + "href " * 40_000), ("d", "<A class=x\nHREF = 'http://B.org/x'>t</a> <a data-href='//no.org'>u</a><a title='q' href=//c.net>")], "host string, html string")
    urlfilter.host_edges(pages.where("host = 'd'")).collect()
    began = time.perf_counter()
    got = sorted(tuple(r) for r in urlfilter.host_edges(pages).collect())
    assert got == [("d", "b.org", 1.0), ("d", "c.net", 1.0)] and time.perf_counter() - began < 5
    assert urlfilter.host_edges(pages.where(F.col("host") == "a")).count() == 0
