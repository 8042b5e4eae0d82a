from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from helpers import by_id
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortide.llm import html_extract as h
from cohortide.llm.html_labelled import PAGES


@pytest.fixture(scope="module")
def model():
    return h.fit_tree(PAGES)


def test_marginals_match_enumeration(model):
    tree = h.parse("<div><p>One, two. <b>three</b></p><nav><a href='/'>x</a></nav></div>")
    f = h.node_features(tree)
    features, stops, parent, inline = f
    n = len(parent)
    own = [sum(model.unary[x]) + model.unary[h._AT["stops"]] * s for x, s in zip(features, stops, strict=True)]
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = sum(own[i] for i in range(n) if y[i]) + sum(model.pair[int(inline[i]), y[parent[i]], y[i]] for i in range(1, n))
        total += np.exp(w)
        mass += np.exp(w) * np.array(y)
    assert model.marginals(*f)[0] == pytest.approx(mass / total)


def test_labelled_pages_are_learned(model):
    for page in PAGES:
        text, _ = h.extract(page, model)
        kept = [e for e in h.parse(page).elements if e.keep == "1"]
        assert bool(text) == bool(kept)


CASES = [
    ("<article><h1>A &amp; B</h1><p>One,&nbsp;two\n  three.<p>Four &lt;b&gt; five.</article><footer>no, never.</footer>", "A & B\nOne, two three.\nFour <b> five."),
    ("<nav><a href='/'>Home page</a></nav><article><p>Text, of <i>some</i> words.</p><script>var p='<p>x</p>'</script><style>p{}</style></article>", "Text, of some words."),
    ("<article><p>Real words, here.</p><div class='comments'><p>I, a reader, think so too. Yes.</p></div></article>", "Real words, here."),
    ("<div class='sidebar'><p>Much to read, on the side. More of it.</p></div><article><p>Real words, here.</p></article>", "Real words, here."),
    ("<article><p>Real words, here.</p><form><p>Your name, please.</p><button>Send it</button></form></article>", "Real words, here."),
    ("<div id='cookie-notice'><p>We use cookies, on all pages.</p></div><article><p>Real words, here.</p></article>", "Real words, here."),
    ("<article><p>Cut off in the <b>mid", "Cut off in the mid"),
    ("", ""),
    (None, ""),
    ("<html><nav><a href='/'>only menus</a></nav></html>", ""),
]


@pytest.mark.parametrize("html, want", CASES)
def test_text(model, html, want):
    assert h.extract(html or "", model)[0] == want


def test_pages_table(spark, model):
    deep = "<div>" * 3000 + "<p>deep, indeed.</p>"
    rows = [(i, "u", x) for i, (x, _) in enumerate(CASES)] + [(99, None, CASES[0][0]), (99, None, CASES[0][0]), (None, "u", "<![x"), (98, "u", deep), (97, "u", "<article><p>" + "word " * 50000 + "</p></article>")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = h.extract_pages(t, model).collect()
    assert len(got) == len(rows)
    rows_by = {r["page_id"]: r for r in got}
    for i, (_, want) in enumerate(CASES):
        assert (rows_by[i]["text"], rows_by[i]["n_chars"]) == (want, len(want))
    assert rows_by[97]["n_chars"] == 50000 * 5 - 1
    assert h.extract_pages(t.limit(0), model).count() == 0
    assert by_id(h.extract_pages(t.filter("page_id = 0"), model), "page_id")[0]["url"] == "u"


MARKUP = ["<p>", "</p>", "<b>", "</i>", "<div class=x>", "</div>", "<![foo bar]>", "<![ >", "<![CDATA[x]]>", "<!", "<!-- c", "-->", "<?x", "</", "<", "&amp", "&#x", "<table><td>", "<script>", "</script>", "text ", "<a href='", '"', ">", "\x00", "<!doctype", "]]>"]


@given(st.lists(st.sampled_from(MARKUP), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_parsed(model, parts):
    text, _ = h.extract("".join(parts), model)
    assert "<!--" not in text


def test_unfinished_markup_is_no_text():
    for end in ("<!-- c", "<div class=", "<![x", "<?php", "</di", "<!"):
        tree = h.parse("<p>one</p> two" + end)
        assert "".join(t for _, t in sorted(p for e in tree.elements for p in e.pieces)) == "one two"


def test_parsing_is_linear():
    def seconds(page):
        start = time.perf_counter()
        h.parse(page)
        return time.perf_counter() - start

    for unit in ("<b></i>x", "<p><button><b><div>", "<table><td><b>x"):
        assert seconds(unit * 40_000) < 20 * max(seconds(unit * 4_000), 0.01)
