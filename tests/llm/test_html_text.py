import html
import re

import numpy as np
import pytest

from docspark.llm import html_text as H


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article_of(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>|<br>", inside)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r.html for r in pages.collect()}
    rows = H.extract(pages).collect()
    assert len(rows) == len(whole)
    for r in rows:
        assert r.text == article_of(whole[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize("nth", range(len(H.LAYOUTS)))
def test_labelled_layouts_with_other_texts(model, nth):
    page = H.layout_page(H.LAYOUTS[nth], 70 + nth)
    nodes, blocks = H.parse(page, labels=True)
    want = "\n".join(t for n, t in blocks if nodes[n].label)
    assert H.main_text(page, model) == want


def test_marginals_equal_enumeration(model):
    """Sum-product on a small tree gives the same marginals as summing over all labellings."""
    nodes, _ = H.parse("<body><nav><a href='/'>x</a></nav><article><h1>a b</h1><p>c d e.</p></article></body>")
    found = H.marginals(nodes, model)
    odds = [sum(model["odds"].get(repr(f), 0.0) for f in H.features(n)) for n in nodes]
    total = np.zeros((len(nodes), 2))
    for code in range(1 << len(nodes)):
        y = [code >> i & 1 for i in range(len(nodes))]
        score = y[0] * model["root"] + sum(o for o, on in zip(odds, y) if on)
        for i, n in enumerate(nodes[1:], 1):
            edge = model["edge"][H.edge_kind(nodes[n.parent], n)]
            score += np.log(edge[2 * y[n.parent] + y[i]])
        for i, on in enumerate(y):
            total[i, on] += np.exp(score)
    assert np.allclose(found, np.log(total[:, 1] / total[:, 0]))


def test_blocks_and_references():
    page = "<div>a &amp; b<script>if (a < b) '</p>'</script> c<p>d<b> e</b>f<br>g&nbsp;h<p>i<!-- x > y --><li>j</ul>k"
    _, blocks = H.parse(page)
    assert [t for _, t in blocks] == ["a & b c", "d ef", "g h", "i", "jk"]
    for broken in ("<", "<p", "<!--", "</", "<p a='", "&#xZZ; &amp", "<script>", "<![CDATA[x", "\x00<p>\x00"):
        H.parse(broken)


def test_odd_rows(spark, model):
    rows = [
        (1, "u", None),
        (2, None, ""),
        (None, "u", "<article><p>" + "word " * 20 + "</article>"),
        (3, "u", "<nav><a href='/'>menu</a></nav>"),
        (4, "u", "<article><p>" + "many words. " * 50_000 + "</p></article>"),
        (4, "u", "<article><p>" + "many words. " * 50_000 + "</p></article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    found = H.extract(pages, model).collect()
    by = {r.page_id: r.text for r in found}
    assert len(found) == 6 and by[1] == by[2] == by[3] == "" and len(by[4]) == 12 * 50_000 - 1
    assert by[None] == " ".join(["word"] * 20)
    assert H.extract(pages).count() == 6 and H.extract(pages.limit(0)).count() == 0


def test_quotes_count_in_values_only():
    blocks = lambda page: [t for _, t in H.parse(page)[1]]
    assert blocks('<p>a <img alt="5" wide"> b</p><p title=it\'s>c</p><p x = "a > b" y=\'>\'>d</p>') == ["a b", "c", "d"]
    assert blocks("<p class='a'b'>e</p><p a='open>h</p>") == ["e", "h"]


def test_many_open_elements_take_linear_time():
    import time

    def seconds(n):
        page = "<div><p>" + "<b>x<i>" * n + "<div>y</div></i></b><p>z" * n
        began = time.process_time()
        H.parse(page)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.005)
