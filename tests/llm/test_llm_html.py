import html
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quercus.llm import dom, html_extraction as hx

SCHEMA = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def trees(spark):
    return hx.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), max_pages=150)


def texts_of(source):
    return [t for _, t in dom.parse(source).runs]


def test_parse():
    assert texts_of("<p>a<p>b &amp;amp; c&nbsp;d<br>e<div>f <b>g</i> h</div>i") == ["a", "b &amp; c d e", "f g h", "i"]
    assert texts_of("<script>x</p></script>y<!-- z --><style>q</style>") == ["y"]
    assert texts_of("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts_of("1 < 2 <p title='a > b'>c</p> &#233; &bogus;") == ["1 < 2", "c", "é &bogus;"]
    assert texts_of("<script>never closed") == [] and texts_of(None) == [] and texts_of("") == []
    assert texts_of("<p>" * 3000 + "deep") == ["deep"]
    assert texts_of("<div>" * 3000 + "deep" + "</div>" * 10) == ["deep"]
    assert texts_of("<a href='" * 200 + "x") != []
    deep = dom.parse("<div class='Main-Content menu'><p>a</p></div>")
    assert deep.nodes[1].tokens == {"main", "content", "menu"}
    assert all(len(row) == len(dom.FEATURES) for row in dom.features(deep))


def brute_kept(page, probability):
    """Try every set of elements that is closed upwards."""
    n, best = len(page.nodes), None
    value = []
    for node, p in zip(page.nodes, probability):
        p = min(max(p, 0.01), 0.99)
        value.append(math.log(p / (1 - p)) * (math.log1p(node.own) if node.own else 0.25))
    # paragraphs side by side share their mean
    for parent in range(n):
        group = [i for i, node in enumerate(page.nodes) if node.parent == parent and node.tag == "p" and node.own]
        weight = [math.log1p(page.nodes[i].own) for i in group]
        for i, w in zip(group, weight):
            value[i] = (value[i], w)
        mean = sum(value[i][0] for i in group) / sum(weight) if group else 0.0
        for i, w in zip(group, weight):
            value[i] = mean * w
    if not page.nodes[0].own:
        value[0] = max(value[0], 0.0)
    for keep in itertools.product([False, True], repeat=n):
        if all(not k or i == 0 or keep[page.nodes[i].parent] for i, k in enumerate(keep)):
            total = sum(v for v, k in zip(value, keep) if k)
            if best is None or total > best + 1e-12:
                best = total
    return best, value


@pytest.mark.parametrize("seed", range(8))
def test_decoding_is_the_best_choice(seed):
    page = dom.parse("<div>aa<p>bbb<p>c<div><p>dd</div></div><section>eee<ul><li>f</ul></section>")
    p = np.random.default_rng(seed).uniform(0, 1, len(page.nodes))
    best, value = brute_kept(page, p.tolist())
    assert hx.values(page, p) == pytest.approx(value)
    keep = hx.best(page, hx.values(page, p))
    assert sum(v for v, k in zip(value, keep) if k) == pytest.approx(best)
    assert all(not k or i == 0 or keep[page.nodes[i].parent] for i, k in enumerate(keep))


def test_dresses_keep_the_article():
    source = "<body><nav><ul><li><a>m</a></ul></nav><article><h1>Head line</h1><p>First words here. More of them.</p></article><footer>f</footer>"
    for number in range(40):
        page = dom.parse(hx.dressed(source, number))
        marks = hx.labelled(page)
        inside = [t for node, t in page.runs if marks[node] == 1]
        assert inside in (["Head line", "First words here. More of them."], ["Head line First words here. More of them."]) or (
            len(inside) == 1 and set(inside[0].replace(".", "").split()) <= set("Head line First words here More of them".split())
        ), number
    assert hx.dressed("<p>no article</p>", 1) is None and hx.dressed("</article><article>", 0) is None


def expected(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_pages_equal_their_articles(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = hx.extract(pages, trees).join(pages.select("page_id", "html"), "page_id").collect()
    assert sum(r.text == expected(r.html) for r in rows) >= 0.99 * len(rows) == 0.99 * pages.count()
    assert all(r.n_chars == len(r.text) for r in rows)


def test_what_stands_between_kept_siblings():
    page = dom.parse("<div><p>A long paragraph of many words.</p><ul><li>an item</ul><p>And one more of them.</p><ul><li>behind</ul></div>")
    by = {"html": 0.5, "div": 0.9, "p": 0.95, "ul": 0.3, "li": 0.3}
    keep = hx.kept(page, np.array([by[n.tag] for n in page.nodes]))
    assert [t for n, t in page.runs if keep[n]] == ["A long paragraph of many words.", "an item", "And one more of them."]
    # what surely is none stays out, also there
    by.update(ul=0.02, li=0.02)
    keep = hx.kept(page, np.array([by[n.tag] for n in page.nodes]))
    assert "an item" not in [t for n, t in page.runs if keep[n]]
    short = dom.parse("<div><p>A long paragraph of many words.</p><p>Yes.</p><p>And one more of them.</p></div>")
    assert all(hx.kept(short, np.array([0.5, 0.9, 0.95, 0.05, 0.9])))


UNMARKED = [("<div>", "</div>"), ("<div class='x'>", "</div>"), ("<section>", "</section>")]


def unmarked(html_column, open_, close):
    return F.regexp_replace(F.regexp_replace(html_column, "<article>", open_), "</article>", close)


@pytest.mark.parametrize("open_, close", UNMARKED)
def test_pages_without_a_marked_article(spark, trees, open_, close):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages.withColumn("html", unmarked("html", open_, close))
    rows = hx.extract(plain, trees).join(pages.select("page_id", "html"), "page_id").collect()
    assert sum(r.text == expected(r.html) for r in rows) == len(rows) == pages.count()


def test_few_marked_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    few = pages.withColumn("html", F.when(F.col("page_id") % 50 == 0, F.col("html")).otherwise(unmarked("html", "<div>", "</div>")))
    rows = hx.extract(few, hx.fit(few)).join(pages.select("page_id", "html"), "page_id").collect()
    assert sum(r.text == expected(r.html) for r in rows) >= 0.98 * len(rows) == 0.98 * pages.count()


def test_other_layouts(spark, trees):
    body = "".join(f"<p>This is sentence number {k}, with a few words more. And another one follows it here.</p>" for k in range(6))
    page = (
        "<html><body><div class='cookie-notice'><p>We use cookies on this site.</p></div><div id='menu'><ul><li><a href='/'>Home</a>"
        f"</li><li><a href='/b'>Blog</a></li></ul></div><div class='post-content'>{body}</div><aside class='sidebar'><ul><li><a href='/c'>"
        "Other text</a></li></ul></aside><section class='comments'><div class='comment'><p>I like this a lot.</p></div></section>"
        "<form><label>Mail</label><input><button>Send</button></form><div id='footer'>Copyright 2020</div></body></html>"
    )
    rows = [(1, "u", page), (2, "u", page.replace("post-content", "x9").replace("cookie-notice", "gdpr"))]
    for r in hx.extract(spark.createDataFrame(rows, SCHEMA), trees).collect():
        assert r.text.count("sentence number") == 6
        for noise in ("cookies", "Home", "Other text", "like this", "Mail", "Send", "Copyright"):
            assert noise not in r.text


def test_odd_rows(spark, trees):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p></p>"), (4, "u", "<article><p>" + "long words here. " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS label")
    got = hx.extract(df, trees).collect()
    assert len(got) == 5
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[None].text == "" and by[1].n_chars == 0
    assert by[4].n_chars > 700_000
    assert hx.extract(spark.createDataFrame([], SCHEMA), trees).count() == 0


def test_nothing_to_learn_from(spark):
    plain = spark.createDataFrame([(1, "u", "<div><p>text</p></div>"), (2, "u", None)], SCHEMA)
    assert {r.page_id: r.text for r in hx.extract(plain, hx.fit(plain)).collect()} == {1: "text", 2: ""}


def test_only_what_is_inside_is_left_out():
    assert texts_of("<p>a <svg class='i'/> b</p><p>c</p>") == ["a b", "c"]
    assert texts_of("<p>a <svg/> b</p><p>c <svg><title>t</title><text>x</text></svg> d</p>") == ["a b", "c d"]
    assert texts_of("<p>a <svg><path/><title>b</p><p>c</p>") == ["a", "c"]
    assert texts_of("<svg><foreignObject><p>x</p></foreignObject></svg><p>c</p>") == ["c"]
    assert texts_of("<svg><g><svg><text>x</text></svg><text>y</text></g></svg>z") == ["z"]
    assert texts_of("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds <math/> here</p>") == ["so x=1 holds here"]
    for tag in ("button", "select", "noscript", "template"):
        assert texts_of(f"<p>a <{tag}>x</{tag}> b</p>") == ["a b"]
        assert texts_of(f"<{tag}><div>x</div><b>y</b></{tag}>z") == ["z"]
        assert texts_of(f"<div>a<{tag}>x</div><p>b</p>") == ["a", "b"]
        assert texts_of(f"<div>a<{tag}>x<p>b</p></div><{tag}>y</{tag}>c") in (["a", "b", "c"], ["a", "b c"])
        assert texts_of(f"<span>a<{tag}>x</span> b<p>c") == ["a b", "c"]
    assert texts_of("<template><template><p>x</p></template><p>y</p></template>z") == ["z"]
    assert texts_of("<select><option>x<option>y</select>z<select><option>v") == ["z"]
    assert texts_of("<noscript><style>p</noscript></style>x</noscript>z") == ["z"]
    assert texts_of("<svg>" * 3000 + "x" + "</svg>" * 3000 + "z") == ["z"]
    controls = dom.parse("<form><select><option>x</select><button>y</button><textarea>z</textarea></form>").nodes
    assert sum(node.controls for node in controls) == 3
