"""Main text of web pages: gradient-boosted trees over elements of the page, decoded along the tree.

Labels come from pages that mark their article themselves (``article`` or ``main``): what is inside is text,
what is outside is not. So that the trees don't lean on those tags, each such page is also read in other
dress: containers under other names and attribute tokens, with notices, comments, side columns and forms
made of the page's own sentences around or behind the article.

Decoding: each element has the log-odds of its probability, weighted by the text that is directly in it.
Paragraphs and headings side by side under one element share their mean, so a short one does not go alone,
and what stands between two kept siblings gains BETWEEN. An element is kept if its own value and those of its
kept children are positive together; under a dropped element everything is dropped. So no text is kept whose
ancestor is not, and nothing contradicts.

Defined cases: a null or empty page, and one without text, gives the empty text; without a page that marks
its article nothing can be learned and all visible text is kept; pages are judged one by one, so repeated
rows repeat; very long pages are read whole; an element whose gain is exactly zero is left out; an empty table gives
no rows; columns besides id, url and html are not looked at.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quercus.llm.boosting import Trees, fit_trees
from quercus.llm.common import bounded_batches, bounded_sample, settle
from quercus.llm.dom import FEATURES, KINDS, Page, features, parse

#: Marked pages that the trees are fitted on at most, and the dresses that each is read in: as many as it takes
#: to have READINGS of them, where marked pages are few.
MAX_FIT_PAGES = 1_500
DRESSES, MAX_DRESSES, READINGS = 4, 80, 600
#: Log-odds that an element gains if siblings before and after it are kept.
BETWEEN = 1.5

ARTICLE = re.compile(r"<(/?)(article|main)\b([^>]*)>", re.I)
MARKED = r"(?i)<(article|main)\b[^>]*>"
PROSE = frozenset(KINDS["paragraph"] + KINDS["heading"])
MENUS = ("menu", "navbar", "main-nav", "breadcrumbs", "toolbar")
BODIES = ("content", "post-content", "entry", "article-body", "story", "main-text")
FEET = ("footer", "site-footer", "copyright", "foot")
ADVERTS = ("ad", "advert", "promo-box", "banner", "sponsored", "ads top")
PARTS = re.compile(r"<[^>]*>")


def _renamed(source: str, tag: str, to: str, attributes: str) -> str:
    source = re.sub(rf"<{tag}\b[^>]*>", lambda _: f"<{to} {attributes}>".replace(" >", ">"), source, flags=re.I)
    return re.sub(rf"</{tag}\s*>", f"</{to}>", source, flags=re.I)


def dressed(source: str, number: int) -> str | None:
    """The page with its article marked by data-mark; in other dress if ``number`` isn't 0. None without an article."""
    first = ARTICLE.search(source)
    if not first or first[1]:
        return None
    name = first[2].lower()
    inner_start = first.end()
    ends = [m for m in ARTICLE.finditer(source, inner_start) if m[1] and m[2].lower() == name]
    if not ends:
        return None
    last = ends[-1]
    inner = source[inner_start : last.start()]
    head, tail = source[: first.start()], source[last.end() :]
    choose = random.Random(zlib.crc32(source.encode("utf-8", "replace")) + number)
    if number == 0:
        return f"{head}<{name}{first[3]} data-mark='1'>{inner}</{name}>{tail}"
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", PARTS.sub(" ", inner)) if len(s.strip()) > 10] or ["Text."]

    def say(least: int, most: int) -> str:
        return " ".join(choose.choice(sentences) for _ in range(choose.randint(least, most)))

    def words(most: int) -> str:
        return " ".join(say(1, 1).split()[:most])

    shape = choose.random()
    if shape < 0.2:  # one paragraph only, long or short
        inner = f"<p>{say(1, 60)}</p>"
    elif shape < 0.3:  # text without paragraphs
        inner = f"<div>{'<br>'.join(sentences)}</div>"
    if choose.random() < 0.2:  # an article that is nearly the whole page
        head, tail = "<html><body>", ""
    body = choose.choice(("article", "div", "section", "main", "td"))
    kind = f" class='{choose.choice(BODIES)}'" if body in ("div", "section") and choose.random() < 0.7 else ""
    open_, close = f"<{body}{kind} data-mark='1'>", f"</{body}>"
    if body == "td":
        open_, close = "<table><tr><td data-mark='1'>", "</td></tr></table>"
    if choose.random() < 0.6:
        head = _renamed(head, "nav", "div", f"class='{choose.choice(MENUS)}'")
    if choose.random() < 0.6:
        tail = _renamed(tail, "footer", "div", f"id='{choose.choice(FEET)}'")
    head = re.sub(r"class=\"ad\"", lambda _: f"class='{choose.choice(ADVERTS)}'", head)
    extras = {
        "cookie": f"<div class='{choose.choice(('cookie-notice', 'consent', 'gdpr-banner'))}'><p>{say(1, 3)}</p><button>OK</button></div>",
        "header": f"<header><h2>{words(4)}</h2><p>{say(1, 1)}</p></header>",
    }
    behind = {
        "comments": f"<{(c := choose.choice(('section', 'div')))} class='{choose.choice(('comments', 'comment-list', 'discussion'))}'>"
        f"<h3>{words(2)}</h3>" + "".join(f"<div class='comment'><p>{say(1, 4)}</p></div>" for _ in range(choose.randint(1, 4))) + f"</{c}>",
        "side": f"<aside class='{choose.choice(('sidebar', 'widget', ''))}'><h4>{words(3)}</h4><ul>"
        + "".join(f"<li><a href='/x'>{words(6)}</a></li>" for _ in range(choose.randint(2, 6))) + f"</ul><p>{say(1, 2)}</p></aside>",
        "form": f"<form action='/s'><label>{words(3)}</label><input name='q'><p>{say(1, 2)}</p><button>{words(1)}</button></form>",
        "related": f"<div class='{choose.choice(('related', 'recommended', 'share'))}'><p>{words(8)}</p><a href='/y'>{words(6)}</a></div>",
    }
    before = "".join(v for v in extras.values() if choose.random() < 0.4)
    after = [v for v in behind.values() if choose.random() < 0.4]
    if choose.random() < 0.3 and after:
        inner += after.pop()  # inside the article, yet no part of it
        inner = inner.replace("<aside", "<aside data-mark='0'").replace("<form", "<form data-mark='0'")
        inner = re.sub(r"<(section|div) class='(comment|discussion|related|recommended|share)", r"<\1 data-mark='0' class='\2", inner)
    at = head.lower().rfind("<body")
    at = head.find(">", at) + 1 if at >= 0 else len(head)
    return f"{head[:at]}{before}{head[at:]}{open_}{inner}{close}{''.join(after)}{tail}"


def labelled(page: Page) -> list[int | None]:
    """1 for elements of the marked article, 0 for others, None for those that hold both or no text."""
    nodes = page.nodes
    inside: list[int] = []
    for node in nodes:
        if node.mark is not None:
            inside.append(int(node.mark))
        else:
            inside.append(inside[node.parent] if node.parent >= 0 else 0)
    has = [{inside[i]} if node.own else set() for i, node in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        has[nodes[i].parent] |= has[i]
    return [next(iter(h)) if len(h) == 1 else None for h in has]


def training_rows(pages: DataFrame, html_column: str, dresses: int = DRESSES) -> DataFrame:
    """(features, label) of the elements of all pages that mark their article, in each dress."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, marks = [], []
            for source in batch.iloc[:, 0]:
                for number in range(dresses):
                    worn = dressed(source, number)
                    if worn is None:
                        break
                    page = parse(worn)
                    for x, y in zip(features(page), labelled(page)):
                        if y is not None:
                            made.append(x)
                            marks.append(y)
            if made:
                yield pd.DataFrame({"features": made, "label": marks})

    return pages.select(html_column).mapInPandas(rows, "features array<double>, label int")


def fit(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", max_pages: int = MAX_FIT_PAGES) -> Trees:
    """The trees of at most about ``max_pages`` pages that mark their article, chosen by a hash of the id."""
    bounded_batches(pages.sparkSession)
    marked = pages.filter(F.col(html_column).rlike(MARKED)).select(id_column, html_column)
    sample = settle(bounded_sample(marked, id_column, max_pages), "marked-pages")
    dresses = min(max(DRESSES, math.ceil(READINGS / max(sample.count(), 1))), MAX_DRESSES)
    # a few pages in many dresses are as much work as many pages
    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism, id_column)
    rows = settle(training_rows(spread.select(html_column), html_column, dresses), "page-elements")
    if rows.isEmpty():
        none = np.zeros((0, 0))
        return Trees(none, none, none, none, none, np.zeros(0), 0, 1.0)
    return fit_trees(rows, rounds=15, depth=5)


def values(page: Page, probability: np.ndarray) -> list[float]:
    """What keeping each element is worth by itself."""
    nodes = page.nodes
    odds = np.clip(probability, 0.01, 0.99)
    odds = np.log(odds / (1 - odds)).tolist()
    weight = [math.log1p(node.own) if node.own else 0.25 for node in nodes]
    side_by_side: dict[tuple, list[int]] = {}
    for i, node in enumerate(nodes):
        if i and node.own and node.tag in PROSE:
            side_by_side.setdefault((node.parent, node.tokens), []).append(i)
    for group in side_by_side.values():
        mean = sum(odds[i] * weight[i] for i in group) / sum(weight[i] for i in group)
        for i in group:
            odds[i] = mean
    out = [o * w for o, w in zip(odds, weight)]
    out[0] = max(out[0], 0.0) if not nodes[0].own else out[0]
    return out


def best(page: Page, value: list[float]) -> list[bool]:
    """Which elements are kept: the choice of most value in which each kept element has a kept parent."""
    nodes = page.nodes
    gain = list(value)
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    out = [gain[0] > 0]
    for i in range(1, len(nodes)):
        out.append(out[nodes[i].parent] and gain[i] > 0)
    return out


def kept(page: Page, probability: np.ndarray) -> list[bool]:
    """The best choice, made again once what stands between kept siblings has gained BETWEEN."""
    nodes = page.nodes
    value = values(page, probability)
    keep = best(page, value)
    gains = [False] * len(nodes)
    for i, node in enumerate(nodes):
        chosen = [k for k, c in enumerate(node.children) if keep[c]]
        if chosen:
            for c in node.children[chosen[0] : chosen[-1]]:
                gains[c] = not keep[c]
        if gains[i]:
            for c in node.children:
                gains[c] = True
    if not any(gains):
        return keep
    more = [BETWEEN * (math.log1p(n.own) if n.own else 0.25) if g else 0.0 for n, g in zip(nodes, gains)]
    return best(page, [v + m for v, m in zip(value, more)])


def text_of(page: Page, probability: np.ndarray) -> str:
    keep = kept(page, probability)
    return "\n\n".join(text for node, text in page.runs if keep[node])


def extract(
    pages: DataFrame, trees: Trees, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for sources in batches:
            parsed = [parse(s) for s in sources]
            rows = [features(p) for p in parsed]
            edges = np.cumsum([0] + [len(r) for r in rows])
            x = np.array([f for r in rows for f in r]).reshape(-1, len(FEATURES))
            p = model.probability(x)
            yield pd.Series([text_of(page, p[a:b]) for page, a, b in zip(parsed, edges, edges[1:])], dtype=object)

    out = pages.select(id_column, url_column, main_text.asNondeterministic()(F.col(html_column)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
