"""A small reading of HTML: block elements as a tree, text runs that belong to them, features of each element.

Inline markup is transparent; script, style and the like are skipped to their end tag. The text of svg, buttons,
lists to choose from, templates and noscript is left out while they are open, and they close with what holds
them; the text of math stays. End tags that are missing are implied where a block starts that can't be inside,
and stray end tags are ignored.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
TOKEN = re.compile(r"[a-z]+")

RAW = frozenset("script style textarea title xmp iframe noframes noembed".split())
#: Elements whose text is left out while they are open.
UNREAD = frozenset("svg select button noscript template".split())
NESTS = frozenset(["svg", "template"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none "
    "mtable mtr mlabeledtr mtd mstyle mspace mpadded mphantom mfenced menclose merror maction semantics annotation "
    "annotation-xml".split()
)
SPACE_TAGS = frozenset(["br", "wbr", "img", "input"])
SPACED = frozenset(["mtd", "mtr", "mspace", "annotation", "annotation-xml"])
#: Elements that end an open paragraph by starting.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dt dd tr td th tbody thead tfoot".split()
)
#: Elements that end an open element of the given kinds by starting, up to the nearest container named.
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)),
    "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)),
}
GOOD_TOKENS = frozenset("article body blog content entry hentry main page post story text prose news".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline combx comment comments community consent cookie "
    "cookies copyright disclaimer discussion disqus extra feedback foot footer footnote form gdpr head header login "
    "masthead menu meta modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination "
    "popup privacy promo promoted recommended related remark replies reply reviews rss search share shoutbox sidebar "
    "signup site skip skyscraper social sponsor sponsored subscribe tags toolbar top widget".split()
)
KINDS = {
    "menu_like": ("nav", "header", "footer", "aside", "menu", "dialog"), "article_like": ("article", "main"),
    "paragraph": ("p", "pre", "blockquote", "figcaption"), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "list": ("ul", "ol", "li", "dl", "dt", "dd"), "table": ("table", "tr", "td", "th", "tbody", "thead", "tfoot"),
    "form": ("form", "fieldset"), "plain": ("div", "section", "center", "body", "html"),
}
FEATURES = (
    "log_text", "log_own_text", "log_elements", "text_per_element", "link_density", "depth", "place_among_siblings",
    "log_siblings", "alike_siblings", "share_of_siblings_text", "share_of_page", "stops_per_word", "words_per_run",
    "paragraph_share", "list_share", "controls", "good_tokens", "bad_tokens", "good_above", "bad_above", "menu_above",
    "article_above", "list_above", "form_above", "start_in_page", "parent_text_share", *KINDS,
)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    mark: str | None
    children: list = field(default_factory=list)
    own: int = 0  # characters of text directly inside
    links: int = 0
    controls: int = 0
    runs: int = 0
    stops: int = 0
    words: int = 0
    start: int = 0  # characters of the page before it


@dataclass
class Page:
    nodes: list
    runs: list  # (node, text)


def with_end(source: str, tag: str) -> set[int]:
    """Where the start tags stand that have an end tag of their own."""
    open_, out = [], set()
    for found in re.finditer(rf"<(/?){tag}(?=[\s/>])([^>]*)", source, re.I):
        if found[1]:
            if open_:
                out.add(open_.pop())
        elif not (tag == "svg" and found[2].endswith("/")):
            if tag not in NESTS:
                open_.clear()
            open_.append(found.start())
    return out


def parse(source: str | None) -> Page:
    """The block elements and text runs of a page; node 0 is the page itself."""
    nodes = [Node("html", -1, 0, frozenset(), None)]
    stack, runs, pieces = [0], [], []
    linked, link_chars, total, at = 0, 0, 0, 0
    source = source or ""
    unread: list[str] = []  # an open element whose text is left out, and what is open inside
    loose = False  # it has no end tag
    ended: dict[str, set[int]] = {}

    def flush() -> None:
        nonlocal link_chars, total
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.links += min(link_chars, len(text))
                node.runs += 1
                node.words += text.count(" ") + 1
                node.stops += sum(map(text.count, ".,;!?:"))
                runs.append((stack[-1], text))
                total += len(text)
        link_chars = 0

    def close(kinds, barriers=()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in kinds:
                del stack[k:]
                return
            if tag in barriers:
                return

    while True:
        found = TAG.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text and not unread:
            pieces.append(text)
            if linked:
                link_chars += len(text.strip())
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if unread and found[1]:
            if tag in unread:
                del unread[len(unread) - 1 - unread[::-1].index(tag) :]
                continue
            # the end of what holds it; inline elements are not on the stack
            if loose or tag in ("html", "body") or any(nodes[k].tag == tag for k in stack[1:]):
                unread.clear()
            else:
                continue
        elif unread:
            breaks = tag in ENDS_P and (loose or (unread[0] == "svg" and "foreignobject" not in unread))
            if breaks or (tag == unread[0] and tag not in NESTS):
                unread.clear()
            elif unread[0] == "svg" or tag not in RAW:
                if tag not in VOID and not found[3].endswith("/"):
                    unread.append(tag)
                continue
        if found[1]:
            if tag in UNREAD:
                continue
            if tag == "a":
                linked = 0
            if tag in INLINE or tag in VOID:
                continue
            flush()
            linked = 0
            if tag not in ("html", "body"):
                close((tag,))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            nodes[stack[-1]].controls += tag == "textarea" and not unread
            pieces.append(" ")
            continue
        if tag in UNREAD:
            if tag in ("select", "button"):
                nodes[stack[-1]].controls += 1
            pieces.append(" ")
            if tag != "svg" or not found[3].endswith("/"):
                if tag not in ended:
                    ended[tag] = with_end(source, tag)
                unread.append(tag)
                loose = found.start() not in ended[tag]
            continue
        if tag in SPACED:
            pieces.append(" ")
        if tag in INLINE:
            linked = 1 if tag == "a" else linked
            continue
        if tag in SPACE_TAGS:
            pieces.append(" ")
            if tag == "input":
                nodes[stack[-1]].controls += 1
            continue
        flush()
        linked = 0
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            close(("p",), ("div", "section", "article", "td", "li", "form", "blockquote", "table"))
        if tag in ENDS_LIKE:
            close(*ENDS_LIKE[tag])
        tokens, mark = set(), None
        if found[3] and "=" in found[3]:
            for name, *values in ATTRIBUTE.findall(found[3]):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id", "role", "itemprop"):
                    tokens.update(TOKEN.findall(value.lower()))
                elif name == "data-mark":
                    mark = value
        node = Node(tag, stack[-1], nodes[stack[-1]].depth + 1, frozenset(tokens), mark, start=total)
        nodes[stack[-1]].children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(node)
    flush()
    return Page(nodes, runs)


def features(page: Page) -> list[list[float]]:
    """One row per element, in the order of FEATURES."""
    nodes = page.nodes
    n = len(nodes)
    text, links, elements, controls, runs, words, stops = ([0] * n for _ in range(7))
    paragraphs, lists = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        text[i] += node.own
        links[i] += node.links
        elements[i] += 1
        controls[i] += node.controls
        runs[i] += node.runs
        words[i] += node.words
        stops[i] += node.stops
        if node.tag in KINDS["paragraph"]:
            paragraphs[i] = text[i]
        if node.tag in KINDS["list"]:
            lists[i] = text[i]
        if node.parent >= 0:
            p = node.parent
            for sums in (text, links, elements, controls, runs, words, stops, paragraphs, lists):
                sums[p] += sums[i]
    total = max(text[0], 1)
    above: list[tuple] = [()] * n
    out = []
    for i, node in enumerate(nodes):
        good, bad = len(node.tokens & GOOD_TOKENS), len(node.tokens & BAD_TOKENS)
        # what its ancestors say about it, nearest or not
        if node.parent < 0:
            up = (0, 0, 0, 0, 0, 0)
            siblings, place, alike, sibling_text, parent_text = 1, 0, 0, text[i], text[i]
        else:
            p = node.parent
            parent = nodes[p]
            before = above[p]
            own = (
                bool(parent.tokens & GOOD_TOKENS), bool(parent.tokens & BAD_TOKENS), parent.tag in KINDS["menu_like"],
                parent.tag in KINDS["article_like"], parent.tag in KINDS["list"], parent.tag in KINDS["form"],
            )
            up = tuple(int(a or b) for a, b in zip(before, own))
            siblings = len(parent.children)
            place = i
            alike = parent.__dict__.setdefault("_tags", {}).get(node.tag)
            if alike is None:
                counts: dict[str, int] = {}
                for c in parent.children:
                    counts[nodes[c].tag] = counts.get(nodes[c].tag, 0) + 1
                parent.__dict__["_tags"] = counts
                parent.__dict__["_place"] = {c: k for k, c in enumerate(parent.children)}
                parent.__dict__["_text"] = sum(text[c] for c in parent.children)
                alike = counts[node.tag]
            place = parent.__dict__["_place"][i] / max(siblings - 1, 1)
            sibling_text, parent_text = parent.__dict__["_text"], text[p]
        above[i] = up
        t = max(text[i], 1)
        out.append([
            math.log1p(text[i]), math.log1p(node.own), math.log1p(elements[i]), text[i] / elements[i], links[i] / t,
            float(node.depth), float(place), math.log1p(siblings), alike / siblings if siblings else 0.0,
            text[i] / max(sibling_text, 1), text[i] / total, stops[i] / max(words[i], 1), words[i] / max(runs[i], 1),
            min(paragraphs[i] / t, 1.0), min(lists[i] / t, 1.0), float(controls[i]), float(good), float(bad),
            *map(float, up), node.start / total, text[i] / max(parent_text, 1),
            *(float(node.tag in tags) for tags in KINDS.values()),
        ])
    return out
