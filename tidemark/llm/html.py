"""HTML extraction: the main text of a page by composite text density (Sun, Song and Liao 2011)."""

from __future__ import annotations

import html
import re
from collections import Counter
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

# Element names of the HTML standard, and the words by which pages mark what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr dt dd li option optgroup legend".split()) | {"li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: start tag: open elements that it ends, and elements beyond which it ends none
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
}
P_SCOPE = frozenset("table td th caption button object html template".split())
DROPPED = frozenset("head nav footer aside form button select datalist input noscript template iframe object embed svg math canvas audio video map dialog menu search title script style textarea xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: words of class and id attributes
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adunit adsbygoogle sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation navi menu menus submenu topnav breadcrumb breadcrumbs crumbs pagination pager paging"
    " masthead topbar toolbar footer siteheader sidebar sidebars aside widget widgets related recommended share sharing social comment comments commentlist respond replies reply disqus"
    " cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox newsletter subscribe subscription signup signin login paywall search searchbox searchform disclaimer copyright skip hidden".split()
)
REMARKS = frozenset("comment comments commentlist respond reply replies disqus".split())
HEADERS = frozenset("header site-header top-header global-header".split())
IN_HEAD = frozenset("head meta link title style script base basefont bgsound noscript template".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]++|[A-Z]++(?![a-z])|\d++")


class Node:
    """An element: ``end`` is the number after its last descendant's, ``mark`` what its class or id says (1: no article, 2: remarks), ``holds`` 1 if an
    article of its own right lies within, 2 if a main element or a title does."""

    __slots__ = ("name", "parent", "dropped", "mark", "chars", "link", "tags", "link_tags", "own", "density", "total", "end", "holds")

    def __init__(self, name: str, parent: int, dropped: bool, mark: int):
        self.name, self.parent, self.dropped, self.mark = name, parent, dropped, mark
        self.chars = self.link = self.tags = self.link_tags = self.own = self.end = self.holds = 0
        self.density = self.total = 0.0


def marked(name: str, raw: str) -> tuple[bool, int]:
    """Whether attributes hide an element or give it a role outside the article, and its mark by class and id."""
    hides, words, header = False, [], False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in DROPPED_ROLES or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hides = True
        elif key in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in _WORDS.findall(token)]
                # has-sidebar, with-ads, no-comments say something of the page, not of this element
                if parts and parts[0] not in ("has", "with", "no", "without", "is", "not", "js"):
                    words += [*parts, "".join(parts)]
                    header |= token.lower() in HEADERS
    if name in ("html", "body", "main"):
        return hides and name == "main", 0
    return hides, 2 if not REMARKS.isdisjoint(words) else 1 if name != "article" and (header or not MARKS.isdisjoint(words)) else 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in order, each after its parent, and pieces of text with the number of their element. Tags close as in the HTML
    standard: paragraphs, list items and cells by what follows them, anything open by its parent's end; stray end tags are passed over."""
    nodes, pieces, stack, open_ = [Node("#page", -1, False, 0)], [], [0], Counter()
    at, size, lower = 0, len(page), None

    def close(depth: int) -> None:
        while len(stack) > depth:
            k = stack.pop()
            nodes[k].end = len(nodes)
            open_[nodes[k].name] -= 1
            edge(k)

    def edge(k: int) -> None:
        """The start or end of a block parts the text within it and around it."""
        if nodes[k].name in BLOCK:
            pieces.extend(((k, "\n"), (nodes[k].parent, "\n")))

    def text(s: str) -> None:
        if s:
            if open_["head"] and not s.isspace() and nodes[stack[-1]].name == "head":
                close(len(stack) - 1)
            pieces.append((stack[-1], s))

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            broken = re.compile("</?[A-Za-z]").search(page, at)  # a tag that never ends is no text
            text(page[at : broken.start() if broken else size])
            break
        text(page[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                text("\n")
            if open_[name] > 0 and name not in ("html", "body"):
                depth = next(d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].name == name)
                close(depth)
            continue
        if open_["head"] and name not in IN_HEAD:
            close(next(d for d in range(1, len(stack)) if nodes[stack[d]].name == "head"))
        if name in ("html", "body") and open_[name]:
            continue
        if name in IMPLIED or name in ENDS_P:
            ends, stops = IMPLIED.get(name, ((), ()))
            if any(open_[x] for x in ends):
                for d in range(len(stack) - 1, 0, -1):
                    if (n := nodes[stack[d]].name) in ends:
                        close(d)
                        break
                    if n in stops:
                        break
            if name in ENDS_P and open_["p"]:
                for d in range(len(stack) - 1, 0, -1):
                    if (n := nodes[stack[d]].name) == "p":
                        close(d)
                        break
                    if n in P_SCOPE:
                        break
        parent = nodes[stack[-1]]
        hides, mark = marked(name, m[3]) if m[3] else (False, 0)
        nodes.append(Node(name, stack[-1], parent.dropped or hides or name in DROPPED, mark))
        k = len(nodes) - 1
        edge(k)
        if name in RAW:
            lower = page.lower() if lower is None or len(lower) != size else lower
            end = lower.find(f"</{name}", at) if len(lower) == size else (re.compile(f"</{name}", re.I).search(page, at) or m).start()
            at = size if end < at else end
        if name in VOID:
            nodes[k].end = len(nodes)
            if name == "br":
                pieces.append((k, "\n"))
        else:
            stack.append(k)
            open_[name] += 1
    close(0)
    return nodes, pieces


def prune(nodes: list[Node]) -> None:
    """Drops what is marked as no part of an article, by its element, role, class or id; a page's header (not an article's own);
    articles within an article, which are remarks. An element that is marked as other than remarks stays if it holds the page's main element (a title, where a page has neither such nor an
    article) or an article of its own right; one marked as remarks if it holds one of the first two."""
    plain = not any(n.name in ("main", "article") for n in nodes)
    for n in nodes[1:]:
        n.dropped |= nodes[n.parent].dropped or n.name == "header" and not inside(nodes, n.parent, ("article", "main")) or n.name == "article" and inside(nodes, n.parent, ("article",)) > 0
        n.holds = 2 if n.name == "main" or n.name == "h1" and plain else int(n.name == "article" and not n.mark)
    for n in reversed(nodes[1:]):
        if not n.dropped:
            nodes[n.parent].holds = max(n.holds, nodes[n.parent].holds)
    for n in nodes[1:]:
        n.dropped |= nodes[n.parent].dropped or n.mark > n.holds


def inside(nodes: list[Node], k: int, names: tuple[str, ...]) -> int:
    """The nearest element of those names at or above ``k``, or 0."""
    while k > 0 and nodes[k].name not in names:
        k = nodes[k].parent
    return max(k, 0)


def densities(nodes: list[Node], pieces: list[tuple[int, str]], top: int) -> None:
    """For each element kept: characters and tags, those in links, the composite density

        C/T log(C/LC T/LT) / log(ln(C LC/NLC + LC_b/C_b C + e))

    with C characters, T tags, LC and LT those in links, NLC characters not in links, b the body; numbers of zero count as one. Text
    directly in an element counts as a child of one tag. ``total`` is the sum over children."""
    for k, s in pieces:
        n = nodes[k]
        if not n.dropped:
            n.own += sum(map(len, s.split()))
    links = [False] * len(nodes)
    for k, n in enumerate(nodes):
        links[k] = n.name == "a" or n.parent >= 0 and links[n.parent]
        n.chars += n.own
        n.link += n.own * links[k]
    for k in range(len(nodes) - 1, 0, -1):
        n, up = nodes[k], nodes[nodes[k].parent]
        if not n.dropped:
            up.chars += n.chars
            up.link += n.link
            up.tags += n.tags + 1
            up.link_tags += n.link_tags + links[k]
    share = nodes[top].link / max(nodes[top].chars, 1)

    def composite(chars: int, link: int, tags: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        tags = max(tags, 1)
        base = log(chars * max(link, 1) / max(chars - link, 1) + share * chars + e)
        return chars / tags * max(0.0, log(chars / max(link, 1) * tags / max(link_tags, 1))) / log(base)

    for k, n in enumerate(nodes):
        if not n.dropped:
            n.density = composite(n.chars, n.link, n.tags, n.link_tags)
            n.total += composite(n.own, n.own * links[k], 1, links[k])
            if k:
                nodes[n.parent].total += n.density


def chosen(nodes: list[Node], top: int) -> list[bool]:
    """Which elements' texts are the article: the subtree of the largest sum of densities; the threshold is the least density on its
    path from the body. An article or main element around it is taken whole. Else every other element that reaches the threshold
    gives the subtree of the largest sum within it, so that an article in several parts is found whole; headings directly before
    the largest subtree, or before what holds it, belong to it."""
    keep = [False] * len(nodes)
    inner = [k for k in range(top, nodes[top].end) if not nodes[k].dropped]
    best = max(inner, key=lambda k: (nodes[k].total, -k), default=top)
    own = inside(nodes, best, ("article",)) or inside(nodes, best, ("main",))
    if not own:  # around a single article with most of the text
        articles = [k for k in inner if best < k < nodes[best].end and nodes[k].name == "article"]
        if len(articles) == 1 and 2 * nodes[articles[0]].chars >= nodes[best].chars:
            own = articles[0]
    path = _path(nodes, best, top)
    threshold = min((nodes[k].density for k in (*path, top)), default=0.0)
    spans = []
    if own:
        spans.append((own, nodes[own].end))
    else:
        # the subtree of the largest sum below each element, ties to the outer one
        most = list(range(len(nodes)))
        for k in reversed(inner):
            p = nodes[k].parent
            if k > top and nodes[most[k]].total > nodes[most[p]].total:
                most[p] = most[k]
        spans += [(most[k], nodes[most[k]].end) for k in inner if k != top and k not in path and nodes[k].name in BLOCK and nodes[k].density >= threshold > 0]
        spans.append((best, nodes[best].end))
        for k in path:
            before = k - 1
            while before > top and nodes[before].parent != nodes[k].parent:
                before = nodes[before].parent
            if before > top and nodes[before].name in HEADINGS:
                spans.append((before, k))
    for lo, hi in spans:
        for k in range(lo, hi):
            keep[k] = not nodes[k].dropped
    return keep


def _path(nodes: list[Node], k: int, top: int) -> set[int]:
    out = set()
    while k > top:
        out.add(k)
        k = nodes[k].parent
    return out


def main_text(page: str | None) -> str:
    """The article of a page as text: character references decoded, white space within a block one space, blocks in order with one
    space between them; empty where the page holds none. Null is an empty page."""
    if not page:
        return ""
    nodes, raw = parse(page)
    pieces = [(k, html.unescape(s)) for k, s in raw]
    prune(nodes)
    top = next((k for k, n in enumerate(nodes) if n.name == "body"), 0)
    densities(nodes, pieces, top)
    keep = chosen(nodes, top)
    return " ".join("".join(s for k, s in pieces if keep[k]).split())


def extracted(pages: DataFrame, html_column: str = "html") -> tuple[DataFrame, str, str]:
    """``pages`` with two more columns, whose names are returned: the main text and its number of code points. All columns and rows are kept,
    repeated rows too; null and empty html give an empty text and 0. A page is one task's, its whole text is read; no rows: no rows."""
    text, size = fresh(pages, "text"), fresh(pages, "n_chars")

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], type=pa.string())

    got = pages.withColumn(text, run(F.col(html_column)))
    return got.withColumn(size, F.char_length(text).cast("long")), text, size


def op13_html(spark, sf_dir: str) -> DataFrame:
    got, text, size = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col(text).alias("text"), F.col(size).alias("n_chars"))


#: what the method must find on pages whose article is marked as such and holds no other marked parts, as the table's are
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br|div|ul|li)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
