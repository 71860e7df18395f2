"""Main text of pages: hand-made pages, densities against the formula on a tree of another parser, the table against SQL, odd rows."""

import html as references
from html.parser import HTMLParser
from math import e, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html

SF = "/root/testdata/sf0.001"
LONG = "A sentence of the article that says something at some length, so that it is dense. "


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var x = '</p><article>no</article>';</script></head><body>{body}</body></html>"


ARTICLE = f"<h1>A &amp; B</h1><p>{LONG}<p>{LONG * 2}"
TEXT = ("A & B " + LONG * 3).strip()


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href=/>Home</a></ul></nav><article>{ARTICLE}</article><footer>&copy; us</footer>",
        f"<div class='site-header'>Brand</div><div id=wrap class='with-sidebar'><div class=content>{ARTICLE}</div><div class='sideBar'>{LONG * 9}</div></div>",
        f"<header><h2>Site</h2></header><main>{ARTICLE}</main><aside>{LONG * 9}</aside>",
        f"<article>{ARTICLE}<div class='ad-slot'>{LONG * 9}</div><form><p>{LONG}</p><input></form></article><section id=comments><article class=comment><p>{LONG * 9}</p></article></section>",
        f"<div class='sidebar-layout'><article class='post has-comments'><header>{ARTICLE}</header><section class='comment-list'><p>{LONG * 9}<p>{LONG * 9}</section></article></div>",
        f"<article>{ARTICLE}<article><p>{LONG * 5}</p></article></article><div class=cookieNotice><p>{LONG * 9}</div>",
        f"<div><div>{ARTICLE}</div></div><div>All rights kept.</div><ul><li><a href=1>{LONG}</a><li><a href=2>{LONG}</a></ul>",
        f"<h1>A &amp; B</h1><div><p>{LONG}</p><p>{LONG * 2}</p></div><div role=contentinfo>{LONG * 9}</div>",
        f"<div hidden>{LONG * 9}</div><div style='display: none'>{LONG * 9}</div><article>{ARTICLE}<style>p {{}}</style><!-- {LONG} --></article>",
        f"<article><h1>A &#38; B</h1><div><p><b>{LONG[:20]}<br></b>{LONG[20:]}<table><tr><td>{LONG}<td>{LONG}</table></div></article><p class=notice>{LONG * 9}",
        f"<article>{ARTICLE}</article>\n<div class=x9><p>{LONG}</p></div>",
    ],
)
def test_the_article_and_nothing_else(body):
    want = TEXT if "<br>" not in body else (TEXT[: TEXT.index(LONG) + 20].rstrip() + " " + LONG[20:].lstrip() + LONG * 2).strip()
    assert html.main_text(page(body)) == " ".join(want.split())


def test_text_of_blocks():
    assert html.main_text("<main><p>a<b>b</b>c <i> d</i>\n<span>e</span><br>f<img>g<script>no</script>h<hr>i<div></div>j") == "abc d e fgh i j"
    assert html.main_text("<main><ul><li>one<li>two</ul><dl><dt>t<dd>d</dl><p title='a > b' data=x>quoted</p a>&lt;b&gt; &amp&nbsp;x &am") == "one two t d quoted <b> & x &am"
    assert html.main_text("plain text, no tags; 1 < 2 and 3 > 2 <unclosed tag") == "plain text, no tags; 1 < 2 and 3 > 2"
    assert html.main_text("a<!-- x --><!doctype y><? z ?></>b<!-- to the end") == "ab"
    assert html.main_text("<head><title>t</title><p>body starts by itself") == "body starts by itself"
    assert html.main_text("</div></p>x</span><textarea><p>no</p></textarea>") == "x"
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><head><title>t</title></head><body></body></html>") == ""
    deep = "<main>" + "<div>" * 20_000 + "deep" + "</div>" * 10_000 + " end"
    assert html.main_text(deep) == "deep end"
    long = "<article>" + "<p>word</p>" * 100_000
    assert html.main_text(long).count("word") == 100_000


class Tree(HTMLParser):
    """A tree of dictionaries, for well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.root = {"name": "#page", "children": []}
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attributes):
        node = {"name": name, "children": []}
        self.stack[-1]["children"].append(node)
        self.stack.append(node)

    def handle_endtag(self, name):
        assert self.stack.pop()["name"] == name

    def handle_data(self, text):
        self.stack[-1]["children"].append(text)


def measures(node, in_link=False):
    """Characters, characters in links, tags, tags of links, own characters of the subtree, by recursion."""
    in_link |= node["name"] == "a"
    c = lc = t = lt = own = 0
    for x in node["children"]:
        if isinstance(x, str):
            n = sum(map(len, x.split()))
            c, lc, own = c + n, lc + n * in_link, own + n
        else:
            a = measures(x, in_link)
            link = in_link or x["name"] == "a"
            c, lc, t, lt = c + a[0], lc + a[1], t + a[2] + 1, lt + a[3] + link
    node["m"] = c, lc, t, lt, own, in_link
    return c, lc, t, lt


def density(c, lc, t, lt, body):
    if c == 0:
        return 0.0
    nlc, share = max(c - lc, 1), body[1] / max(body[0], 1)
    t, lt, lc = max(t, 1), max(lt, 1), max(lc, 1)
    return c / t * max(0.0, log(c / lc * t / lt)) / log(log(c / nlc * lc + share * c + e))


def test_densities_match_the_formula_on_another_tree():
    rng = np.random.default_rng(3)

    def build(depth):
        out = []
        for _ in range(int(rng.integers(1, 5))):
            kind = rng.choice(["div", "span", "a", "b", "text"]) if depth else "text"
            out.append("w" * int(rng.integers(1, 60)) if kind == "text" else f"<{kind}>{build(depth - 1)}</{kind}>")
        return " ".join(out)

    for _ in range(40):
        text = f"<html><body>{build(4)}</body></html>"
        tree = Tree(text).root
        measures(tree)
        body = tree["children"][0]["children"][0]
        flat, todo = [], [tree]
        while todo:
            n = todo.pop()
            flat.append(n)
            todo += [x for x in reversed(n["children"]) if not isinstance(x, str)]
        nodes, pieces = html.parse(text)
        html.prune(nodes)
        html.densities(nodes, [(k, references.unescape(s)) for k, s in pieces], 2)
        assert [n.name for n in nodes] == [n["name"] for n in flat]
        for got, want in zip(nodes, flat):
            c, lc, t, lt, own, link = want["m"]
            assert (got.chars, got.link, got.tags, got.link_tags) == (c, lc, t, lt)
            assert got.density == pytest.approx(density(c, lc, t, lt, body["m"]))
            parts = [density(*x["m"][:4], body["m"]) for x in want["children"] if not isinstance(x, str)]
            assert got.total == pytest.approx(sum(parts) + density(own, own * link, 1, int(link), body["m"]))


def test_the_largest_sum_and_the_threshold():
    """Without any marks: the densest part wins, a second part as dense as the path is added, thin ones are not."""
    parts = [f"<div><p>{LONG * 3}</p><p>{LONG * 3}</p><p>{LONG * 3}</p></div>", f"<div><p>{LONG * 4}</p><p>{LONG * 4}</p></div>"]
    links = "<ul>" + "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(30)) + "</ul>"
    text = html.main_text(page(f"{links}{parts[0]}<div><i>by</i> <i>us</i></div>{parts[1]}{links}"))
    assert text == (LONG * 17).strip()


def test_odd_rows(spark):
    kind = "page_id long, html string, text string, n_chars int"
    assert html.extracted(spark.createDataFrame([], kind))[0].count() == 0
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "<p>x", "c", 3), (3, "<p>é\U0001f600 &eacute;", None, None), (3, "<p>é\U0001f600 &eacute;", None, None)]
    got, text, size = html.extracted(spark.createDataFrame(rows, kind))
    assert got.columns[:4] == ["page_id", "html", "text", "n_chars"] and len(set(got.columns)) == 6
    found = sorted((r.page_id or 0, r.text or "", r[text], r[size]) for r in got.collect())
    assert found == [(0, "c", "x", 1), (1, "a", "", 0), (2, "b", "", 0), (3, "", "é\U0001f600 é", 4), (3, "", "é\U0001f600 é", 4)]


def test_query_matches_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = c.sql(html.OP13_SQL)
    got = html.op13_html(spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.where(F.col("n_chars") == 0).count() == 0
