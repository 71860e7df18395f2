"""HTML helpers on the standard parser. Rows stay in Spark; each helper sees one document."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
DROPPED = frozenset("script style noscript iframe object embed form head title".split())
KEPT = frozenset("a b blockquote br em h3 h4 hr i img li ol p strong table tbody td th thead tr u ul".split())
VOID = frozenset("br hr img".split())


class _Walk(HTMLParser):
    def __init__(self, secure_links: bool = False):
        super().__init__(convert_charrefs=True)
        self.text, self.clean, self.hidden, self.images, self.links, self.secure = [], [], 0, [], [], secure_links

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.hidden += 1
        if self.hidden:
            return
        if tag in BLOCKS:
            self.text.append("\n")
        if tag in ("td", "th"):
            self.text.append("\t")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "img" and (src := (a.get("src") or "").strip()):
            self.images.append(src)
        if tag in KEPT:
            self.clean.append(f"<{tag}{self._attributes(tag, a)}>")

    def _attributes(self, tag, a) -> str:
        link = (a.get("href" if tag == "a" else "src") or "").strip()
        if tag not in ("a", "img") or not re.match("https?://|/(?!/)", link, re.I):
            return ""
        if self.secure:
            link = re.sub("^http://", "https://", link, flags=re.I)
        name = "href" if tag == "a" else "src"
        extra = ' target="_blank" rel="noopener noreferrer"' if self.secure and tag == "a" else ""
        return f' {name}="{escape(link)}"{extra}'

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in DROPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden:
            if tag in BLOCKS:
                self.text.append("\n")
            if tag in KEPT and tag not in VOID:
                self.clean.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            self.clean.append(escape(data, quote=False))


def _walk(html: str | None, secure: bool = False) -> _Walk:
    w = _Walk(secure)
    w.feed(html or "")
    w.close()
    return w


def _text(html: str | None) -> str:
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(_walk(html).text).split("\n"))
    return "\n".join(x for x in lines if x)


# Pages may be large, so these take rows in small batches (a hundred), not in Arrow batches of ten thousand.


@F.udf(StringType(), useArrow=False)
def html_text_udf(html: str | None) -> str:
    """Visible text: blocks on lines of their own, blanks collapsed, empty lines left out."""
    return _text(html)


@F.udf(StringType(), useArrow=False)
def sanitize_udf(html: str | None) -> str:
    """Allowed tags only; scripts and the like go with their content, other tags leave theirs."""
    return "".join(_walk(html).clean).strip()


@F.udf(StringType(), useArrow=False)
def publish_html_udf(html: str | None) -> str:
    """As ``sanitize_udf``, with links made secure and opened apart."""
    return "".join(_walk(html, True).clean).strip()


@F.udf(ArrayType(StringType()), useArrow=False)
def images_udf(html: str | None) -> list[str]:
    return _walk(html).images


def anchors(html: Column) -> Column:
    """Array of (href, label) of all links, by expressions alone."""
    pattern = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("label"))


def image_sources(html: Column) -> Column:
    """Addresses of a page's pictures, by expressions alone."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<img\s[^>]*src="([^"]+)"'), 1)


#: characters of text from which on a notice needs no picture in a list
POSTER_CHARS = 80


def poster_image(text: Column, images: Column) -> Column:
    """The picture that stands for a notice in a list: the first, if there is next to no text beside it."""
    wordy = F.coalesce(F.length(F.trim(text)) >= POSTER_CHARS, F.lit(False))
    return F.when((F.size(images) > 0) & ~wordy, F.get(images, F.lit(0)))
