"""What list and detail pages say of themselves, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}


def has_next(html: Column, page: Column) -> Column:
    """True if a link of the pager (an address with a ``page`` parameter) leads beyond ``page``; null html: false."""
    numbers = F.regexp_extract_all(F.replace(html, F.lit("&amp;"), F.lit("&")), F.lit(r'href="[^"]*[?&]page=(\d{1,9})(?!\d)'), 1)
    return F.coalesce(F.array_max(F.transform(numbers, lambda x: x.cast("int"))) > page, F.lit(False))


def is_pinned(number: Column, row_class: Column) -> Column:
    """True if a row is marked as a notice, or its number cell holds something else than a number."""
    plain = F.trim(F.replace(number, F.lit(","), F.lit("")))
    return F.coalesce(row_class.rlike(r"(?:^|[\s_-])notice(?:$|[\s_-])"), F.lit(False)) | F.coalesce((plain != "") & ~plain.rlike(r"^\d+$"), F.lit(False))


def attachments(html: Column) -> Column:
    """Files that a detail page links to: ``array<struct<name, kind, bytes, url>>``, one of each name (the first).

    A file is a link whose text is a name with an extension and maybe a size in parentheses. Addresses that run
    scripts are left out; a missing size is null; null html gives none.
    """
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s+href="[^"]*"[^>]*>[^<]*\.[a-z0-9]{1,5}\s*(?:\([\d.]+\s*[KMG]?B\))?\s*</a>'), 0)

    def one(link: Column) -> Column:
        text = F.regexp_extract(link, ">([^<]*)</", 1)
        name = F.trim(F.regexp_replace(text, r"(?i)\s*\([\d.]+\s*[KMG]?B\)\s*$", ""))
        amount = F.regexp_extract(text, r"(?i)\(([\d.]+)\s*[KMG]?B\)\s*$", 1).try_cast("double")
        unit = F.upper(F.regexp_extract(text, r"(?i)([KMG]?B)\)\s*$", 1))
        factor = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in UNITS.items()])
        url = F.regexp_extract(link, '(?i)href="([^"]*)"', 1)
        return F.struct(name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), F.floor(amount * factor).cast("long").alias("bytes"), url.alias("url"))

    files = F.filter(F.transform(links, one), lambda x: ~x["url"].rlike(r"(?i)^\s*javascript:"))
    first = F.transform(files, lambda x, i: F.struct(x.alias("x"), (F.array_position(F.transform(files, lambda y: y["name"]), x["name"]) == i + 1).alias("first")))
    return F.transform(F.filter(first, lambda x: x["first"]), lambda x: x["x"])


def host_candidates(site: Column, domain: str) -> Column:
    """Hosts that a site's id may stand for: it, and it without digits or a language mark at its end; sorted."""
    base = F.trim(site)
    digits = lambda c: F.regexp_replace(c, r"\d+$", "")
    language = lambda c: F.regexp_replace(c, "_(kor|eng|chi|jpn)$", "")
    forms = F.filter(F.array(base, digits(base), language(base), language(digits(base))), lambda x: x != "")
    hosts = F.array_sort(F.array_distinct(F.transform(forms, lambda x: F.concat(x, F.lit("." + domain)))))
    return F.when(base.rlike(r"^[\x00-\x7F]+$"), hosts).otherwise(F.array().cast("array<string>"))
