"""Title, body and search-text expressions. All are built-in functions unless the name ends in ``_udf``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What these rules must match.
PUNCTUATION = "[\\[\\]()（）【】<>《》「」·・,.!?~\\-_/\\\\|:;\"'`]+"
BOILERPLATE = r"^((붙임|첨부|아래|다음)\s*(파일|참조|참고|와\s*같습니다)?[\s.]*|\s*)$"
YEAR_MARK = r"(20\d{2})\s*(?:학년도|년도|년)"
ROUND_MARK = r"(\d{1,2})\s*(?:차|기|회)(?![를을])"
SEMESTER_MARK = r"([12])\s*학기"
DEPARTMENT_SUFFIX = "(학과|학부|전공|과|학)$"
FINGERPRINT_CHARS = 40


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_title(c: Column) -> Column:
    """Punctuation to blanks, blanks collapsed, lower case; null counts as empty."""
    return F.lower(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), PUNCTUATION, " ")))


@F.pandas_udf(StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def search_text(c: Column, compatible: bool = True) -> Column:
    """Text as search sees it: lower-case letters, digits and Hangul, single blanks between.
    ``compatible=False`` leaves out Unicode compatibility folding, which alone needs Python."""
    folded = nfkc_udf(c) if compatible else c
    return F.trim(F.regexp_replace(F.lower(folded), "[^0-9a-z가-힣]+", " "))


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def trigrams(c: Column) -> Column:
    """The set of three-character runs of a text with two blanks before and one after."""
    chars = F.split(F.concat(F.lit("  "), c, F.lit(" ")), "")
    # bound to a name by the outer transform, else the whole of it would be worked out for each run
    runs = F.transform(F.array(chars), lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.concat(t[i], t[i + 1], t[i + 2])))
    return F.array_distinct(runs[0])


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def body_fingerprint(c: Column) -> Column:
    """SHA-256 of the lines that say something, null if they have fewer than FINGERPRINT_CHARS characters."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), lambda x: ~F.trim(x).rlike(BOILERPLATE))
    text = collapse(F.array_join(lines, " "))
    return F.when(F.length(text) >= FINGERPRINT_CHARS, F.sha2(text, 256))


def content_hash(title: Column, body: Column, attachments: Column) -> Column:
    """``attachments``: array of (filename, url, size_bytes); their order does not matter."""
    files = F.array_join(F.array_sort(F.transform(attachments, lambda a: F.concat_ws("\x1f", *(F.coalesce(a[k].cast("string"), F.lit("")) for k in ("filename", "url", "size_bytes"))))), "\x1e")
    return F.sha2(F.concat_ws("\x1d", normalize_title(title), collapse(F.coalesce(body, F.lit(""))), files), 256)


def markers(c: Column, pattern: str) -> Column:
    """All values of one kind of marker (year, round, semester) in a text, as a set."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 1))


def excerpt(c: Column, limit: int = 180) -> Column:
    """The first ``limit`` characters, cut at the last blank if it lies in the second half."""
    text = collapse(F.coalesce(c, F.lit("")))
    head = F.substring(text, 1, limit)
    cut = F.length(F.regexp_extract(head, "^(.*) [^ ]*$", 1))
    short = F.when(cut > limit // 2, F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def slug(c: Column, limit: int = 24) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(s == "", F.lit("x")).otherwise(s)


def strip_invisible(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "[​‌‍⁠﻿ ]", " "))


def department_key(c: Column) -> Column:
    return F.regexp_replace(compact(search_text(c, compatible=False)), DEPARTMENT_SUFFIX, "")


def host_group(host: Column) -> Column:
    """The last three labels of a host, which share one rate limit."""
    labels = F.split(F.lower(host), r"\.")
    return F.when(F.size(labels) > 3, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.lower(host))


def file_size(c: Column) -> Column:
    one = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, one(c / 1024, " KB")).otherwise(one(c / (1024 * 1024), " MB"))


# What failures of detail pages are called, by their words.
DETAIL_KINDS = (("권한/로그인 필요", "권한이 없|로그인"), ("원문 없음", "찾을 수 없|삭제|404"), ("본문 추출 실패", "본문|추출|구조"))


def error_kind(message: Column) -> Column:
    """``[kind]`` at the start of a message, else what its words say, else its first 60 characters."""
    text = collapse(message)
    kind = F.regexp_extract(text, r"^\[([a-z_]+)\]", 1)
    return F.coalesce(F.when(kind != "", kind), *(F.when(text.rlike(p), F.lit(label)) for label, p in DETAIL_KINDS), F.substring(text, 1, 60))


def audience_key(kind: Column, ident: Column) -> Column:
    return F.when(kind.isin("university", "undetermined"), kind).when(kind == "campus", F.concat(F.lit("campus:"), ident)).otherwise(F.concat(F.lit("org:"), ident))


# Notations of telephone numbers, and what stands before them, by campus.
FULL_NUMBER = r"^(\d{2,4}-\d{3,4}-\d{4}|(15|16|18)\d{2}-\d{4})$"
SHORT_NUMBER = r"^(?:(\d{3,4})-)?(\d{3,4})(?:~(\d{1,4}))?$"
AREA = {"seoul": "02-961", "global": "031-201"}
PREFIX = {"seoul": "02", "global": "031"}
NUMBER_LINE = r"^(\d{2,4}-)?\d{3,4}(~\d{1,4})?(\s*[,/]\s*(\d{2,4}-)?\d{3,4}(~\d{1,4})?)*$"


def phone_numbers(c: Column, campus: str, span: int = 20) -> Column:
    """All full numbers of a list like ``958-4616, 4630`` or ``0053~4/0057``: an exchange once given holds for the short
    numbers after it, up to the next full one; ranges of at most ``span`` steps are spelled out, width is kept."""
    text_array = F.array().cast("array<string>")

    def step(held, part):
        given, base, end = (F.regexp_extract(part, SHORT_NUMBER, k) for k in (1, 2, 3))
        full = part.rlike(FULL_NUMBER)
        pre = F.when(full, F.lit("")).when(given != "", given).otherwise(held["pre"])
        last = F.when(F.length(end) < F.length(base), F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(end)), end)).otherwise(end)
        a, b = base.try_cast("int"), last.try_cast("int")
        wide = lambda n: F.when(F.length(n.cast("string")) >= F.length(base), n.cast("string")).otherwise(F.lpad(n.cast("string"), F.length(base), "0"))
        several = F.coalesce((b > a) & (b - a <= span), F.lit(False))
        own = F.when(several, F.transform(F.sequence(F.when(several, a).otherwise(0), F.when(several, b).otherwise(0)), wide)).otherwise(F.array(base))
        head = F.when(pre != "", F.concat(F.lit(PREFIX[campus] + "-"), pre)).otherwise(F.lit(AREA[campus]))
        found = F.when(full, F.array(part)).when(part.rlike(SHORT_NUMBER), F.transform(own, lambda n: F.concat(head, F.lit("-"), n))).otherwise(text_array)
        return F.struct(pre.alias("pre"), F.concat(held["out"], found).alias("out"))

    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,/]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(parts, F.struct(F.lit("").alias("pre"), text_array.alias("out")), step, lambda held: held["out"])


def is_number_line(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("")).rlike(NUMBER_LINE)


def dial_label(value: Column, extension: Column, shown: Column) -> Column:
    """The full number, with the tail that the display puts after the extension."""
    tail = F.substring(shown, F.length(extension) + 1, F.length(shown))
    return F.when(F.coalesce(value, F.lit("")) == "", shown).when(F.coalesce(shown.startswith(extension) & (shown != extension), F.lit(False)), F.concat(value, tail)).otherwise(value)


# What site names carry besides the name, in the order in which it is taken off, and endings that tell an organization's kind.
NAME_NOISE = (
    (r"(?i)</?br\s*/?>", " "), (r"\s+", " "), (r"\s*\((국문|영문|중문|일문|한글|영어)\)\s*$", ""), (r"\s*\((개발중|준비중|임시|테스트)\)\s*$", ""),
    (r"(학부|학과|대학원|대학)\s*\d{2}\s*$", "$1"), (r"\s*\([^()]*(관|홀|동|호|층|캠퍼스\s*내)\s*\)\s*$", ""),
)
DEPARTMENT_NAME, OFFICE_NAME = r"(학과|학부|전공|계열)\s*$", r"(처|팀|본부|센터|지원단|사업단|위원회|대학본부)\s*$"
SITE_KINDS = {"COLLEGE": "college", "GRADUATE": "college", "ATTACHED": "institute", "ETC": "office"}


def site_name(raw: Column) -> Column:
    """A site's name without line breaks, languages, states, versions and addresses; empty for null."""
    out = F.coalesce(raw, F.lit(""))
    for pattern, to in NAME_NOISE:
        out = F.trim(F.regexp_replace(out, pattern, to))
    return out


def organization_kind(name: Column, site_kind: Column) -> Column:
    """By how the name ends, else by the kind of its site, else an institute."""
    known = F.create_map(*(F.lit(x) for kv in SITE_KINDS.items() for x in kv))
    return F.when(name.rlike(DEPARTMENT_NAME), "department").when(name.rlike(OFFICE_NAME), "office").otherwise(F.coalesce(F.try_element_at(known, F.coalesce(site_kind, F.lit(""))), F.lit("institute")))
