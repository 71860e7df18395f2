"""Notices as served: the card of a list and the whole page, with their nested lists in fixed orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import html as H

from .spread import dealt_join

# Codes with their labels, in the order in which they are listed.
CATEGORIES = {
    "academic": "학사",
    "graduation": "졸업",
    "scholarship": "장학",
    "career": "취업·인턴",
    "startup": "창업",
    "program": "프로그램·공모전",
    "international": "국제",
    "event": "행사",
    "student_council": "학생회",
    "campus_life": "생활",
    "other": "기타",
}
STATUSES = {"available": "접근 가능", "unavailable": "확인 불가", "restricted": "로그인 필요", "removed": "삭제 확인"}
FRESHNESS = {"fresh": "최근 확인됨", "delayed": "확인 지연", "stale": "오래 확인되지 않음", "unknown": "확인 정보 없음"}
CHANNELS = {"phone": "전화", "email": "이메일", "fax": "팩스", "website": "공식 링크"}
AUDIENCES = {"organization": "조직", "campus": "캠퍼스", "university": "대학 전체", "undetermined": "대상 미확정"}
LISTED = {"listed": "목록 확인됨"}


def coded(labels: dict[str, str], code: Column) -> Column:
    """``struct<code, label>``; a code without a label is its own, a null code gives null."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce(F.try_element_at(known, code), code).alias("label")))


def rank(labels: dict[str, str], code: Column) -> Column:
    """The place of a code in its list; unknown ones come last."""
    found = F.array_position(F.array(*map(F.lit, labels)), code)
    return F.when(found > 0, found).otherwise(len(labels) + 1)


def _listed(rows: DataFrame, key: str, columns: list[str], order: Callable[[Column], list[Column]], item: Callable[[Column], Column], name: str) -> DataFrame:
    """One sorted list per notice: as long as the page that shows it. Only ``columns`` are sent; ``order`` and ``item`` are made of a row when the list is whole."""

    def made(x: Column) -> Column:
        keys = [F.coalesce(c.cast("string"), F.lit("")) if i else c for i, c in enumerate(order(x))]
        return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), item(x).alias("item"))

    got = rows.groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return got.select("id", F.transform(F.array_sort(F.transform("_rows", made)), lambda x: x["item"]).alias(name))


def audience_lists(audiences: DataFrame, campuses: DataFrame, organizations: DataFrame) -> DataFrame:
    """``audiences(notice, id, type, organization, campus)`` to ``(id, audiences)``: by type, then ids. Names come from ``campuses(id, name)`` and
    ``organizations(id, name)``, or are the type's own where there is none; other types are undetermined."""
    a = dealt_join(audiences, organizations.select(F.col("id").alias("organization"), F.col("name").alias("_o")), "organization", "left", narrow=True)
    a = dealt_join(a, campuses.select(F.col("id").alias("campus"), F.col("name").alias("_c")), "campus", "left", narrow=True)
    t = F.col("type")
    a = a.withColumn("_name", F.when(t == "campus", F.col("_c")).when(t == "organization", F.col("_o")))

    def item(x: Column) -> Column:
        t = x["type"]
        kind = F.when(t.isin("university", "campus", "organization"), t).otherwise("undetermined")
        of = F.when(t == "campus", x["campus"]).when(t == "organization", x["organization"])
        return F.struct(kind.alias("type"), of.alias("id"), F.coalesce(x["_name"], coded(AUDIENCES, kind)["label"]).alias("name"))

    return _listed(a, "notice", ["type", "organization", "campus", "id", "_name"], lambda x: [rank(AUDIENCES, x["type"]), x["organization"], x["campus"], x["id"]], item, "audiences")


def category_lists(categories: DataFrame) -> DataFrame:
    """``categories(notice, code, is_primary)`` to ``(id, primary_code, secondary)``: the others in the order of the list, then by code."""
    c, main = F.col("code"), F.coalesce("is_primary", F.lit(False))
    key = F.struct(rank(CATEGORIES, c).alias("rank"), c.alias("code"))
    others = F.array_sort(F.collect_list(F.when(~main, key)))
    got = categories.groupBy(F.col("notice").alias("id")).agg(F.min(F.when(main, key))["code"].alias("primary_code"), others.alias("others"))
    return got.select("id", "primary_code", F.transform("others", lambda x: coded(CATEGORIES, x["code"])).alias("secondary"))


def source_lists(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Active ``links(notice, item, source, url, published, status, is_primary, is_active)`` to ``(id, sources)``: the primary one first, then by
    the source's name and the item."""
    l = dealt_join(links.where("is_active"), sources.select(F.col("id").alias("source"), F.col("name").alias("source_name")), "source", "left", narrow=True)
    l = l.withColumn("is_primary", F.coalesce("is_primary", F.lit(False)))
    columns = ["item", "source", "source_name", "url", "published", "status", "is_primary"]
    item = lambda x: F.struct(*((coded(STATUSES, x[c]) if c == "status" else x[c]).alias(c) for c in columns))
    return _listed(l, "notice", columns, lambda x: [~x["is_primary"], x["source_name"], x["item"]], item, "sources")


def source_counts(links: DataFrame) -> DataFrame:
    """Active ``links`` to ``(id, source_count)``."""
    return links.where("is_active").groupBy(F.col("notice").alias("id")).agg(F.count("*").alias("source_count"))


def cards(notices: DataFrame, sources: DataFrame, categories: DataFrame, audiences: DataFrame, campuses: DataFrame, organizations: DataFrame, links: DataFrame, now: Column, start: Column) -> DataFrame:
    """A notice's card, one row each.

    ``notices(id, title, excerpt, audience_note, source, url, original_status, pinned, exempt, published_date, published_at, precision, first_visible,
    updated, deadline_date, deadline_at, deadline_precision, deadline_evidence, body_text, images array<string>)``; ``sources(id, name,
    last_checked)``; the rest as of the lists above. What is shown of the publication may be adjusted, then the source's own is told too; without a main category it is ``other``;
    a deadline without a date or of another precision than a day or a moment is none; lists without rows are empty. The lists are grouped by
    the notice's id, which the notices are joined by: one partitioning serves all.
    """
    n = dealt_join(notices, sources.select(F.col("id").alias("source"), F.col("name").alias("_name"), "last_checked"), "source", "left", narrow=True)
    for lists in (category_lists(categories), audience_lists(audiences, campuses, organizations), source_counts(links)):
        n = n.join(lists, "id", "left")
    n = n.withColumn("_p", D.display_published(F.col("published_date"), F.col("published_at"), F.col("precision"), F.coalesce("pinned", F.lit(False)), F.coalesce("exempt", F.lit(False)), F.col("first_visible"), now, start))
    fixed = F.col("_p.adjusted")
    due = F.col("deadline_date").isNotNull() & F.col("deadline_precision").isin("date", "datetime")
    deadline = F.struct(F.col("deadline_date").alias("date"), F.col("deadline_at").alias("at"), F.col("deadline_precision").alias("precision"), F.col("deadline_evidence").alias("evidence"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return n.select(
        "id", "title", "excerpt",
        coded(CATEGORIES, F.coalesce("primary_code", F.lit("other"))).alias("primary_category"),
        empty("secondary", "array<struct<code:string,label:string>>").alias("secondary_categories"),
        empty("audiences", "array<struct<type:string,id:string,name:string>>").alias("audiences"),
        "audience_note",
        F.struct(F.col("source").alias("id"), F.col("_name").alias("name")).alias("primary_source"),
        F.coalesce("source_count", F.lit(0).cast("long")).alias("source_count"),
        F.col("_p.date").alias("published_date"), F.col("_p.at").alias("published_at"), F.col("_p.precision").alias("published_precision"), fixed.alias("published_adjusted"),
        F.when(fixed, F.col("published_date")).alias("original_published_date"), F.when(fixed, F.col("published_at")).alias("original_published_at"),
        F.col("first_visible").alias("first_visible_at"), F.col("updated").alias("updated_at"),
        F.when(due, deadline).alias("deadline"),
        F.col("url").alias("original_url"), coded(STATUSES, F.col("original_status")).alias("original_status"),
        F.struct(*(coded(FRESHNESS, D.freshness(F.col("last_checked"), now))[c].alias(c) for c in ("code", "label")), F.col("last_checked").alias("last_checked_at")).alias("freshness"),
        F.coalesce("pinned", F.lit(False)).alias("is_pinned"),
        H.poster_image(F.coalesce("body_text", F.lit("")), F.coalesce("images", F.array().cast("array<string>"))).alias("poster_image"),
    )


def details(notices: DataFrame, shown: DataFrame, sources: DataFrame, links: DataFrame, attachments: DataFrame, mentions: DataFrame) -> DataFrame:
    """The page of each notice: its card (``shown``, of :func:`cards`) with the body, pictures and three lists.

    ``attachments(notice, id, filename, kind, size, url, status)`` by name and id; ``links`` as of :func:`source_lists`; ``mentions(notice, id, raw_text,
    channel, value, contact)`` by text and id, with a channel where there is a value (a phone's, if no kind is given). Lists without rows are empty.
    """
    has = ["id", "filename", "kind", "size", "url", "status"]
    file = lambda x: F.struct(*((coded(LISTED, x[c]) if c == "status" else x[c]).alias(c) for c in has))
    files = _listed(attachments, "notice", has, lambda x: [F.coalesce(x["filename"], F.lit("")), x["id"]], file, "attachments")

    def mention(x: Column) -> Column:
        channel = F.when(x["value"] != "", F.struct(x["id"].alias("id"), coded(CHANNELS, F.coalesce(x["channel"], F.lit("phone"))).alias("kind"), x["value"].alias("value")))
        return F.struct(x["raw_text"].alias("raw_text"), channel.alias("channel"), x["contact"].alias("contact"))

    said = _listed(mentions, "notice", ["id", "raw_text", "channel", "value", "contact"], lambda x: [F.coalesce(x["raw_text"], F.lit("")), x["id"]], mention, "contact_mentions")
    got = shown.join(notices.select("id", "body_text", F.coalesce("images", F.array().cast("array<string>")).alias("images")), "id")
    for lists in (source_lists(links, sources), files, said):
        got = got.join(lists, "id", "left")
    return got.withColumns({c: F.coalesce(c, F.array().cast(got.schema[c].dataType)) for c in ("sources", "attachments", "contact_mentions")})
