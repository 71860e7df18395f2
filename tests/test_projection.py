"""Cards and pages of notices: defaults, orders and odd rows."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import projection as P
from tidemark.operators import spread

NOW, START = datetime.datetime(2024, 5, 1, 3), datetime.date(2024, 1, 1)
NOTICES = """id long, title string, excerpt string, audience_note string, source long, url string, original_status string, pinned boolean, exempt boolean, published_date date, published_at timestamp,
precision string, first_visible timestamp, updated timestamp, deadline_date date, deadline_at timestamp, deadline_precision string, deadline_evidence string, body_text string, images array<string>"""
TABLES = {
    "sources": "id long, name string, last_checked timestamp",
    "categories": "notice long, code string, is_primary boolean",
    "audiences": "notice long, id string, type string, organization string, campus string",
    "campuses": "id string, name string",
    "organizations": "id string, name string",
    "links": "notice long, item string, source long, url string, published date, status string, is_primary boolean, is_active boolean",
}
ATTACHMENTS = "notice long, id string, filename string, kind string, size long, url string, status string"
MENTIONS = "notice long, id string, raw_text string, channel string, value string, contact long"


def notice(id, **more):
    return (id, *(more.get(c.strip().split()[0]) for c in NOTICES.replace("\n", " ").split(",")[1:]))


def tables(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), ddl) for k, ddl in TABLES.items()}


def cards(spark, notices, t):
    df = spark.createDataFrame(notices, NOTICES)
    return df, P.cards(df, *t.values(), F.lit(NOW), F.lit(START))


def test_bare_notice_has_defaults(spark):
    df, shown = cards(spark, [notice(1)], tables(spark))
    (r,) = shown.collect()
    assert tuple(r.primary_category) == ("other", "기타")
    assert (r.secondary_categories, r.audiences, r.source_count, r.published_precision, r.published_adjusted, r.deadline, r.original_status, r.is_pinned, r.poster_image) == ([], [], 0, "unknown", False, None, None, False, None)
    assert tuple(r.freshness) == ("unknown", "확인 정보 없음", None)
    (page,) = P.details(df, shown, spark.createDataFrame([], TABLES["sources"]), spark.createDataFrame([], TABLES["links"]), spark.createDataFrame([], ATTACHMENTS), spark.createDataFrame([], MENTIONS)).collect()
    assert (page.sources, page.attachments, page.contact_mentions, page.images, page.body_text) == ([], [], [], [], None)
    assert cards(spark, [], tables(spark))[1].collect() == []


def test_orders_and_names(spark):
    t = tables(
        spark,
        sources=[(7, "Z", NOW - datetime.timedelta(hours=4)), (8, "A", None)],
        categories=[(1, "zz", False), (1, "other", False), (1, "aa", None), (1, "event", False), (1, "career", True), (1, "academic", True)],
        audiences=[(1, "4", "strange", None, None), (1, "1", "university", None, None), (1, "3", "campus", None, "c2"), (1, "2", "campus", None, "c1"), (1, "6", "organization", "o2", None), (1, "5", "organization", "o1", "c1"), (1, "7", None, None, None)],
        campuses=[("c1", "South")],
        organizations=[("o2", "Office")],
        links=[(1, "b", 7, "u", None, "lost", None, True), (1, "a", 9, "u", None, None, False, True), (1, "z", 7, "u", START, "removed", True, True), (1, "c", 8, "u", None, "available", False, True), (1, "gone", 8, "u", None, "available", True, False)],
    )
    rows = [
        notice(1, source=7, original_status="restricted", published_date=datetime.date(2024, 6, 1), first_visible=datetime.datetime(2024, 4, 30, 20), deadline_date=START, deadline_precision="month", body_text="x" * 79, images=["p", "q"]),
        notice(2, source=None, pinned=True, exempt=True, published_date=datetime.date(2023, 1, 1), precision="date", deadline_date=START, deadline_precision="date", body_text="x" * 80, images=["p"]),
    ]
    df, shown = cards(spark, rows, t)
    one, two = sorted(shown.collect(), key=lambda r: r.id)
    assert tuple(one.primary_category) == ("academic", "학사")
    assert [c.code for c in one.secondary_categories] == ["event", "other", "aa", "zz"]
    assert [tuple(a) for a in one.audiences] == [
        ("organization", "o1", "조직"), ("organization", "o2", "Office"), ("campus", "c1", "South"), ("campus", "c2", "캠퍼스"), ("university", None, "대학 전체"), ("undetermined", None, "대상 미확정"), ("undetermined", None, "대상 미확정"),
    ]
    assert (tuple(one.primary_source), one.source_count, one.freshness.code, one.deadline, one.poster_image) == ((7, "Z"), 4, "delayed", None, "p")
    assert (one.published_date, one.published_precision, one.published_adjusted, one.original_published_date) == (datetime.date(2024, 5, 1), "datetime", True, datetime.date(2024, 6, 1))
    assert (two.published_date, two.published_adjusted, two.original_published_date, two.poster_image, two.is_pinned) == (START, True, datetime.date(2023, 1, 1), None, True)
    assert (two.deadline.date, two.deadline.precision) == (START, "date")
    files = [(1, "2", None, "file", 1, "u", "listed"), (1, "3", "b", "file", 1, "u", "odd"), (1, "1", None, "file", 1, "u", None)]
    said = [(1, "2", "t", None, "v", 5), (1, "1", "t", "fax", "", None), (1, "3", None, "email", "e", None)]
    got = {r.id: r for r in P.details(df, shown, t["sources"], t["links"], spark.createDataFrame(files, ATTACHMENTS), spark.createDataFrame(said, MENTIONS)).collect()}
    assert [(s.item, s.source_name) for s in got[1].sources] == [("z", "Z"), ("a", None), ("c", "A"), ("b", "Z")]
    assert [s.status and s.status.label for s in got[1].sources] == ["삭제 확인", None, "접근 가능", "lost"]
    assert [(a.id, a.status and a.status.label) for a in got[1].attachments] == [("1", None), ("2", "목록 확인됨"), ("3", "odd")]
    assert [(m.raw_text, m.channel and m.channel.kind.code) for m in got[1].contact_mentions] == [(None, "email"), ("t", None), ("t", "phone")]
    assert got[2].sources == []


def plan_of(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString().splitlines()


def test_lists_send_rows_without_labels(spark):
    t = tables(spark)
    df, shown = cards(spark, [notice(1)], t)
    page = P.details(df, shown, t["sources"], t["links"], spark.createDataFrame([], ATTACHMENTS), spark.createDataFrame([], MENTIONS))
    grouped = [x for x in plan_of(page, "sparkPlan") if "partial_collect_list" in x]  # what is sent
    assert grouped and not [x for x in grouped for label in ("전화", "목록 확인됨", "접근 가능") if label in x]


def test_card_counts_sources_without_a_list(spark):
    links = [(1, "a", 7, "u", None, "lost", None, True), (1, "b", None, "u", None, None, False, True), (1, "c", 7, "u", None, None, False, False), (2, "d", 8, "u", None, None, True, None)]
    t = tables(spark, links=links, sources=[(7, "Z", None)])
    shown = cards(spark, [notice(i) for i in (1, 2, 3)], t)[1]
    assert {r.id: r.source_count for r in shown.collect()} == {1: 2, 2: 0, 3: 0}
    assert sum("collect_list" in x for x in plan_of(shown)) == 2


def test_narrow_values_are_sent_to_all(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 1) for i in range(3000)] + [(3000, 2), (3001, None)], "i long, k long")
    values = spark.createDataFrame([(1, "one"), (3, "three")], "k long, name string")
    want = {i: "one" for i in range(3000)} | {3000: None, 3001: None}
    sent = spread.dealt_join(rows, values, "k", "left", narrow=True)
    assert any("strategy=broadcast" in x for x in plan_of(sent)) and {r.i: r.name for r in sent.collect()} == want
    monkeypatch.setattr(spread, "FEW", 1)
    assert {r.i: r.name for r in spread.dealt_join(rows, values, "k", "left", narrow=True).collect()} == want
