"""Odd rows of what is served."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import serving as S

NOW = datetime.datetime(2024, 1, 2)


def test_listed_keeps_fresh_moments_and_adds_stubs(spark):
    kind = "id int, last_seen timestamp, status string, streak int, pinned boolean"
    later, old = datetime.datetime(2024, 1, 3), datetime.datetime(2023, 1, 1)
    stored = spark.createDataFrame([(1, later, "available", 0, False), (2, old, "missing", 3, True), (3, None, None, None, None), (4, old, "missing", 2, True)], kind)
    listing = spark.createDataFrame([(1, False), (2, False), (3, None), (5, True)], "id int, pinned boolean")
    got = {r.id: tuple(r)[1:] for r in S.listed(stored, listing, F.lit("2024-01-02").cast("timestamp"), "1 DAY").collect()}
    touched = (NOW, "available", 0, False, True)
    assert got == {1: (later, "available", 0, False, False), 2: touched, 3: touched, 4: (old, "missing", 2, True, False), 5: (NOW, "available", 0, True, True)}


def test_category_rows_of_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", ["a", None, "b", "b"])], "id int, main string, others array<string>")
    assert sorted(tuple(r) for r in S.category_rows(rows).collect()) == [(1, "a", True), (2, "a", True), (2, "b", False)]


def test_department_without_a_key_or_with_two_roots(spark):
    organizations = spark.createDataFrame([(1, "물리학과", True, 1), (2, "물리학부", True, 1), (3, "화학과", True, 3), (4, "화학부", True, 4), (5, "미학", True, 5)], "id int, name string, is_department boolean, root int")
    wanted = spark.createDataFrame([("물리전공",), ("화학과",), ("미과",), (None,)], "name string")
    assert sorted((r.name, r.id) for r in S.department_organizations(wanted, organizations).collect()) == [("물리전공", 1), ("물리전공", 2), ("화학과", 3)]


def test_missing_freshness_is_an_error(spark):
    rows, known = spark.createDataFrame([(1,), (2,)], "source int"), spark.createDataFrame([(1, "fresh", 0)], "source int, code string, checked int")
    with pytest.raises(Exception, match="no freshness of source 2"):
        S.with_freshness(rows, known).collect()


def test_pages_and_cards_of_nulls(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, None), (2, 2, "b")], "feed int, page int, revision string")
    assert sorted((r.feed, r.page) for r in S.consistent_pages(pages).collect()) == [(1, 1), (2, 1), (2, 2)]
    assert S.consistent_pages(pages.limit(0)).count() == 0
    asked = spark.createDataFrame([(None,), ("",), ("Grad uation",)], "q string")
    assert [r[0] for r in asked.select(S.matches_card(F.col("q"), F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("graduation")))).collect()] == [False, False, True]
