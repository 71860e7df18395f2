"""Kinds of boards, and pages of several character sets."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions import charset as C
from tidemark.operators import boards as B

TODAY = datetime.date(2024, 6, 30)
BOARDS = "id int, code string, coded boolean, label string, path array<string>"
POSTS = "board int, title string, published date"


def kinds(spark, boards, posts):
    got = B.board_kinds(spark.createDataFrame(boards, BOARDS), spark.createDataFrame(posts, POSTS), F.lit(TODAY)).collect()
    return {r.id: (r.kind, r.reason, r.confidence) for r in got}


def day(days):
    return TODAY - datetime.timedelta(days=days)


def test_each_rule(spark):
    cases = [
        ("BMSR00047", True, "공지", [], [("모집", 1)], ("excluded", "structure", "high")),
        ("BMSR00047", False, "공지", ["공지"], [("모집 신청", 1)], ("notice", "notice menu", "high")),
        (None, None, None, None, [], ("empty", "no posts", "high")),
        ("a", True, "공지", ["공지"], [("모집", 731)], ("dormant", "old posts", "high")),
        ("a", True, "공지", ["공지"], [("모집", 730)], ("notice", "notice menu", "medium")),
        ("a", True, "x", [], [("[R-7] 보고", None)], ("excluded", "report", "high")),
        ("a", True, "Photo 방", [], [("모집", 1)], ("news", "gallery", "high")),
        ("a", True, "x", ["학과  소식"], [("모집", 1)], ("news", "news menu", "high")),
        ("a", True, "특허", ["공지"], [("모집", 1)], ("archive", "records", "medium")),
        ("a", True, "Archive", ["공지"], [("모집", 1)], ("archive", "archive menu", "high")),
        ("a", True, "SEMINAR", [], [(None, None)], ("notice", "events", "medium")),
        ("a", True, "연혁", ["공지"], [("모집", 1)], ("archive", "static", "medium")),
        ("a", True, "연혁", ["공지"], [("모집 신청", 1)], ("notice", "notice menu", "high")),
        ("a", True, "x", [None], [("안내", 1)] * 5, ("unclear", "weak words", "low")),
        ("a", True, "x", [], [("책자", 1)] * 3, ("archive", "archive words", "medium")),
        ("a", True, "x", [], [("부고", 1)] * 3, ("news", "news words", "medium")),
        ("a", True, "x", [], [("합격", 1)] * 2, ("notice", "action words", "high")),
        ("a", True, "x", ["Community"], [("", 1)], ("unclear", "weak, mixed menu", "low")),
        ("a", True, "x", ["y"], [("합격", 1), ("", 1), ("", 1)], ("unclear", "weak", "low")),
    ]
    boards = [(i, *c[:4]) for i, c in enumerate(cases)]
    posts = [(i, t, None if d is None else day(d)) for i, c in enumerate(cases) for t, d in c[4]]
    assert kinds(spark, boards, posts) == {i: c[5] for i, c in enumerate(cases)}

    # the same from stored samples; what could not be reached stays as it was
    stored = [(i, *c[:4], [(t, None if d is None else day(d)) for t, d in c[4]] or None, "unclear", "weak", "low") for i, c in enumerate(cases)]
    stored.append((99, "a", True, "공지", ["공지"], [("모집 신청", day(1))], "unreachable", "closed", "high"))
    ddl = BOARDS + ", sample array<struct<title:string,published:date>>, kind string, reason string, confidence string"
    again = {r.id: (r.kind, r.reason, r.confidence) for r in B.rejudged(spark.createDataFrame(stored, ddl), F.lit(TODAY)).collect()}
    assert again == {i: c[5] for i, c in enumerate(cases)} | {99: ("unreachable", "closed", "high")}


def test_no_boards_and_strange_posts(spark):
    assert kinds(spark, [], [(1, "모집", day(1))]) == {}
    assert kinds(spark, [(1, "a", True, "x", [])], [(2, "모집", day(1)), (None, "모집", None)]) == {1: ("empty", "no posts", "high")}


def test_page_text(spark):
    korean = "장학 공지 똠"  # the last syllable is in cp949 only
    rows = [
        (korean.encode("utf-8"), None, korean),
        (korean.encode("cp949"), None, korean),
        (korean.encode("cp949"), "EUC-KR", korean),
        (korean.encode("utf-8"), "euc-kr", None),
        (b"<meta charset=ks_c_5601-1987>" + korean.encode("cp949"), "no-such-set", "<meta charset=ks_c_5601-1987>" + korean),
        (korean.encode("utf-8"), "ascii", korean),
        (b"\xff\xfe\xff", None, "���"),
        (b"", None, ""),
        (None, "utf-8", None),
    ]
    df = spark.createDataFrame([(i, b, d) for i, (b, d, _) in enumerate(rows)], "i int, body binary, declared string")
    got = {r.i: r.t for r in df.select("i", C.page_text(F.col("body"), F.col("declared")).alias("t")).collect()}
    for i, (body, declared, want) in enumerate(rows):
        if i == 3:  # the declared set is believed where it decodes
            try:
                want = body.decode("cp949")
            except UnicodeDecodeError:
                want = korean
        assert got[i] == want, i
