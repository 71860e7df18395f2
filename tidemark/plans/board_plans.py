"""Boards judged by their posts, and pages decoded."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.functions import charset as C
from tidemark.operators import boards as B

from .binding import query, read

TODAY = "2001-12-31"
LABELS = [("공지사항", "커뮤니티"), ("Outgoing Program", "Announcement"), ("갤러리", "커뮤니티"), ("pr  room", "소개"), ("우수성과", "연구"), ("기출 문제", "공지"), ("Colloquium", "학술"), ("교육과정", "학부"), ("이야기", "커뮤니티"), ("이야기", "소개"), ("재학생 소식", "소개"), ("이야기", "마당")]
TITLES = ["장학생 모집 안내", "수강신청 일정 변경", "협약 체결", "수상 후기", "규정 서식", "논문집 백서", "이용 안내", "인사", "Apply now: application deadline", "개최  결과", "[SDG 4] 실적", "안내문"]
#: which titles boards of one kind use: from where in TITLES, and how many
RANGES = [(0, 2), (2, 2), (4, 2), (6, 1), (6, 2), (0, 10), (10, 1), (7, 1), (8, 1)]


def today():
    return F.to_date(F.lit(TODAY))


def boards(spark, d):
    """Customers as boards; labels and menus are planted."""
    k, pairs = F.col("c_custkey"), F.array(*(F.struct(F.lit(l).alias("label"), F.lit(m).alias("menu")) for l, m in LABELS))
    c = read(spark, d, "customer").withColumn("_l", pairs[F.pmod(k, F.lit(len(LABELS))).cast("int")])
    code = F.when(k % 37 == 0, B.NEVER_NOTICES[0]).otherwise("BMSR00040")
    return c.select(k.alias("id"), code.alias("code"), (k % 2 == 1).alias("coded"), F.col("_l.label").alias("label"), F.array("_l.menu", "c_mktsegment").alias("path"))


def posts(spark, d):
    """Orders as posts of their customers' boards; titles are planted."""
    k = F.col("o_custkey")
    span = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in RANGES))[F.pmod(k, F.lit(len(RANGES))).cast("int")]
    title = F.array(*map(F.lit, TITLES))[(span["a"] + F.pmod(F.col("o_orderkey"), span["n"])).cast("int")]
    return read(spark, d, "orders").where(k % 23 != 0).select(k.alias("board"), F.concat_ws(" ", title, "o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("published"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


BOARDS_SQL = f"""boards AS (SELECT c_custkey AS id, c_custkey % 37 = 0 AND c_custkey % 2 = 1 AS never, ({_list([x for x, _ in LABELS])})[c_custkey % {len(LABELS)} + 1] AS label,
  ({_list([x for _, x in LABELS])})[c_custkey % {len(LABELS)} + 1] AS menu, c_mktsegment AS segment FROM customer),
posts AS (SELECT o_custkey AS board, ({_list(TITLES)})[({[a for a, _ in RANGES]})[o_custkey % {len(RANGES)} + 1] + o_orderkey % ({[n for _, n in RANGES]})[o_custkey % {len(RANGES)} + 1] + 1] || ' ' || o_orderpriority AS title,
  CAST(o_orderdate AS DATE) AS published, o_orderkey AS post FROM orders WHERE o_custkey % 23 <> 0)"""


def _judged_sql(posts: str) -> str:
    found = lambda x, p: f"regexp_matches({x}, '{p}', 'i')"
    times = lambda p: f"coalesce(sum(len(regexp_extract_all(title, '{p}', 0, 'i'))), 0)"
    return f"""sums AS (SELECT board, count(*) AS items, max(published) AS latest, count(*) FILTER (published >= DATE '{TODAY}' - {B.RECENT}) AS recent, {times(B.ACTION)} AS action, {times(B.NEWS)} AS news,
  {times(B.ARCHIVE)} AS archive, count(*) FILTER ({found('title', B.STRONG_ACTION)}) AS strong, count(*) FILTER ({found('title', B.REPORT)}) AS reports FROM {posts} GROUP BY board),
joined AS (SELECT boards.*, label || ' ' || menu || ' > ' || segment AS place, coalesce(items, 0) AS items, latest, coalesce(recent, 0) AS recent, coalesce(action, 0) AS action, coalesce(news, 0) AS news,
  coalesce(archive, 0) AS archive, coalesce(strong, 0) AS strong, coalesce(reports, 0) AS reports, greatest(2, coalesce(items, 0) // 3) AS third FROM boards LEFT JOIN sums ON board = id),
judged AS (SELECT *, CASE WHEN never THEN 'excluded/structure/high' WHEN items = 0 THEN 'empty/no posts/high' WHEN latest < DATE '{TODAY}' - {B.DORMANT} THEN 'dormant/old posts/high'
  WHEN reports > 0 OR {found('place', B.REPORT)} THEN 'excluded/report/high' WHEN {found('place', B.GALLERY_MENU)} THEN 'news/gallery/high' WHEN {found('place', B.NEWS_MENU)} OR {found('place', B.ALUMNI_MENU)} THEN 'news/news menu/high'
  WHEN {found('place', B.RECORD_MENU)} THEN 'archive/records/medium' WHEN {found('place', B.ARCHIVE_MENU)} THEN 'archive/archive menu/high' WHEN {found('place', B.EVENT_MENU)} THEN 'notice/events/medium'
  WHEN {found('place', B.STATIC_MENU)} AND action < third THEN 'archive/static/medium' WHEN {found('menu', B.NOTICE_MENU)} OR {found('segment', B.NOTICE_MENU)} THEN 'notice/notice menu/' || CASE WHEN action >= 2 THEN 'high' ELSE 'medium' END
  WHEN action > 0 AND strong = 0 AND archive = 0 AND news = 0 THEN 'unclear/weak words/low' WHEN archive >= third AND archive > action THEN 'archive/archive words/medium' WHEN news >= third AND news > action THEN 'news/news words/medium'
  WHEN action >= third THEN 'notice/action words/high' WHEN {found('menu', B.MIXED_MENU)} OR {found('segment', B.MIXED_MENU)} THEN 'unclear/weak, mixed menu/low' ELSE 'unclear/weak/low' END AS said FROM joined)"""


@query("board_kinds", f"WITH {BOARDS_SQL}, {_judged_sql('posts')} SELECT id, split_part(said, '/', 1) AS kind, split_part(said, '/', 2) AS reason, split_part(said, '/', 3) AS confidence, latest, items, recent, action, news, archive FROM judged", days=("latest",))
def board_kinds(spark, d):
    """Each board's kind with its reason, from all of its posts."""
    return B.board_kinds(boards(spark, d), posts(spark, d), today())


SAMPLE_SQL = f"{BOARDS_SQL}, kept AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY board ORDER BY published DESC, title, post) <= 3)"


@query("board_kinds_again", f"""WITH {SAMPLE_SQL}, {_judged_sql('kept')} SELECT id, CASE WHEN id % 19 = 0 THEN 'unreachable' ELSE 'unclear' END AS was, CASE WHEN id % 19 = 0 THEN 'unreachable' ELSE split_part(said, '/', 1) END AS kind,
CASE WHEN id % 19 = 0 THEN 'closed' ELSE split_part(said, '/', 2) END AS reason, CASE WHEN id % 19 = 0 THEN 'high' ELSE split_part(said, '/', 3) END AS confidence FROM judged""")
def board_kinds_again(spark, d):
    """Stored boards judged anew from the three newest posts that were kept of each."""
    # three of each board by merging short lists, so that no board's posts are sorted in one place
    newest = F.struct(F.date_diff(F.lit("2100-01-01").cast("date"), "published").alias("age"), "title", "published")
    part = posts(spark, d).withColumn("_salt", F.pmod(F.xxhash64("title", "published"), F.lit(8)))
    three = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, 3)
    kept = part.groupBy("board", "_salt").agg(three(newest).alias("l")).groupBy("board").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, 3).alias("l"))
    sample = F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["published"].alias("published")))
    closed = F.col("id") % 19 == 0
    stored = boards(spark, d).join(kept.select(F.col("board").alias("id"), sample.alias("sample")), "id", "left")
    stored = stored.withColumns({"kind": F.when(closed, "unreachable").otherwise("unclear"), "reason": F.when(closed, "closed").otherwise("weak"), "confidence": F.when(closed, "high").otherwise("low")})
    return B.rejudged(stored, today())


@F.udf(BinaryType(), useArrow=False)
def encode_udf(text: str | None, name: str) -> bytes | None:
    return None if text is None else text.encode(name, "xmlcharrefreplace")


@query("decoded_pages", r"""SELECT page_id AS id, sha256('<p>장학 공지</p>' || CASE WHEN page_id % 4 < 2 THEN regexp_replace(html, '[^\x00-\x7F]', '?', 'g') ELSE html END) AS digest, page_id % 4 = 3 AS misdeclared FROM pages""")
def decoded_pages(spark, d):
    """Pages written in three character sets, declared, wrongly declared or not declared, read back."""
    p, k = read(spark, d, "pages"), F.col("page_id")
    name = F.when(k % 4 == 0, "cp949").when(k % 4 == 1, "euc-kr").otherwise("utf-8")
    # the Korean sets hold few of the pages' letters
    html = F.when(k % 4 < 2, F.regexp_replace("html", r"[^\x00-\x7F]", "?")).otherwise(F.col("html"))
    declared = F.when(k % 4 == 0, "EUC-KR").when(k % 4 == 3, "ascii")
    rows = p.select(k.alias("id"), encode_udf(F.concat(F.lit("<p>장학 공지</p>"), html), name).alias("body"), declared.alias("declared"), (k % 4 == 3).alias("misdeclared"))
    return rows.select("id", F.sha2(C.page_text(F.col("body"), F.col("declared")).cast("binary"), 256).alias("digest"), "misdeclared")
