"""What kind of board a list of posts is: notices, news, an archive, empty, dormant, left out, or not yet to be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Board codes that never hold notices, whatever their posts say.
NEVER_NOTICES = ("BMSR00047", "BMSR00059", "BMSR00046", "BMSR00060")
# Words of menus and names. Case does not count.
NOTICE_MENU = r"공지|알림|announcement|notice|학사안내|소식·?공지"
MIXED_MENU = r"커뮤니티|community|게시판|board|자료실|정보마당"
GALLERY_MENU = r"갤러리|사진|포토|photo|gallery|화보|앨범"
NEWS_MENU = r"학과소식|동문소식|기자단|pr\s*room|보도자료|언론|홍보|news|소식지|웹진|webzine"
ALUMNI_MENU = r"동문회|동문|총동문|학부소식|학과\s*소식|재학생\s*소식"
RECORD_MENU = r"성과\s*관리|우수성과|research\s*highlights|논문|저서|특허|연구실적|수상실적|참여\s*대학원생|명단|현황|협동과정|전공\s*및\s*연구실|결산|발전기금"
ARCHIVE_MENU = r"자료실|자료\s*모음|발표\s*자료|강의\s*자료|수업\s*자료|기출|서식|양식|규정|강의계획|책자|브로슈어|brochure|아카이브|archive|다운로드|download"
EVENT_MENU = r"콜로키움|colloquium|학술행사|세미나|seminar|특강|포럼|forum|공연|전시|학술제"
STATIC_MENU = r"교육과정|연보|curriculum|연혁|조직도|시설안내|약도|오시는\s*길|연구실\s*소개|구성원|명단|위원회|계열|자료실|강의자료"
# Words of titles.
ACTION = r"모집|신청|접수|선발|공고|안내|시행|제출|마감|공모|참가|지원자|대상자|일정|변경|등록|납부|수강|신청서|설명회|면접|합격|추천|채용|공채|리크루팅|인턴|장학|특강|세미나|콜로키움|워크숍|워크샵|시험|평가|휴학|복학|졸업|학위|배정|선정|안내문|apply|application|recruit|deadline|scholarship|seminar|colloquium"
STRONG_ACTION = r"모집|신청|접수|선발|공고|마감|제출|공모|채용|공채|리크루팅|납부|수강|휴학|복학|시험|평가|설명회|면접|합격|추천|장학|인턴|apply|application|recruit|deadline"
NEWS = r"시상|수상|협약|체결|후기|성료|성과|개최\s*결과|참여했|방문했|인터뷰|기사|보도|화보|스케치|뉴스|칼럼|기고|축사|동정|다녀왔|열렸|진행했|선정되|임명|취임|부고|추모"
ARCHIVE = r"백서|책자|자료집|양식|서식|규정|시행세칙|교육과정|브로슈어|brochure|매뉴얼|가이드북|학회지|논문집|연보|실적|수업\s*자료|강의\s*자료|참고자료"
REPORT = r"\[SDG\s*\d+\]|\[R-\d+\]"
# Days without a post until a board is dormant, and days that count as recent.
DORMANT, RECENT = 730, 365

SIGNALS = ("items", "latest", "recent", "action", "strong", "news", "archive", "reports")


def _said(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def _times(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"(?i){pattern}")), F.lit(0)).cast("long")


def _post(title: Column, published: Column, today: Column) -> dict[str, Column]:
    """What one post adds to a board's signals."""
    return {
        "items": F.lit(1).cast("long"),
        "recent": F.coalesce((published >= F.date_sub(today, RECENT)).cast("long"), F.lit(0)),
        "action": _times(title, ACTION),
        "strong": _said(title, STRONG_ACTION).cast("long"),
        "news": _times(title, NEWS),
        "archive": _times(title, ARCHIVE),
        "reports": _said(title, REPORT).cast("long"),
    }


def signals(posts: DataFrame, today: Column) -> DataFrame:
    """``posts(board, title, published date)`` to one row of sums per board. Each post is reduced to numbers before the shuffle, so a
    board of any size is summed by many tasks. A null title says nothing, a null day is no day; both are posts."""
    each = posts.select("board", "published", *(c.alias(k) for k, c in _post(F.col("title"), F.col("published"), today).items()))
    return each.groupBy("board").agg(F.max("published").alias("latest"), *(F.sum(k).alias(k) for k in SIGNALS if k != "latest"))


def sample_signals(sample: Column, today: Column) -> Column:
    """The same of a stored ``array<struct<title, published date>>``, as a struct and without a shuffle."""
    kept = F.coalesce(sample, F.array().cast("array<struct<title:string,published:date>>"))

    def total(k: str) -> Column:
        return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + _post(x["title"], x["published"], today)[k])

    return F.struct(F.array_max(F.transform(kept, lambda x: x["published"])).alias("latest"), *(total(k).alias(k) for k in SIGNALS if k != "latest"))


def judged(code: Column, coded: Column, label: Column, path: Column, s: Column, today: Column) -> Column:
    """``struct<kind, reason, confidence>`` of a board: the first rule that holds. ``s`` are its signals, ``path`` the menus above it.

    ``coded``: whether the board's software uses the codes of NEVER_NOTICES. Null label, path and signals are empty ones.
    """
    path = F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda p: p.isNotNull())
    where = F.concat_ws(" ", F.coalesce(label, F.lit("")), F.array_join(path, " > "))
    n = {k: F.coalesce(s[k], F.lit(0)) for k in SIGNALS if k != "latest"}
    third = F.greatest(F.lit(2), F.floor(n["items"] / 3))
    says = lambda kind, reason, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"))
    menus = lambda pattern: F.exists(path, lambda p: _said(p, pattern))
    return (
        F.when(F.coalesce(coded & code.isin(*NEVER_NOTICES), F.lit(False)), says("excluded", "structure", "high"))
        .when(n["items"] == 0, says("empty", "no posts", "high"))
        .when(F.coalesce(s["latest"] < F.date_sub(today, DORMANT), F.lit(False)), says("dormant", "old posts", "high"))
        .when((n["reports"] > 0) | _said(where, REPORT), says("excluded", "report", "high"))
        .when(_said(where, GALLERY_MENU), says("news", "gallery", "high"))
        .when(_said(where, NEWS_MENU) | _said(where, ALUMNI_MENU), says("news", "news menu", "high"))
        .when(_said(where, RECORD_MENU), says("archive", "records", "medium"))
        .when(_said(where, ARCHIVE_MENU), says("archive", "archive menu", "high"))
        .when(_said(where, EVENT_MENU), says("notice", "events", "medium"))
        .when(_said(where, STATIC_MENU) & (n["action"] < third), says("archive", "static", "medium"))
        .when(menus(NOTICE_MENU), says("notice", "notice menu", F.when(n["action"] >= 2, "high").otherwise("medium")))
        .when((n["action"] > 0) & (n["strong"] == 0) & (n["archive"] == 0) & (n["news"] == 0), says("unclear", "weak words", "low"))
        .when((n["archive"] >= third) & (n["archive"] > n["action"]), says("archive", "archive words", "medium"))
        .when((n["news"] >= third) & (n["news"] > n["action"]), says("news", "news words", "medium"))
        .when(n["action"] >= third, says("notice", "action words", "high"))
        .when(menus(MIXED_MENU), says("unclear", "weak, mixed menu", "low"))
        .otherwise(says("unclear", "weak", "low"))
    )


def board_kinds(boards: DataFrame, posts: DataFrame, today: Column) -> DataFrame:
    """``boards(id, code, coded, label, path)``, one row per id, with ``kind, reason, confidence`` and the signals of their ``posts(board, title,
    published)``. Posts of unknown boards say nothing; no boards: no rows."""
    got = boards.join(signals(posts, today).withColumnRenamed("board", "id"), "id", "left")
    got = got.withColumn("_s", F.struct(*SIGNALS)).withColumn("_k", judged(F.col("code"), F.col("coded"), F.col("label"), F.col("path"), F.col("_s"), today))
    return got.select("id", "_k.*", "latest", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("items", "recent", "action", "news", "archive")))


def rejudged(stored: DataFrame, today: Column) -> DataFrame:
    """``stored(id, code, coded, label, path, sample, kind, reason, confidence)`` judged anew from the samples that were kept, nothing being fetched;
    boards that could not be reached keep what was said of them. ``was`` is the kind before."""
    signs = stored.withColumn("_s", sample_signals(F.col("sample"), today))
    new = F.when(F.col("kind") == "unreachable", F.struct("kind", "reason", "confidence")).otherwise(judged(F.col("code"), F.col("coded"), F.col("label"), F.col("path"), F.col("_s"), today))
    return signs.select("id", F.col("kind").alias("was"), new.alias("_k")).select("id", "was", "_k.*")
