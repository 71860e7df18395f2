"""What is served and reported: labels, contacts, scopes, queues and publications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import dedupe as X
from tidemark.operators import hierarchy as G

from .binding import planted, planted_sql, ITEMS_SQL, NODES_SQL, NOTICES_SQL, RUNS_SQL, items, nodes, notices, query, read, runs

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


TOPIC_CASES = [
    (1, "행사 관련 장학 이야기", "장학", None, None, "scholarship", "board"),
    (2, "[졸업] 2026학년도 졸업사정 안내", None, None, None, "graduation", "prefix"),
    (3, "안내", "등록금", None, None, "scholarship", "board"),
    (4, "아무 말", "공통", None, None, "other", "board"),
    (5, "조교 모집 공고", None, None, None, "career", "title"),
    (6, "우정장학 안내", None, None, None, "scholarship", "title"),
    (7, "전과 안내", None, None, None, "academic", "title"),
    (8, "제안서 평가위원 공개모집 (창업 축제)", "행사", None, None, "other", "admin"),
    (9, "[국제] 수강신청 안내", None, None, None, "academic", "title"),
    (10, "국제 | 기숙사 안내", None, None, None, "campus_life", "title"),
    (11, "[교육혁신사업단] 교육생 모집", None, None, None, "program", "title"),
    (21, "[창업교육센터] 교육생 모집", None, None, None, "startup", "title"),
    (12, "[국제교류] [취업] 안내", None, None, None, "international", "prefix"),
    (13, "[취업] 교환학생 장학금", None, None, None, "scholarship", "title"),
    (14, "장학 기금 모금", None, None, None, "other", "fallback"),
    (15, "알려 드립니다", None, "기숙사 공사 안내", None, "campus_life", "body"),
    (16, "알려 드립니다", None, "가" * 250 + "장학금", None, "other", "fallback"),
    (17, "알려 드립니다", None, "가" * 250 + "창업", None, "startup", "body"),
    (18, "알려 드립니다", "일반", None, "event", "event", "default"),
    (19, "교육청 장학사 채용", None, None, None, "career", "title"),
    (20, "9월 1주차 현장학습", None, None, None, "other", "fallback"),
]


def _values(rows, *columns):
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


@query("topic_cases", planted_sql("documents", "doc_id", _values([(i, r[5], r[6]) for i, r in enumerate(TOPIC_CASES, 1)], "id", "topic", "rule"), len(TOPIC_CASES)))
def topic_cases(spark, d):
    rows = planted(spark, d, "documents", "doc_id", [(i, *r[1:5]) for i, r in enumerate(TOPIC_CASES, 1)], "id int, title string, board string, body string, fallback string")
    rows = rows.withColumn("title", F.concat("title", F.lit(" "), F.col("own.lang")))
    c = R.classify(F.col("title"), F.col("board"), F.col("body"), F.col("fallback"))
    return rows.select("id", c["topic"].alias("topic"), c["rule"].alias("rule"))


@query("document_topics", f"""WITH {ITEMS_SQL}, t AS (SELECT CASE WHEN regexp_matches(title, '[Tt]uition') THEN 'scholarship' WHEN regexp_matches(title, '[Jj]ob\\s*[Ff]air') THEN 'career' WHEN regexp_matches(title, 'K-?[Ss]tartup') THEN 'startup'
  WHEN regexp_matches(title, 'TOEIC|IELTS|TOEFL|TOPIK') OR regexp_matches(substr(body, 1, 300), 'TOEIC|IELTS|TOEFL|TOPIK') THEN 'international' WHEN regexp_matches(substr(body, 1, 300), '[Jj]ob\\s*[Ff]air') THEN 'career' WHEN regexp_matches(substr(body, 1, 300), 'K-?[Ss]tartup') THEN 'startup' ELSE 'other' END AS topic FROM items)
SELECT topic, count(*) AS n FROM t GROUP BY topic""")
def document_topics(spark, d):
    """The rules over all documents; of their words only the Latin ones can occur there."""
    i = items(spark, d)
    return i.groupBy(R.classify(F.col("title"), F.lit(None).cast("string"), F.col("body"))["topic"].alias("topic")).agg(F.count("*").alias("n"))


@query("phone_numbers", planted_sql("customer", "c_custkey", _values([(1, "02-958-4616,02-958-4630"), (2, "02-961-0114"), (3, "02-961-201,02-961-202"), (4, "02-961-0053,02-961-0054,02-961-0057"), (5, "1588-1234"), (6, "02-961-999,02-961-1000,02-961-1001"), (7, ""), (8, "02-961-100"), (9, "02-958-1111,02-961-0114,02-961-2222")], "id", "numbers"), 9))
def phone_numbers(spark, d):
    raw = ["958-4616, 4630", "02-961-0114", "201/202", "0053~4, 0057", "1588-1234", "999~1001", "n/a", "100~150", "958-1111, 02-961-0114, 2222"]
    return planted(spark, d, "customer", "c_custkey", list(enumerate(raw, 1)), "id int, raw string").select("id", F.array_join(T.phone_numbers(F.col("raw"), "seoul"), ",").alias("numbers"))


@query("customer_numbers", "SELECT c_custkey AS id, '02-961-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ',02-961-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS numbers FROM customer")
def customer_numbers(spark, d):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(T.phone_numbers(F.concat(n, F.lit(" / "), n), "seoul"), ",").alias("numbers"))


@query("number_lines", planted_sql("customer", "c_custkey", _values([(1, True), (2, True), (3, False), (4, False)], "id", "numeric").replace("True", "true").replace("False", "false"), 4))
def number_lines(spark, d):
    raw = ["0053~4, 0057", "02-961/ 0114", "학사지원팀", "전화번호부"]
    return planted(spark, d, "customer", "c_custkey", list(enumerate(raw, 1)), "id int, line string").select("id", T.is_number_line(F.col("line")).alias("numeric"))


@query("dial_labels", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || '~9' WHEN s_suppkey % 3 = 1 THEN '02-961-' || s_suppkey || '~9' ELSE '02-961-' || s_suppkey END AS label FROM supplier")
def dial_labels(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    value, shown = F.when(k % 3 != 0, F.concat(F.lit("02-961-"), n)), F.when(k % 3 < 2, F.concat(n, F.lit("~9"))).otherwise(n)
    return read(spark, d, "supplier").select(k.alias("id"), T.dial_label(value, n, shown).alias("label"))


@query("poster_keys", r"""WITH p AS (SELECT page_id, replace(html, '</body>', '<img src="http://h' || page_id % 3 || '.example.org/upload/cross/images/00' || page_id % 7 || '/Poster_' || page_id % 5 || 'x_' || page_id % 4 || '.png"></body>') AS html FROM pages)
SELECT page_id AS id, 'bucket:h' || page_id % 3 || '.example.org/00' || page_id % 7 || ',file:h' || page_id % 3 || '.example.org/00' || page_id % 7 || '/poster_' || page_id % 5 || 'x' AS keys FROM p WHERE contains(html, '/upload/cross/')""")
def poster_keys(spark, d):
    """Keys of uploaded pictures: their folder, and their name without the marks of copies."""
    k = F.col("page_id")
    part = lambda n: (k % n).cast("string")
    extra = F.concat(F.lit('<img src="http://h'), part(3), F.lit(".example.org/upload/cross/images/00"), part(7), F.lit("/Poster_"), part(5), F.lit("x_"), part(4), F.lit('.png"></body>'))
    p = read(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</body>"), extra)).where(F.col("html").contains("/upload/cross/"))
    return p.select(k.alias("id"), F.array_join(F.array_sort(U.poster_keys(H.image_sources(F.col("html")))), ",").alias("keys"))


@query("poster_pages", r"""SELECT page_id AS id, 'http://h1.example.org/p' || page_id || '.png' AS image FROM pages WHERE page_id % 3 = 0""")
def poster_pages(spark, d):
    """Pages by the picture that stands for them: a third of them are made a picture with a few words, a third get a picture beside their text."""
    k, own = F.col("page_id") % 3, F.col("page_id").cast("string")
    picture = F.concat(F.lit('<img src="http://h1.example.org/p'), own, F.lit('.png">'))
    html = F.when(k == 0, F.concat(F.lit("<p>Poster "), own, F.lit("</p>"), picture)).when(k == 1, F.concat(picture, "html")).otherwise(F.col("html"))
    p = read(spark, d, "pages").select(F.col("page_id").alias("id"), html.alias("html"))
    return p.select("id", H.poster_image(H.html_text_udf("html"), H.image_sources(F.col("html"))).alias("image")).where("image IS NOT NULL")


@query("campus_bypass", "SELECT 'browse' AS mode, count(*) AS n FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT 'search', count(*) FROM orders")
def campus_bypass(spark, d):
    """The campus filter holds while browsing and is passed over where a query is given."""
    o = read(spark, d, "orders").select("o_custkey", F.explode(F.array(F.lit("browse"), F.lit("search"))).alias("mode"))
    return o.where((F.col("mode") == "search") | (F.col("o_custkey") % 2 == 1)).groupBy("mode").agg(F.count("*").alias("n"))


@query("scope_members", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def scope_members(spark, d):
    """Notices of the organizations in the scope of a picked node: it, all below it and all above it."""
    inside = G.scope(nodes(spark, d), spark.createDataFrame([("n3",)], "id string"))
    org = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return read(spark, d, "orders").withColumn("org", org).join(inside.withColumnRenamed("id", "org"), "org", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("sources_filter", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), '1') AND s_nationkey IN (1, 2, 3) AND s_acctbal > 0")
def sources_filter(spark, d):
    s = read(spark, d, "supplier")
    return s.where(F.lower("s_name").contains("1") & F.col("s_nationkey").isin(1, 2, 3) & (F.col("s_acctbal") > 0)).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("child_organizations", f"WITH {NODES_SQL} SELECT id, name FROM nodes WHERE parent = 'r1' AND NOT is_alias")
def child_organizations(spark, d):
    return nodes(spark, d).where((F.col("parent") == "r1") & ~F.col("is_alias")).select("id", "name")


@query("live_branches", f"""WITH {NODES_SQL}, used AS (SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT DISTINCT unnest([c.id, n.id, r.id]) AS id FROM used c JOIN customer ON c.id = 'c' || c_custkey JOIN nodes n ON n.id = 'n' || c_nationkey JOIN nodes r ON r.id = n.parent""")
def live_branches(spark, d):
    """The tree without branches that nothing hangs on."""
    used = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("descendant")).distinct()
    return G.closure(nodes(spark, d)).join(used, "descendant", "left_semi").select(F.col("ancestor").alias("id")).distinct()


@query("coded_values", f"WITH {NOTICES_SQL} SELECT id, category || ':' || CASE category WHEN 'urgent' THEN 'Urgent' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE category END AS coded, CASE category WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END AS ordinal FROM notices")
def coded_values(spark, d):
    """Codes with their labels and their place in the vocabulary; unknown codes stand for themselves, last."""
    words = {"urgent": "Urgent", "high": "High", "medium": "Medium", "low": "Low"}
    labels = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    places = F.create_map(*(x for k, w in enumerate(words) for x in (F.lit(w), F.lit(k))))
    c = F.col("category")
    return notices(spark, d).select("id", F.concat(c, F.lit(":"), F.coalesce(F.try_element_at(labels, c), c)).alias("coded"), F.coalesce(F.try_element_at(places, c), F.lit(99)).alias("ordinal"))


@query("notice_projection", f"""WITH {NOTICES_SQL} SELECT id, c_name AS org, CASE WHEN date IS NULL THEN 'unknown' ELSE strftime(date, '%m.%d') || coalesce(strftime("at" + INTERVAL 9 HOUR, ' %H:%M'), '') END AS published, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS seen FROM notices JOIN customer ON org = c_custkey WHERE status = 'visible'""")
def notice_projection(spark, d):
    """Notices as listed: organization, short date (with the local time where one is known), first seen as a UTC stamp."""
    n = notices(spark, d).where("status = 'visible'").join(read(spark, d, "customer"), F.col("org") == F.col("c_custkey"))
    local = F.date_format(F.from_utc_timestamp("at", "Asia/Seoul"), " HH:mm")
    short = F.when(F.col("date").isNull(), "unknown").otherwise(F.concat(F.date_format("date", "MM.dd"), F.coalesce(local, F.lit(""))))
    return n.select("id", F.col("c_name").alias("org"), short.alias("published"), F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seen"))


@query("relative_times", f"""WITH {RUNS_SQL}, a AS (SELECT id, greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 60)) AS m FROM runs)
SELECT id, CASE WHEN m < 1 THEN '방금' WHEN m < 60 THEN CAST(m AS INTEGER) || '분 전' WHEN m < 1440 THEN CAST(floor(m / 60) AS INTEGER) || '시간 전' ELSE CAST(floor(m / 1440) AS INTEGER) || '일 전' END AS label, m < 1440 AS is_new FROM a""")
def relative_times(spark, d):
    from tidemark.functions import dates as D

    return runs(spark, d).select("id", D.relative_label(F.col("ts"), now()).alias("label"), D.is_new(F.col("ts"), now()).alias("is_new"))


@query("last_checked", f"""WITH {RUNS_SQL}, h AS (SELECT source, max(ts) + INTERVAL 9 HOUR AS t FROM runs GROUP BY source), a AS (SELECT *, CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE) - CAST(t AS DATE) AS days FROM h)
SELECT source, CASE WHEN days <= 0 THEN '오늘' WHEN days = 1 THEN '어제' ELSE strftime(t, '%m.%d') END || strftime(t, ' %H:%M') || ' 확인' AS label FROM a""")
def last_checked(spark, d):
    """When a source was last looked at, in local time: today, yesterday or a day, and the clock."""
    t = F.from_utc_timestamp(F.max("ts"), "Asia/Seoul")
    h = runs(spark, d).groupBy("source").agg(t.alias("t"))
    days = F.datediff(F.to_date(F.from_utc_timestamp(now(), "Asia/Seoul")), F.to_date("t"))
    day = F.when(days <= 0, "오늘").when(days == 1, "어제").otherwise(F.date_format("t", "MM.dd"))
    return h.select("source", F.concat(day, F.date_format("t", " HH:mm"), F.lit(" 확인")).alias("label"))


@query("admission_years", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3000 BETWEEN 1950 AND 2100 AND p_partkey % 7 <> 0 THEN CAST(p_partkey % 3000 AS INTEGER) END AS year FROM part")
def admission_years(spark, d):
    """A year is a whole number from 1950 to 2100; anything else is none."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit(" "), (k % 3000).cast("string"), F.when(k % 7 == 0, "x").otherwise(" "))
    year = F.trim(raw).try_cast("int")
    return read(spark, d, "part").select(k.alias("id"), F.when(year.between(1950, 2100), year).alias("year"))


@query("two_digit_years", f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 2 THEN CAST(CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE) AS VARCHAR) WHEN 3 THEN NULL ELSE strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') END AS day FROM orders")
def two_digit_years(spark, d):
    """Board dates: a year of two digits is of this century, a clock alone is today."""
    from tidemark.functions import dates as D

    k, day = F.col("o_orderkey") % 4, F.add_months(F.to_date("o_orderdate"), 336)
    raw = F.when(k == 0, F.date_format(day, "yy-MM-dd")).when(k == 1, F.date_format(day, "yyyy.MM.dd")).when(k == 2, "14:05").otherwise("어제")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.parse_published(D.board_date(raw, D.local_date(now())))["date"].cast("string").alias("day"))


@query("deadlines_with_zone", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 15:00:00') END AS "at" FROM orders""")
def deadlines_with_zone(spark, d):
    """A deadline counts only with its offset from UTC."""
    from tidemark.functions import dates as D

    k, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.concat(day, F.when(k == 0, "T09:00:00+09:00").when(k == 1, "T09:00:00").otherwise("T15:00:00Z"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(D.zoned(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("active_health", "SELECT c_custkey AS id, n_name AS owner, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def active_health(spark, d):
    """Left joins in a chain: an inactive owner is no owner, and has no region either."""
    active = read(spark, d, "nation").where("n_nationkey % 2 = 0")
    return read(spark, d, "customer").join(active, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("c_custkey").alias("id"), F.col("n_name").alias("owner"), F.col("r_name").alias("region"))


@query("open_deadlines", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '2001-09-01')")
def open_deadlines(spark, d):
    l = read(spark, d, "lineitem").where(F.col("l_shipdate") > F.lit("2001-09-01").cast("timestamp_ntz"))
    return read(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("o_orderkey").alias("id"))


@query("scalar_primary", "SELECT o_orderkey AS id, (SELECT min(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS flag FROM orders")
def scalar_primary(spark, d):
    """One value of the primary child of each notice, null without one."""
    first = read(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    return read(spark, d, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("id"), "flag")


@query("recent_pairs", f"""WITH {ITEMS_SQL}, r AS (SELECT id, '  ' || lower(trim(regexp_replace(regexp_replace(title, '{T.PUNCTUATION.replace("'", "''")}', ' ', 'g'), '\\s+', ' ', 'g'))) || ' ' AS p FROM items ORDER BY id DESC LIMIT 60),
g AS (SELECT id, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM r)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 4) AS similarity FROM g a JOIN g b ON a.id < b.id WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.2""")
def recent_pairs(spark, d):
    """All pairs of the newest sixty items (a bound of the rule) whose titles are alike."""
    newest = items(spark, d).select("id", "title").orderBy(F.col("id").desc()).limit(60).select("id", T.trigrams(T.normalize_title(F.col("title"))).alias("g"))
    l, r = newest.alias("l"), newest.alias("r")
    s = T.set_similarity(F.col("l.g"), F.col("r.g"))
    return l.join(F.broadcast(r), F.col("l.id") < F.col("r.id")).where(s >= 0.2).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(s, 4).alias("similarity"))


@query("keyword_hits", "SELECT CASE WHEN contains(lower(url), 'a') THEN 'notice' ELSE 'board' END AS kind, count(*) AS n, CAST(count(*) FILTER (contains(lower(html), '<table')) AS BIGINT) AS tables, CAST(count(*) FILTER (contains(lower(html), '<nav')) AS BIGINT) AS menus FROM pages GROUP BY 1")
def keyword_hits(spark, d):
    kind = F.when(F.lower("url").contains("a"), "notice").otherwise("board")
    html = F.lower("html")
    return read(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(html.contains("<table")).alias("tables"), F.count_if(html.contains("<nav")).alias("menus"))


@query("contact_counters", "SELECT count(*) AS contacts, count(DISTINCT s_nationkey) AS organizations, CAST(count(*) FILTER (s_acctbal < 0) AS BIGINT) AS unresolved FROM supplier")
def contact_counters(spark, d):
    return read(spark, d, "supplier").agg(F.count("*").alias("contacts"), F.count_distinct("s_nationkey").alias("organizations"), F.count_if(F.col("s_acctbal") < 0).alias("unresolved"))


@query("colleges", "SELECT r_name AS college, string_agg(n_name, ',' ORDER BY n_name) AS departments FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def colleges(spark, d):
    """Departments by college, each sorted by the Korean collation."""
    j = read(spark, d, "region").join(read(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.collate(F.col("n_name"), "ko").alias("k"), "n_name"))), lambda x: x["n_name"])
    return j.groupBy(F.col("r_name").alias("college")).agg(F.array_join(names, ",").alias("departments"))


@query("below_window", f"""WITH {RUNS_SQL}, p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS page, value < 50 AS below FROM runs), g AS (SELECT *, page - row_number() OVER (PARTITION BY source, below ORDER BY page) AS island FROM p)
SELECT source, max(n) AS longest FROM (SELECT source, island, count(*) AS n FROM g WHERE below GROUP BY source, island) GROUP BY source""")
def below_window(spark, d):
    """The longest run of pages that lie below the window; collecting stops after some."""
    from tidemark.operators.state import streaks

    s = streaks(runs(spark, d), "source", ["ts", "id"], F.coalesce(F.col("value") >= 50, F.lit(True)))
    return s.groupBy("source").agg(F.max("streak").alias("longest")).where("longest > 0")


@query("report_deltas", "SELECT CAST(day AS VARCHAR) AS day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def report_deltas(spark, d):
    """Daily reports against the one before; there is one row per day."""
    r = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return r.select(F.col("day").cast("string").alias("day"), "n", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("delta"))


@query("first_of_category", "SELECT org, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS ids FROM (SELECT o_custkey AS org, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderpriority = '1-URGENT') WHERE n <= 3 GROUP BY org")
def first_of_category(spark, d):
    """The newest three urgent notices of each organization; each keeps at most three on the map side."""
    o = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("org"), F.struct(F.col("o_orderdate"), F.col("o_orderkey")).alias("k"))
    w = Window.partitionBy("org").orderBy(F.col("k").desc())
    top = o.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("org").agg(F.array_sort(F.collect_list(F.struct("n", F.col("k.o_orderkey").alias("id")))).alias("x"))
    return top.select("org", F.array_join(F.transform("x", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("mine_first", "SELECT s_suppkey AS id FROM supplier ORDER BY s_nationkey <> 7, s_name LIMIT 40")
def mine_first(spark, d):
    """One page of contacts, those of the own organization first, the others as they were."""
    return read(spark, d, "supplier").orderBy(F.col("s_nationkey") != 7, "s_name").limit(40).select(F.col("s_suppkey").alias("id"))


@query("merged_shards", "SELECT o_custkey AS key, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def merged_shards(spark, d):
    """Index shards with overlapping keys as one: the newest entry of each key."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("newest"))
    shards = o.where("newest % 3 = 0").union(o.where("newest % 3 > 0")).union(o.where("newest % 5 = 0"))
    return shards.groupBy("key").agg(F.max_by("newest", "newest").alias("newest"))


#: what is put behind a supplier's name, what of it stays, and the kind that follows with a site of the given kind
SITES = [
    (1, " 화학과25", "ETC", " 화학과", "department"), (2, "<br/> 입학처 (국문)", "COLLEGE", " 입학처", "office"), (3, "  연구소 (개발중)", "ATTACHED", " 연구소", "institute"),
    (4, " 건강센터(서울) (오비스홀 152호)", None, " 건강센터(서울)", "institute"), (5, " 커뮤니케이션21", "GRADUATE", " 커뮤니케이션21", "college"), (6, " 디지털콘텐츠학부 (영문) (임시)", "ETC", " 디지털콘텐츠학부 (영문)", "office"),
]


@query("site_names", f"SELECT s.s_suppkey AS id, s_name || c.stays AS name, c.kind FROM supplier s JOIN ({_values([(r[0], r[3], r[4]) for r in SITES], 'id', 'stays', 'kind')}) c ON c.id = s.s_suppkey % {len(SITES)} + 1")
def site_names(spark, d):
    """Names without noise; the kind of an organization by how its name ends, else by its site's."""
    p = planted(spark, d, "supplier", "s_suppkey", [r[:3] for r in SITES], "id int, more string, site_kind string")
    name = T.site_name(F.concat("own.s_name", "more"))
    return p.select("id", name.alias("name"), T.organization_kind(name, F.col("site_kind")).alias("kind"))


@query("url_aliases", r"""WITH u AS (SELECT page_id AS id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '://([^/?#]*)', 1) AS h, rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS p, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
c AS (SELECT id, url, lower(s) || '://' || lower(h) || p || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))), '&'), ''), '') AS alias FROM u)
SELECT id, alias FROM c WHERE alias <> url AND alias NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)""")
def url_aliases(spark, d):
    """Canonical addresses that differ from the page's own and are no page's."""
    p = read(spark, d, "pages").withColumn("alias", U.canonical_url(F.col("url")))
    seen = read(spark, d, "pages").select(F.col("url").alias("alias"))
    return p.where("alias <> url").join(seen, "alias", "left_anti").select(F.col("page_id").alias("id"), "alias")


@query("run_log", f"WITH {RUNS_SQL} SELECT id, source, CASE WHEN failed THEN substr(repeat('error ' || id || ' ', 300), 1, 2000) END AS error, CASE WHEN failed THEN 0 ELSE 1 END AS ok FROM runs WHERE id % 50 = 0")
def run_log(spark, d):
    """Rows of the run log: an error's text is kept to two thousand characters."""
    message = F.substring(F.repeat(F.concat(F.lit("error "), F.col("id").cast("string"), F.lit(" ")), 300), 1, 2000)
    return runs(spark, d).where("id % 50 = 0").select("id", "source", F.when(F.col("failed"), message).alias("error"), F.when(F.col("failed"), 0).otherwise(1).alias("ok"))


@query("health_rows", f"""WITH {RUNS_SQL}, w AS (SELECT source, ts, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS b FROM runs)
SELECT source, CAST(count(*) FILTER (b = 0) AS BIGINT) AS failures, max(ts) FILTER (NOT failed) AS last_success FROM w GROUP BY source""")
def health_rows(spark, d):
    """Health of each source: a success sets its failures back to none."""
    from tidemark.operators.state import newest_streak

    r = runs(spark, d)
    f = newest_streak(r, "source", [F.col("ts").desc(), F.col("id").desc()], ~F.col("failed"))
    ok = r.groupBy("source").agg(F.max(F.when(~F.col("failed"), F.col("ts"))).cast("timestamp_ntz").alias("last_success"))
    return ok.join(f, "source").select("source", F.col("streak").alias("failures"), "last_success")


@query("chosen_campus", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'global' WHEN c_custkey % 3 = 1 THEN 'seoul' ELSE 'all' END AS campus FROM customer")
def chosen_campus(spark, d):
    """The requested campus if the organization is there, else its own, else none in particular."""
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, F.array(F.lit("seoul"), F.lit("global"))).when(k % 3 == 1, F.array(F.lit("seoul"))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "customer").select(k.alias("id"), F.when(F.array_contains(own, "global"), "global").otherwise(F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("all"))).alias("campus"))


@query("campus_options", "SELECT 'all' AS code, 0 AS place, count(*) AS n FROM nation UNION ALL SELECT r_name, r_regionkey + 1, count(*) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def campus_options(spark, d):
    """Options with an entry for all before them, from one pass."""
    j = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = j.select(F.explode(F.array(F.struct(F.lit("all").alias("code"), F.lit(0).cast("long").alias("place")), F.struct(F.col("r_name").alias("code"), (F.col("r_regionkey") + 1).cast("long").alias("place")))).alias("o"))
    return each.groupBy("o.code", "o.place").agg(F.count("*").alias("n"))


@query("notice_by_id", f"WITH {NOTICES_SQL}, q AS (SELECT unnest([1, 2, 3, -5]) AS id) SELECT q.id, coalesce(n.status, 'not_found') AS status FROM q LEFT JOIN notices n ON n.id = q.id")
def notice_by_id(spark, d):
    asked = spark.createDataFrame([(1,), (2,), (3,), (-5,)], "id long")
    return asked.join(notices(spark, d).select("id", "status"), "id", "left").select("id", F.coalesce("status", F.lit("not_found")).alias("status"))


WATCHDOG = [
    (1, 0, 0, None, 0, 0, None, 0, "no targets"),
    (2, 9, 0, "2024-03-01", 0, 0, None, 0, "complete"),
    (3, 9, 4, None, 0, 0, None, 0, "no deadline"),
    (4, 9, 4, "2024-01-30", 0, 0, None, 0, "past deadline"),
    (5, 9, 4, "2024-03-01", 1, 0, None, 0, "running"),
    (6, 9, 4, "2024-03-01", 0, 3, None, 0, "failing"),
    (7, 9, 4, "2024-03-01", 0, 0, 5, 0, "cooling down"),
    (8, 9, 4, "2024-03-01", 0, 0, 50, 4, "too many"),
    (9, 9, 4, "2024-03-01", 0, 0, 50, 1, "dispatch"),
]


@query("watchdog_cases", planted_sql("customer", "c_custkey", _values([(r[0], r[8]) for r in WATCHDOG], "id", "decision"), len(WATCHDOG)))
def watchdog_cases(spark, d):
    rows = planted(spark, d, "customer", "c_custkey", [r[:8] for r in WATCHDOG], "id int, total int, remaining int, until string, active int, failures int, minutes int, recent int")
    return rows.select("id", R.watchdog(F.col("total"), F.col("remaining"), F.to_timestamp("until"), F.col("active"), F.col("failures"), F.col("minutes"), F.col("recent"), now()).alias("decision"))


@query("manifest", "SELECT 'v1/orders/' || o_custkey || '.json' AS key, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS object, count(*) AS rows FROM orders GROUP BY o_custkey")
def manifest(spark, d):
    """One entry per published file with the address of its content."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    content = F.array_join(F.transform("x", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"])), ",")
    return o.select(F.concat(F.lit("v1/orders/"), F.col("o_custkey").cast("string"), F.lit(".json")).alias("key"), F.sha2(content, 256).alias("object"), F.size("x").cast("long").alias("rows"))


@query("silent_boards", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')")
def silent_boards(spark, d):
    """Sources that are watched and have given nothing for a while."""
    late = read(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return read(spark, d, "customer").where("c_acctbal > 0").join(late, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("contacts_found", "SELECT s_suppkey AS id, s_name AS name, n_name AS org FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', s_name, n_name)), 'a') AND s_nationkey IN (1, 2, 3)")
def contacts_found(spark, d):
    """Contacts with their organization, by words in either and by scope."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.where(F.lower(F.concat_ws(" ", "s_name", "n_name")).contains("a") & F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("org"))


@query("document_admission", r"SELECT CASE WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'scheme' ELSE 'ok' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def document_admission(spark, d):
    """Every page's address against the rules of admission."""
    return read(spark, d, "pages").groupBy(F.coalesce(U.admitted(F.col("url")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("poster_pairs", "SELECT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT x.page_id AS a, y.page_id AS b FROM pages x JOIN pages y ON x.page_id < y.page_id AND x.page_id // 20 = y.page_id // 20 AND x.page_id % 2 <> y.page_id % 2)")
def poster_pairs(spark, d):
    """Candidate pairs by an upload folder that items of different sources share."""
    p = read(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 2).cast("string").alias("source"), F.concat(F.lit("bucket:h/"), F.floor(F.col("page_id") / 20).cast("string")).alias("key"))
    return X.candidate_pairs(p, F.array("key"))
