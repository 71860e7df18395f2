"""Scalar functions and rules, on the tables where they apply and on fixed wordings where not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import html as H
from tidemark.functions import ids as I
from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.functions import urls as U

from .binding import planted, planted_sql, ITEMS_SQL, items, query, read


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@query("excerpts", r"""WITH t AS (SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents), h AS (SELECT *, substr(x, 1, 180) AS h FROM t), c AS (SELECT *, length(regexp_extract(h, '^(.*) [^ ]*$', 1)) AS c FROM h)
SELECT id, CASE WHEN length(x) <= 180 THEN x WHEN c > 90 THEN rtrim(substr(h, 1, c)) || '…' ELSE rtrim(h) || '…' END AS excerpt FROM c""")
def excerpts(spark, d):
    return items(spark, d).select("id", T.excerpt(F.col("body")).alias("excerpt"))


@query("title_similarity", """WITH t AS (SELECT n_nationkey AS id, '  ' || lower(n_name) || ' ' AS p FROM nation), g AS (SELECT id, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM t)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 4) AS similarity FROM g a JOIN g b ON b.id = a.id + 1""")
def title_similarity(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), T.trigrams(T.normalize_title(F.col("n_name"))).alias("g"))
    l, r = n.alias("l"), n.alias("r")
    return l.join(r, F.col("r.id") == F.col("l.id") + 1).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(T.set_similarity(F.col("l.g"), F.col("r.g")), 4).alias("similarity"))


@query("content_hashes", f"""WITH {ITEMS_SQL} SELECT id, sha256(lower(trim(regexp_replace(regexp_replace(title, '{T.PUNCTUATION.replace("'", "''")}', ' ', 'g'), '\\s+', ' ', 'g'))) || chr(29) || trim(regexp_replace(body, '\\s+', ' ', 'g')) || chr(29) || 'a.pdf' || chr(31) || 'u' || chr(31) || id || chr(30) || 'b.pdf' || chr(31) || chr(31)) AS hash FROM items""")
def content_hashes(spark, d):
    file = lambda *v: F.struct(*(x.alias(n) for x, n in zip(v, ("filename", "url", "size_bytes"), strict=True)))
    files = F.array(file(F.lit("b.pdf"), F.lit(None).cast("string"), F.lit(None).cast("long")), file(F.lit("a.pdf"), F.lit("u"), F.col("id")))
    return items(spark, d).select("id", T.content_hash(F.col("title"), F.col("body"), files).alias("hash"))


@query("slugs", "SELECT c_custkey AS id, coalesce(nullif(substr(trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24), ''), 'x') AS slug FROM customer")
def slugs(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"))


@query("canonical_urls", r"""WITH p AS (SELECT page_id AS id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (SELECT id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) || rtrim(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/') AS head, regexp_extract(u, '\?(.*)$', 1) AS q FROM p),
k AS (SELECT id, head, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid'))), '&') AS k FROM q)
SELECT id, head || CASE WHEN k <> '' THEN '?' || k ELSE '' END AS url FROM k""")
def canonical_urls(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), U.canonical_url(F.col("url")).alias("url"))


@query("hosts", "SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def hosts(spark, d):
    return read(spark, d, "pages").groupBy(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]*)", 1)).alias("host")).agg(F.count("*").alias("n"))


@query("proxy_paths", "SELECT page_id AS id, '/v1/img/' || rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS path FROM pages")
def proxy_paths(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), U.proxy_path(F.col("url")).alias("path"))


@query("url_admission", """SELECT page_id AS id, CASE page_id % 9 WHEN 1 THEN 'scheme' WHEN 2 THEN 'port' WHEN 3 THEN 'name' WHEN 4 THEN 'address' WHEN 5 THEN 'address' WHEN 7 THEN 'name' WHEN 8 THEN 'address' END AS reason FROM pages""")
def url_admission(spark, d):
    """Every page's address, with its scheme, port or host changed to what may not be fetched."""
    k, url = F.col("page_id") % 9, F.regexp_replace("url", "^https?://([^/:]+)(:[0-9]+)?", "http://$1")
    to = lambda host: F.regexp_replace(url, "^http://[^/]+", f"http://{host}")
    made = F.when(k == 1, F.regexp_replace(url, "^http", "ftp")).when(k == 2, F.regexp_replace(url, "^(http://[^/]+)", "$1:8080")).when(k == 3, to("localhost")).when(k == 4, to("10.0.0.1")).when(k == 5, to("172.20.1.1")).when(k == 6, F.regexp_replace(url, "^(http://[^/]+)", "$1:80")).when(k == 7, to("files.internal")).when(k == 8, to("169.254.1.1")).otherwise(url)
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), U.admitted(made).alias("reason"))


@query("object_keys", """SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN 'v1/pages/' || page_id || '.json' WHEN 2 THEN 'v1/objects/' || page_id || '.gz' END AS key FROM pages""")
def object_keys(spark, d):
    k, own = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/v1/pages/"), own)).when(k == 1, F.concat(F.lit("/v1/../"), own)).when(k == 2, F.concat(F.lit("v1/objects/"), own, F.lit(".gz"))).when(k == 3, F.concat(F.lit("/v1//"), own)).otherwise(F.concat(F.lit("/etc/"), own))
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), U.object_key(path).alias("key"))


@query("evidence_keys", "SELECT page_id AS id, 'raw/src-1/' || page_id || '/' || substr(sha256(html), 1, 16) || '.html' AS key FROM pages")
def evidence_keys(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), U.evidence_key(F.lit("src-1"), F.col("page_id").cast("string"), F.sha2("html", 256)).alias("key"))


@query("absolute_urls", """SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'https://h.example/a/' || page_id WHEN 1 THEN 'https://x.example/' || page_id WHEN 2 THEN url ELSE 'https://h.example/e' || page_id || '.do' END AS url FROM pages""")
def absolute_urls(spark, d):
    k, own = F.col("page_id") % 4, F.col("page_id").cast("string")
    ref = F.when(k == 0, F.concat(F.lit("/a/"), own)).when(k == 1, F.concat(F.lit("//x.example/"), own)).when(k == 2, F.col("url")).otherwise(F.concat(F.lit("./e"), own, F.lit(".do")))
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), U.absolute_url(F.lit("https://h.example/board/list.do"), ref).alias("url"))


@query("published_dates", """SELECT id, CASE WHEN k < 5 THEN day END AS date, CASE k WHEN 1 THEN CAST(day AS TIMESTAMP) + INTERVAL 330 MINUTE WHEN 4 THEN CAST(day AS TIMESTAMP) + INTERVAL 5 MINUTE END AS "at", CASE WHEN k IN (1, 4) THEN 'datetime' WHEN k < 5 THEN 'date' ELSE 'unknown' END AS precision
FROM (SELECT o_orderkey AS id, o_orderkey % 7 AS k, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS day FROM orders)""", days=("date",))
def published_dates(spark, d):
    """The order's day (28 years on) in seven notations, of which two are no dates."""
    k, day = F.col("o_orderkey") % 7, F.add_months(F.to_date("o_orderdate"), 336)
    on = lambda form: F.date_format(day, form)
    raw = F.when(k == 0, on("yyyy-MM-dd")).when(k == 1, on("yyyy-MM-dd 14:30")).when(k == 2, on("yyyy년 M월 d일")).when(k == 3, on("yyyyMMdd")).when(k == 4, on("yyyy.M.d 9시 05")).when(k == 5, "상시").otherwise(on("yyyy-02-30"))
    got = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.parse_published(raw).alias("p"))
    return got.select("id", "p.date", F.col("p.at").cast("timestamp_ntz").alias("at"), "p.precision")


@query("deadlines", planted_sql("documents", "doc_id", "SELECT id, CAST(date AS DATE) AS date, precision FROM (VALUES (1, NULL, NULL), (2, '2026-03-15', 'date'), (3, '2026-04-01', 'datetime'), (4, NULL, NULL)) AS t(id, date, precision)", 4), days=("date",))
def deadlines(spark, d):
    values = [(1, "행사 안내", "2026-03-02 에 진행합니다", None), (2, "모집", "신청 기간: 2026-03-02 ~ 2026-03-15 까지", None), (3, "모집", "마감 2026-04-01 18:00\n마감 2026-03-01", None), (4, "모집", "마감 2026-03-01", "2026-04-01")]
    got = planted(spark, d, "documents", "doc_id", values, "id int, title string, body string, day string").withColumn("g", D.guess_deadline_udf("title", "body", F.to_date("day")))
    return got.select("id", "g.date", "g.precision")


@query("freshness", """SELECT user_id AS source, CASE WHEN age <= 10800 THEN 'fresh' WHEN age <= 86400 THEN 'delayed' ELSE 'stale' END AS state, round(age / 3600, 1) + 0.0 AS hours FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(max(ts)) AS age FROM events GROUP BY user_id)""")
def freshness(spark, d):
    now = F.lit("2024-01-30 23:00:00").cast("timestamp")
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").cast("timestamp").alias("last"))
    return e.select("source", D.freshness(F.col("last"), now).alias("state"), D.age_hours(F.col("last"), now).alias("hours"))


@query("local_days", "SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1", days=("day",))
def local_days(spark, d):
    return read(spark, d, "events").groupBy(D.local_date(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n"))


@query("topics", planted_sql("documents", "doc_id", "SELECT * FROM (VALUES (1, 'scholarship', 'board', ''), (2, 'graduation', 'prefix', 'academic'), (3, 'scholarship', 'board', ''), (4, 'other', 'board', ''), (5, 'other', 'fallback', ''), (6, 'program', 'title', 'event')) AS t(id, topic, rule, others)", 6))
def topics(spark, d):
    values = [(1, "이야기 모음", "장학"), (2, "[졸업] 2026 학사 일정", None), (3, "안내", "등록금"), (4, "아무 말", "공통"), (5, "아무 말", None), (6, "(서울캠퍼스) 멘토링 설명회", None)]
    got = planted(spark, d, "documents", "doc_id", values, "id int, title string, board string").withColumn("c", R.classify(F.col("title"), F.col("board")))
    return got.select("id", "c.topic", "c.rule", F.array_join("c.others", ",").alias("others"))


@query("audiences", planted_sql("documents", "doc_id", "SELECT * FROM (VALUES (1, 'org:a,campus:seoul', true, false), (2, 'university', false, false), (3, 'undetermined', false, false), (4, 'campus:x', false, true), (5, 'org:a,university', false, false)) AS t(id, keys, narrowed, restricted)", 5))
def audiences(spark, d):
    values = [(1, "서울캠퍼스 안내", "", ["org:a", "university"]), (2, "전교생 안내", "", ["campus:x"]), (3, "안내", "", []), (4, "신청 자격", "서울캠퍼스와 국제캠퍼스", ["campus:x"]), (5, "재학생 전원", "", ["org:a"])]
    got = planted(spark, d, "documents", "doc_id", values, "id int, title string, body string, defaults array<string>").withColumn("a", R.audience(F.col("title"), F.col("body"), F.col("defaults")))
    return got.select("id", F.array_join("a.keys", ",").alias("keys"), "a.narrowed", "a.restricted")


@query("board_words", "SELECT lang, count(*) AS n, CAST(count(*) FILTER (regexp_matches(lower(text), 'https?://|www[.]')) AS BIGINT) AS linked, CAST(count(*) FILTER (regexp_matches(text, '[^ ]+@[^ ]+')) AS BIGINT) AS mail FROM documents GROUP BY lang")
def board_words(spark, d):
    t = read(spark, d, "documents")
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.lower("text").rlike("https?://|www[.]")).alias("linked"), F.count_if(F.col("text").rlike("[^ ]+@[^ ]+")).alias("mail"))


@query("size_labels", "SELECT page_id AS id, CASE WHEN n < 1024 THEN n || ' B' ELSE format('{:.1f} KB', floor(n / 1024 * 10 + 0.5) / 10) END AS label FROM (SELECT page_id, strlen(html) AS n FROM pages)")
def size_labels(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), T.file_size(F.octet_length("html")).alias("label"))


@query("error_kinds", r"""SELECT CASE WHEN k <> '' THEN k WHEN regexp_matches(m, '권한이 없|로그인') THEN '권한/로그인 필요' WHEN regexp_matches(m, '찾을 수 없|삭제|404') THEN '원문 없음' WHEN regexp_matches(m, '본문|추출|구조') THEN '본문 추출 실패' ELSE substr(m, 1, 60) END AS kind, count(*) AS n
FROM (SELECT m, regexp_extract(m, '^\[([a-z_]+)\]', 1) AS k FROM (SELECT trim(regexp_replace(CASE event_id % 6 WHEN 0 THEN '[server_error]  gone' WHEN 1 THEN ' 로그인   필요' WHEN 2 THEN 'page 404' WHEN 3 THEN '본문 구조가 다름' WHEN 4 THEN '[Other] x' ELSE 'other   ' || event_type END, '\s+', ' ', 'g')) AS m FROM events)) GROUP BY 1""")
def error_kinds(spark, d):
    k = F.col("event_id") % 6
    m = F.when(k == 0, "[server_error]  gone").when(k == 1, " 로그인   필요").when(k == 2, "page 404").when(k == 3, "본문 구조가 다름").when(k == 4, "[Other] x").otherwise(F.concat(F.lit("other   "), "event_type"))
    return read(spark, d, "events").groupBy(T.error_kind(m).alias("kind")).agg(F.count("*").alias("n"))


@query("short_ids", "SELECT c_custkey AS id, substr(sha1(c_name || '|' || c_mktsegment), 1, 10) AS short FROM customer")
def short_ids(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), I.short_sha1(10, F.col("c_name"), F.col("c_mktsegment")).alias("short"))


@query("typed_ids")
def typed_ids(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), I.typed_id("org", F.lit("u"), F.col("n_name")).alias("typed"))


@query("page_texts")
def page_texts(spark, d):
    p = read(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), H.html_text_udf("html").alias("text"), H.sanitize_udf("html").alias("clean"), H.publish_html_udf("html").alias("published"), F.size(H.images_udf("html")).alias("images"))


@query("page_links", """SELECT page_id AS id, u.h AS href, u.l AS label FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1), regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2))) AS z FROM pages), LATERAL (SELECT z[1] AS h, z[2] AS l) AS u""")
def page_links(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.explode(H.anchors(F.col("html"))).alias("a"))
    return p.select("id", "a.href", "a.label")


@query("host_groups", r"""SELECT page_id AS id, CASE WHEN len(l) > 3 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l, '.') END AS host_group FROM (SELECT page_id, string_split(lower(repeat('a.', CAST(page_id % 3 AS INTEGER)) || regexp_extract(url, '^https?://([^/:]+)', 1)), '.') AS l FROM pages)""")
def host_groups(spark, d):
    host = F.concat(F.repeat(F.lit("A."), (F.col("page_id") % 3).cast("int")), F.regexp_extract("url", "^https?://([^/:]+)", 1))
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), T.host_group(host).alias("host_group"))


@query("http_kinds", """SELECT event_id AS id, CASE WHEN code = 429 THEN 'rate_limited' WHEN code IN (401, 403) THEN 'access_denied' WHEN code = 404 THEN 'not_found' WHEN code >= 500 THEN 'server_error' WHEN code >= 400 THEN 'http_error' WHEN event_id % 12 = 1 THEN 'too_large' END AS kind
FROM (SELECT event_id, [200, 200, 204, 301, 401, 403, 404, 410, 418, 429, 500, 503][event_id % 12 + 1] AS code FROM events)""")
def http_kinds(spark, d):
    """A response for each event: twelve codes, one of them with too much behind it."""
    k = F.col("event_id") % 12
    code = F.get(F.array(*map(F.lit, (200, 200, 204, 301, 401, 403, 404, 410, 418, 429, 500, 503))), k.cast("int"))
    size = F.when(k == 1, (8 << 20) + 1).otherwise(1000)
    kind = F.coalesce(R.status_kind(code), R.status_kind(code, size))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"))


