"""Orders as notices with everything that their cards and pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import projection as P

from .binding import NOTICES_SQL, NOW, START, notices, query, read

CODES = [*P.CATEGORIES, "unheard_of"]
KINDS = ["university", "campus", "organization", "undetermined", "odd"]


def _pick(words: list[str], index):
    return F.array(*map(F.lit, words))[F.pmod(index, F.lit(len(words))).cast("int")]


def tables(spark, d: str) -> dict:
    k = F.col("id")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderdate")
    n = notices(spark, d).join(o, "id")
    day = F.to_date("o_orderdate")
    n = n.select(
        k, F.concat(F.lit("notice "), k.cast("string")).alias("title"), F.col("category").alias("excerpt"), F.when(k % 4 == 1, "note").alias("audience_note"), F.col("org").alias("source"),
        F.concat(F.lit("https://x/"), k.cast("string")).alias("url"), _pick([*P.STATUSES, "lost"], k).alias("original_status"), "pinned", F.col("curated").alias("exempt"), F.col("date").alias("published_date"), F.col("at").alias("published_at"),
        F.when(F.col("at").isNotNull(), "datetime").when(F.col("date").isNotNull(), "date").alias("precision"), F.col("first_seen").alias("first_visible"), F.col("first_seen").alias("updated"),
        F.when(k % 7 != 0, F.date_add(day, 30)).alias("deadline_date"), F.lit(None).cast("timestamp").alias("deadline_at"), _pick(["date", "datetime", "month"], k).alias("deadline_precision"), F.lit("until").alias("deadline_evidence"),
        F.when(k % 12 != 0, F.expr("repeat(o_orderpriority, CAST(id % 12 AS INT))")).alias("body_text"), F.when(k % 4 != 0, F.array(F.concat(F.lit("https://i/"), k.cast("string")))).alias("images"),
    )
    c = F.col("c_custkey")
    sources = read(spark, d, "customer").select(c.alias("id"), F.col("c_name").alias("name"), F.when(c % 5 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), (c % 40).cast("int"))).alias("last_checked"))
    l = read(spark, d, "lineitem").withColumns({"key": F.col("l_orderkey"), "part": F.col("l_partkey"), "line": F.col("l_linenumber"), "supp": F.col("l_suppkey")})
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) and y not in l.columns else F.col(y).cast("string") for y in x))
    own = text("key", "-", "line", "-", "part", "-", "supp")
    main = read(spark, d, "orders").where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("notice"), _pick(CODES, F.col("o_orderkey")).alias("code"), F.lit(True).alias("is_primary"))
    return {
        "notices": n,
        "sources": sources,
        "categories": main.union(l.select("key", _pick(CODES, F.col("part")), F.lit(False)).distinct()),
        "audiences": l.select(F.col("key").alias("notice"), own.alias("id"), _pick(KINDS, F.col("supp")).alias("type"), text("o", "supp").alias("organization"), F.concat(F.lit("c"), (F.col("part") % 6).cast("string")).alias("campus")),
        "campuses": read(spark, d, "region").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name")),
        "organizations": read(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.concat(F.lit("o"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")),
        "links": l.select(F.col("key").alias("notice"), text("i", "part", "-", "line").alias("item"), F.col("supp").alias("source"), text("https://x/", "part").alias("url"), F.to_date("l_shipdate").alias("published"), F.when(F.col("l_linestatus") == "O", "available").otherwise("removed").alias("status"), (F.col("line") == 1).alias("is_primary"), (F.col("l_returnflag") != "R").alias("is_active")),
        "attachments": l.select(F.col("key").alias("notice"), own.alias("id"), F.when(F.col("part") % 3 != 0, F.concat(F.lit("f"), (F.col("part") % 10).cast("string"))).alias("filename"), F.lit("file").alias("kind"), F.col("part").alias("size"), text("https://f/", "part").alias("url"), F.when(F.col("line") % 2 == 0, "listed").otherwise("gone").alias("status")),
        "mentions": l.select(F.col("key").alias("notice"), own.alias("id"), F.when(F.col("supp") % 11 != 0, text("call ", "supp")).alias("raw_text"), F.when(F.col("line") % 3 == 0, "fax").alias("channel"), F.when(F.col("line") % 2 == 1, text("part")).alias("value"), F.when(F.col("supp") % 9 != 0, F.col("supp")).alias("contact")),
    }


def shown(t: dict):
    return P.cards(*(t[k] for k in ("notices", "sources", "categories", "audiences", "campuses", "organizations", "links")), F.lit(NOW).cast("timestamp"), F.lit(START).cast("date"))


def _labels(labels: dict[str, str], code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {code} END"


def _place(labels, code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(labels)) + " ELSE 99 END"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CARDS_SQL = f"""{NOTICES_SQL}, l AS (SELECT *, l_orderkey AS key, l_partkey AS part, l_linenumber AS line, l_suppkey AS supp, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS own FROM lineitem),
second AS (SELECT key, string_agg(code || '=' || {_labels(P.CATEGORIES, 'code')}, ',' ORDER BY {_place(P.CATEGORIES, 'code')}, code) AS x FROM (SELECT DISTINCT key, ({_list(CODES)})[part % {len(CODES)} + 1] AS code FROM l) GROUP BY key),
aud AS (SELECT key, string_agg(CASE kind WHEN 'university' THEN 'university::대학 전체' WHEN 'campus' THEN 'campus:' || campus || ':' || coalesce(r_name, '캠퍼스') WHEN 'organization' THEN 'organization:' || org || ':' || coalesce(s_name, '조직') ELSE 'undetermined::대상 미확정' END, ','
  ORDER BY {_place(P.AUDIENCES, 'kind')}, org, campus, own) AS x FROM (SELECT *, ({_list(KINDS)})[supp % {len(KINDS)} + 1] AS kind, 'o' || supp AS org, 'c' || (part % 6) AS campus FROM l) a
  LEFT JOIN region ON r_regionkey = part % 6 LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0) s ON s_suppkey = supp GROUP BY key),
links AS (SELECT key, count(*) AS n, string_agg('i' || part || '-' || line || ' ' || coalesce(s_name, '') || ' ' || CAST(l_shipdate AS DATE) || ' ' || CASE l_linestatus WHEN 'O' THEN '접근 가능' ELSE '삭제 확인' END || CASE WHEN line = 1 THEN ' main' ELSE '' END, ','
  ORDER BY CASE WHEN line = 1 THEN 0 ELSE 1 END, coalesce(s_name, ''), 'i' || part || '-' || line, supp, l_shipdate) AS x FROM l LEFT JOIN supplier ON s_suppkey = supp WHERE l_returnflag <> 'R' GROUP BY key),
p AS (SELECT notices.*, o_orderdate, o_orderpriority, coalesce("at" > TIMESTAMP '{NOW}', date > CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), false) AS future, coalesce(pinned AND curated AND date < DATE '{START}', false) AS old FROM notices JOIN orders ON o_orderkey = id),
q AS (SELECT *, repeat(o_orderpriority, CAST(id % 12 AS INTEGER)) AS body, org % 40 AS hours FROM p),
cards AS (SELECT id, 'notice ' || id AS title, category AS excerpt, CASE WHEN id % 6 = 0 THEN 'other' ELSE ({_list(CODES)})[id % {len(CODES)} + 1] END AS main, coalesce(second.x, '') AS secondary, coalesce(aud.x, '') AS audiences, CASE WHEN id % 4 = 1 THEN 'note' END AS audience_note,
  org || ' ' || c_name AS source, coalesce(links.n, 0) AS source_count, CASE WHEN future THEN CAST(first_seen + INTERVAL 9 HOUR AS DATE) WHEN old THEN DATE '{START}' ELSE date END AS published_date, strftime(CASE WHEN future THEN first_seen WHEN NOT old THEN "at" END, '%Y-%m-%d %H:%M') AS published_at,
  CASE WHEN future THEN 'datetime' WHEN old THEN 'date' WHEN "at" IS NOT NULL THEN 'datetime' WHEN date IS NOT NULL THEN 'date' ELSE 'unknown' END AS published_precision, future OR old AS adjusted, CASE WHEN future OR old THEN date END AS original_date, strftime(CASE WHEN future OR old THEN "at" END, '%Y-%m-%d %H:%M') AS original_at,
  CASE WHEN id % 7 <> 0 AND id % 3 < 2 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) || ' ' || CASE id % 3 WHEN 0 THEN 'date' ELSE 'datetime' END || ' until' END AS deadline, ({_list([*P.STATUSES.values(), 'lost'])})[id % {len(P.STATUSES) + 1} + 1] AS original_status,
  CASE WHEN org % 5 = 0 THEN '확인 정보 없음' WHEN hours <= 3 THEN '최근 확인됨' WHEN hours <= 24 THEN '확인 지연' ELSE '오래 확인되지 않음' END AS freshness, pinned, CASE WHEN id % 4 <> 0 AND (id % 12 = 0 OR length(trim(body)) < 80) THEN 'https://i/' || id END AS poster
  FROM q JOIN customer ON c_custkey = org LEFT JOIN second ON second.key = id LEFT JOIN aud ON aud.key = id LEFT JOIN links ON links.key = id)"""


def _pairs(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat(x["code"], F.lit("="), x["label"])), ",")


def _minute(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


@query("notice_cards", f"""WITH {CARDS_SQL} SELECT id, title, excerpt, main || '=' || {_labels(P.CATEGORIES, 'main')} AS main, secondary, audiences, audience_note, source, source_count, published_date, published_at, published_precision, adjusted, original_date, original_at, deadline, original_status, freshness, pinned, poster FROM cards""", days=("published_date", "original_date"))
def notice_cards(spark, d):
    """Every notice's card; nested values as text."""
    c = shown(tables(spark, d))
    audiences = F.array_join(F.transform("audiences", lambda a: F.concat(a["type"], F.lit(":"), F.coalesce(a["id"], F.lit("")), F.lit(":"), a["name"])), ",")
    deadline = F.concat_ws(" ", F.col("deadline.date").cast("string"), "deadline.precision", "deadline.evidence")
    return c.select(
        "id", "title", "excerpt", F.concat("primary_category.code", F.lit("="), "primary_category.label").alias("main"), _pairs("secondary_categories").alias("secondary"), audiences.alias("audiences"), "audience_note",
        F.concat(F.col("primary_source.id").cast("string"), F.lit(" "), "primary_source.name").alias("source"), "source_count", "published_date", _minute("published_at").alias("published_at"), "published_precision", F.col("published_adjusted").alias("adjusted"),
        F.col("original_published_date").alias("original_date"), _minute("original_published_at").alias("original_at"), F.when(F.col("deadline").isNotNull(), deadline).alias("deadline"), F.col("original_status.label").alias("original_status"),
        F.col("freshness.label").alias("freshness"), F.col("is_pinned").alias("pinned"), F.col("poster_image").alias("poster"),
    )


@query("notice_details", f"""WITH {CARDS_SQL}, files AS (SELECT key, string_agg(coalesce(name, '-') || ' ' || own || ' ' || CASE WHEN line % 2 = 0 THEN '목록 확인됨' ELSE 'gone' END, ',' ORDER BY coalesce(name, ''), own) AS x FROM (SELECT *, CASE WHEN part % 3 <> 0 THEN 'f' || (part % 10) END AS name FROM l) GROUP BY key),
said AS (SELECT key, string_agg(coalesce(raw, '-') || ' ' || CASE WHEN line % 2 = 1 THEN CASE WHEN line % 3 = 0 THEN '팩스' ELSE '전화' END || ' ' || part ELSE '-' END || ' ' || CASE WHEN supp % 9 = 0 THEN '-' ELSE CAST(supp AS VARCHAR) END, ',' ORDER BY coalesce(raw, ''), own) AS x FROM (SELECT *, CASE WHEN supp % 11 <> 0 THEN 'call ' || supp END AS raw FROM l) GROUP BY key)
SELECT id, title, main, CASE WHEN id % 12 <> 0 THEN body END AS body, CASE WHEN id % 4 <> 0 THEN 1 ELSE 0 END AS pictures, coalesce(links.x, '') AS sources, coalesce(files.x, '') AS files, coalesce(said.x, '') AS mentions FROM cards JOIN (SELECT id, body FROM q) USING (id) LEFT JOIN links ON links.key = id LEFT JOIN files ON files.key = id LEFT JOIN said ON said.key = id""")
def notice_details(spark, d):
    """Every notice's page: its card with the body, pictures, sources, files and contacts; nested values as text."""
    t = tables(spark, d)
    got = P.details(t["notices"], shown(t), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t["links"], t["attachments"], t["mentions"])
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    sources = joined("sources", lambda s: F.concat(s["item"], F.lit(" "), F.coalesce(s["source_name"], F.lit("")), F.lit(" "), s["published"].cast("string"), F.lit(" "), s["status"]["label"], F.when(s["is_primary"], " main").otherwise("")))
    files = joined("attachments", lambda a: F.concat_ws(" ", dash(a["filename"]), a["id"], a["status"]["label"]))
    mentions = joined("contact_mentions", lambda m: F.concat_ws(" ", dash(m["raw_text"]), F.when(m["channel"].isNotNull(), F.concat_ws(" ", m["channel"]["kind"]["label"], m["channel"]["value"])).otherwise("-"), dash(m["contact"])))
    return got.select("id", "title", F.col("primary_category.code").alias("main"), F.col("body_text").alias("body"), F.size("images").alias("pictures"), sources.alias("sources"), files.alias("files"), mentions.alias("mentions"))
