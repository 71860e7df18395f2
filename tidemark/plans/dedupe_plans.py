"""Duplicate detection over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import dedupe as X

from .binding import ITEMS_SQL, items, query

PUNCT = T.PUNCTUATION.replace("'", "''")
TITLE = f"lower(trim(regexp_replace(regexp_replace(title, '{PUNCT}', ' ', 'g'), '\\s+', ' ', 'g')))"
LINES = f"trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(body, '\\r\\n|\\r|\\n'), lambda x: NOT regexp_matches(trim(x), '{T.BOILERPLATE}')), ' '), '\\s+', ' ', 'g'))"
PREPARED = f"""{ITEMS_SQL}, t AS (SELECT *, '  ' || {TITLE} || ' ' AS pad, {LINES} AS said FROM items),
p AS (SELECT id, source, title, body, list_distinct(list_transform(range(1, length(pad) - 1), lambda i: substr(pad, i, 3))) AS grams, CASE WHEN length(said) >= 40 THEN sha256(said) END AS print, length(body) AS chars FROM t),
k AS (SELECT print, count(*) AS n FROM p WHERE print IS NOT NULL GROUP BY print HAVING n BETWEEN 2 AND {X.LARGEST_BLOCK}),
pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.grams, b.grams)) AS i, len(a.grams) AS na, len(b.grams) AS nb, a.chars AS ca, b.chars AS cb FROM p a JOIN p b ON a.print = b.print AND a.id < b.id AND a.source <> b.source WHERE a.print IN (SELECT print FROM k)),
v AS (SELECT a, b, ca, cb, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE i / (na + nb - i) END AS sim FROM pairs),
w AS (SELECT a, b, CASE WHEN least(ca, cb) >= 200 AND sim >= 0.5 THEN 'merge' WHEN least(ca, cb) < 200 OR sim >= 0.86 THEN 'review' ELSE 'distinct' END AS decision, sim FROM v)"""


def prepared(spark, d):
    return X.prepare(items(spark, d))


@query("normalized_titles", f"WITH {ITEMS_SQL} SELECT id, {TITLE} AS title FROM items")
def normalized_titles(spark, d):
    return items(spark, d).select("id", T.normalize_title(F.col("title")).alias("title"))


@query("body_fingerprints", f"WITH {ITEMS_SQL}, t AS (SELECT id, {LINES} AS said FROM items) SELECT id, CASE WHEN length(said) >= 40 THEN sha256(said) END AS print FROM t")
def body_fingerprints(spark, d):
    return items(spark, d).select("id", T.body_fingerprint(F.col("body")).alias("print"))


@query("duplicate_pairs", f"WITH {PREPARED} SELECT a, b FROM pairs")
def duplicate_pairs(spark, d):
    return X.print_pairs(items(spark, d))


@query("oversized_blocks", f"WITH {PREPARED} SELECT print AS key, count(*) AS items FROM p WHERE print IS NOT NULL GROUP BY print HAVING count(*) > {X.LARGEST_BLOCK}")
def oversized_blocks(spark, d):
    """The blocks that duplicate_pairs leaves out, as the reference's backfill counts and logs them."""
    return X.oversized_blocks(prepared(spark, d), F.filter(F.array("print"), lambda x: x.isNotNull()))


@query("duplicate_verdicts", f"WITH {PREPARED} SELECT a, b, decision, round(CASE WHEN decision = 'merge' THEN greatest(sim, 0.95) ELSE sim END, 4) AS score FROM w")
def duplicate_verdicts(spark, d):
    v = X.judged(items(spark, d))
    return v.withColumn("score", F.round("score", 4))


@query("merge_targets", f"WITH RECURSIVE {PREPARED}, m AS (SELECT a, b FROM w WHERE decision = 'merge' UNION SELECT b, a FROM w WHERE decision = 'merge'), r AS (SELECT a AS x, a AS y FROM m UNION SELECT r.x, m.b FROM r JOIN m ON m.a = r.y) SELECT x AS node, min(y) AS target FROM r GROUP BY x")
def merge_targets(spark, d):
    v = X.judged(items(spark, d))
    return X.merge_targets(v.where("decision = 'merge'"))


@query("pick_primary", f"WITH {ITEMS_SQL} SELECT body_key, id FROM (SELECT sha256(title) AS body_key, id, row_number() OVER (PARTITION BY sha256(title) ORDER BY CAST(substr(source, 4) AS INTEGER), length(body) = 0, length(body) DESC, id) AS n FROM items) WHERE n = 1")
def pick_primary(spark, d):
    i = items(spark, d).withColumns({"body_key": F.sha2("title", 256), "rank": F.expr("int(substring(source, 4))"), "body_chars": F.length("body"), "published": F.lit(None).cast("date")})
    w = Window.partitionBy("body_key").orderBy(*X.primary_order())
    return i.withColumn("n", F.row_number().over(w)).where("n = 1").select("body_key", "id")




@query("verdict_rules", "SELECT * FROM (VALUES (1, 2, 'merge'), (1, 3, 'distinct'), (1, 4, 'distinct'), (5, 6, 'review'), (7, 8, 'review')) AS t(a, b, decision)")
def verdict_rules(spark, d):
    """Rules on wordings that the tables lack: equal bodies, another year's form, the same source, short bodies, posters."""
    body = "Scholarship forms are due at the office on the second floor. " * 5
    rows = [
        (1, "s1", "2025학년도 장학 안내", body, []),
        (2, "s2", "2025학년도 장학 안내", body, []),
        (3, "s2", "2026학년도 교환학생 모집", body + "x", []),
        (4, "s1", "2025학년도 장학 안내", body, []),
        (5, "s1", "기숙사 입사 신청", body[:100], []),
        (6, "s2", "기숙사 입사 신청", body[:100], []),
        (7, "s1", "행사 포스터", "", ["file:h/1/p"]),
        (8, "s2", "행사 포스터", "", ["file:h/1/p"]),
    ]
    i = X.prepare(spark.createDataFrame(rows, "id int, source string, title string, body string, posters array<string>"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6), (7, 8)], "a int, b int")
    return X.verdict(pairs, i).select("a", "b", "decision")
