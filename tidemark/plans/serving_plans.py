"""Listings, cards, departments and feeds as they are served."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import serving as S

from .binding import nodes, query, read
from .tree_plans import CLOSURE

NOW = "1999-01-01 00:00:00"


@query("listed_items", f"""WITH s AS (SELECT o_orderkey AS id, o_orderdate AS last_seen, o_orderkey % 5 AS streak, o_orderkey % 7 = 0 AS pinned, o_orderkey % 3 <> 0 AS listed, o_orderkey % 6 = 1 AS is_new FROM orders),
n AS (SELECT *, last_seen + INTERVAL 180 DAY > TIMESTAMP '{NOW}' AND NOT is_new AS fresh, id % 2 = 0 AS pin FROM s)
SELECT id, strftime(CASE WHEN listed AND NOT fresh THEN TIMESTAMP '{NOW}' ELSE last_seen END, '%Y-%m-%d') AS last_seen, CASE WHEN listed THEN 'available' ELSE 'missing' END AS status,
  CASE WHEN listed THEN 0 ELSE streak END AS streak, CASE WHEN listed THEN pin ELSE pinned END AS pinned, listed AS changed FROM n""")
def listed_items(spark, d):
    """Items after a listing was read: touched, new or left alone."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    stored = o.where(k % 6 != 1).select(k.alias("id"), F.col("o_orderdate").cast("timestamp").alias("last_seen"), F.lit("missing").alias("status"), (k % 5).cast("int").alias("streak"), (k % 7 == 0).alias("pinned"))
    got = S.listed(stored, o.where(k % 3 != 0).select(k.alias("id"), (k % 2 == 0).alias("pinned")), F.lit(NOW).cast("timestamp"), "180 DAYS")
    return got.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query("category_rows", """SELECT o_orderkey AS id, 'a' || o_orderkey % 3 AS code, true AS is_primary FROM orders
UNION ALL SELECT o_orderkey, c, false FROM orders, (VALUES ('a0'), ('a1'), ('b')) AS t(c) WHERE c <> 'a' || o_orderkey % 3""")
def category_rows(spark, d):
    code = lambda x: F.lit(x)
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a"), (F.col("o_orderkey") % 3).cast("string")).alias("main"), F.array(code("a0"), code("b"), code("a1"), code("b")).alias("others"))
    return S.category_rows(o)


@query("board_order", "SELECT c_custkey AS id, c_mktsegment AS organization, c_acctbal > 0 AS live, c_custkey AS position, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS first FROM customer")
def board_order(spark, d):
    return S.board_order(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("organization"), (F.col("c_acctbal") > 0).alias("live"), F.col("c_custkey").alias("position")))


@query("card_rows", """SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) + 1 AS shown FROM orders""")
def card_rows(spark, d):
    """How many rows of each card are shown."""
    k = F.col("o_orderkey")
    row = lambda v, has, c: F.struct(v.alias("value"), F.lit(has).alias("has_condition"), c.alias("condition"))
    none = F.lit(None).cast("string")
    rows = F.array(row(F.when(k % 2 == 0, "v").otherwise(" "), False, none), row(F.lit("v"), True, F.when(k % 3 == 0, "c").otherwise("  ")), row(F.lit("w"), False, none), row(none, False, none), row(F.lit("x"), True, none))
    return read(spark, d, "orders").select(k.alias("id"), F.size(S.kept_rows(rows)).alias("shown"))


@query("card_matches", "SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' AS shown FROM orders")
def card_matches(spark, d):
    """Queries that bring up a card; a term of one character never does."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.matches_card(F.col("o_orderpriority"), F.array(F.lit("Ur gent"), F.lit("H"))).alias("shown"))


@query("alias_words", "SELECT o_orderkey AS id, trim(CASE WHEN o_orderpriority = '1-URGENT' THEN 'now asap ' WHEN o_orderpriority = '5-LOW' THEN 'later ' ELSE '' END || CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END) AS words FROM orders")
def alias_words(spark, d):
    rules = [("urg ENT", ["now", "asap"]), ("low", ["later"]), ("state f", ["done"]), ("", ["never"])]
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.alias_words([F.col("o_orderpriority"), F.concat(F.lit("state "), F.col("o_orderstatus"))], rules).alias("words"))


@query("department_organizations", """WITH o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 8 THEN c_custkey - c_custkey % 2 ELSE c_custkey END AS root FROM customer)
SELECT 'D' || w.c_custkey // 2 || CASE WHEN w.c_custkey % 4 = 0 THEN '학과' ELSE '전공' END AS name, root, id FROM customer w JOIN o ON root = w.c_custkey
WHERE w.c_custkey % 2 = 0 AND (w.c_custkey % 4 = 0 OR w.c_custkey % 10 < 8 OR NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey = w.c_custkey + 1))""")
def department_organizations(spark, d):
    """Names of departments to organizations: exactly, or by what comes before their ending; several roots are none."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    base = F.concat(F.lit("D"), F.floor(k / 2).cast("string"))
    root = F.when(k % 10 < 8, k - k % 2).otherwise(k)
    organizations = c.select(k.alias("id"), F.concat(base, F.when(k % 2 == 0, "학과").otherwise("학부")).alias("name"), F.lit(True).alias("is_department"), root.alias("root"))
    wanted = c.where(k % 2 == 0).select(F.concat(base, F.when(k % 4 == 0, "학과").otherwise("전공")).alias("name"))
    return S.department_organizations(wanted, organizations)


@query("served_freshness", "SELECT o_custkey AS source, o_orderkey AS id, CASE WHEN c_acctbal > 0 THEN 'fresh' ELSE 'stale' END AS freshness, c_nationkey AS checked FROM orders JOIN customer ON c_custkey = o_custkey")
def served_freshness(spark, d):
    """Freshness put back on served rows by their source."""
    known = read(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.when(F.col("c_acctbal") > 0, "fresh").otherwise("stale").alias("code"), F.col("c_nationkey").alias("checked"))
    return S.with_freshness(read(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("id")), known)


@query("rolled_up", f"""WITH RECURSIVE {CLOSURE}, r AS (SELECT descendant, min_by(ancestor, depth) AS drawn FROM c JOIN nodes ON id = ancestor WHERE NOT is_alias GROUP BY descendant)
SELECT coalesce(drawn, 'c' || o_custkey) AS id, count(*) AS n FROM orders LEFT JOIN r ON descendant = 'c' || o_custkey GROUP BY 1""")
def rolled_up(spark, d):
    """Orders of customers, those of aliases counted under what they stand for."""
    counts = read(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(F.count("*").alias("n"))
    return S.rolled_up(counts, nodes(spark, d))


@query("consistent_pages", """WITH p AS (SELECT user_id AS feed, event_id AS page, CASE WHEN user_id % 3 = 0 THEN 'r' || event_id % 2 WHEN user_id % 3 = 1 THEN 'r' ELSE '' END AS revision FROM events),
f AS (SELECT feed, min(page) AS first, min(revision) AS low, max(revision) AS high FROM p GROUP BY feed) SELECT feed, page, revision FROM p JOIN f USING (feed) WHERE page = first OR low = high""")
def consistent_pages(spark, d):
    user, k = F.col("user_id"), F.col("event_id")
    revision = F.when(user % 3 == 0, F.concat(F.lit("r"), (k % 2).cast("string"))).when(user % 3 == 1, "r").otherwise("")
    return S.consistent_pages(read(spark, d, "events").select(user.alias("feed"), k.alias("page"), revision.alias("revision")))


@query("iso_stamps", "SELECT event_id AS id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS stamp FROM events")
def iso_stamps(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), S.iso_stamp(F.col("ts")).alias("stamp"))
