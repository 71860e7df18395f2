"""How collection goes on and what it finds: cursors, lives, order proofs, frontiers, constraints."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.operators import auditing as A
from tidemark.operators import frontier as R
from tidemark.streaming import collection as C

from .binding import query, read

#: four looks at each source's listing: what there is by then, less what has been taken down
RUNS = [(1, "2024-01-12"), (2, "2024-01-16"), (3, "2024-01-23"), (4, "2024-01-31")]
PAGE, START = 4, datetime.date(2024, 1, 5)


def listing_pages(spark, d: str):
    """Events of a user as the items of a source, newest first, in pages."""
    e = read(spark, d, "events").select(F.col("user_id").cast("long").alias("source"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    runs = F.broadcast(spark.createDataFrame(RUNS, "run long, day string"))  # four rows
    seen = e.join(runs, (F.col("ts") < F.col("day").cast("timestamp")) & (F.col("id") % 13 != F.col("run")))
    order = F.struct(-F.unix_micros("ts"), F.col("id"))
    item = F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 97 != 0, F.to_date("ts")).alias("date"), (F.col("id") % 11 == 0).alias("pinned"))
    all_ = seen.groupBy("source", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"]).alias("items"))
    pages = F.transform(F.sequence(F.lit(1), F.ceil(F.size("items") / PAGE).cast("int")), lambda p: F.struct(p.alias("page"), F.slice("items", (p - 1) * PAGE + 1, PAGE).alias("items"), (p * PAGE < F.size("items")).alias("has_next")))
    return all_.select("source", "run", F.explode(pages).alias("p")).select("source", "run", "p.*")


@query("resume_cursors")
def resume_cursors(spark, d):
    """Where each source stands after each page that its runs asked for. Tests hold it against a replay in Python and against the stream."""
    return C.progress(listing_pages(spark, d), START).select("source", "run", "page", "cursor", "anchor", F.col("oldest").cast("string").alias("oldest"), "ordered", "below", "stop")


LOOKS_SQL = """turns AS (SELECT unnest(range(1, 9)) AS turn), looks AS (SELECT o_custkey AS notice, o_orderkey AS item, turn, (o_orderkey * 31 + (o_orderkey // 7) * turn) % 5 > 2 AS seen FROM orders, turns),
hands AS (SELECT DISTINCT o_custkey AS notice, turn, turn = 3 AS hidden FROM orders, turns WHERE o_custkey % 17 = 3 AND turn IN (3, 6))"""


def looks(spark, d):
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("turn")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("notice"), F.col("o_orderkey").alias("item"), turns)
    seen = (F.col("item") * 31 + F.floor(F.col("item") / 7) * F.col("turn")) % 5 > 2
    hands = o.where((F.col("notice") % 17 == 3) & F.col("turn").isin(3, 6)).select("notice", "turn", (F.col("turn") == 3).alias("hidden")).distinct()
    return o.withColumn("seen", seen), hands


@query("notice_lives", f"""WITH {LOOKS_SQL}, g AS (SELECT notice, turn, count(*) OVER w >= 3 AND NOT bool_or(seen) OVER w AS gone FROM looks WINDOW w AS (PARTITION BY notice, item ORDER BY turn ROWS 2 PRECEDING)),
t AS (SELECT notice, turn, bool_and(gone) AS gone FROM g GROUP BY 1, 2), s AS (SELECT t.notice, t.turn, CASE WHEN t.notice % 17 = 3 AND t.turn IN (3, 4, 5) THEN 'hidden' WHEN gone THEN 'removed' ELSE 'visible' END AS status FROM t)
SELECT notice, turn, status FROM (SELECT *, lag(status, 1, 'visible') OVER (PARTITION BY notice ORDER BY turn) AS was FROM s) WHERE status <> was""")
def notice_lives(spark, d):
    """When notices go with the last of their items, come back on sight of one, and stay hidden while an operator says so."""
    return C.lives(*looks(spark, d))


LISTED_SQL = """x AS (SELECT user_id AS source, event_id AS id, ts, CASE WHEN event_id % 397 <> 0 THEN CAST(ts AS DATE) - CASE WHEN event_id % 211 = 5 THEN 3 ELSE 0 END END AS date, event_id % 11 = 0 AS pinned,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1) // 4 + 1 AS page, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1) % 4 AS spot FROM events),
n AS (SELECT source, max(page) AS pages FROM x GROUP BY 1),
y AS (SELECT source, id, date, pinned, page, spot FROM x UNION ALL SELECT x.source, id, date, pinned, page + 1, spot + 4 FROM x JOIN n USING (source) WHERE source % 9 = 4 AND spot = 3 AND page < pages),
z AS (SELECT y.*, NOT pinned AS normal, max(page) OVER (PARTITION BY source) AS pages FROM y WHERE NOT (source % 13 = 6 AND page > 1)),
r AS (SELECT * FROM z UNION ALL SELECT source, id, date, pinned, 2, spot, normal, 2 FROM z WHERE source % 13 = 6)"""


def listings(spark, d: str):
    """Listings with faults: items without a date or with another one, items that come again on the next page, paging that gives the same page."""
    from pyspark.sql import Window

    e = read(spark, d, "events").select(F.col("user_id").cast("long").alias("source"), F.col("event_id").alias("id"), "ts")
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.col("ts").desc(), "id")) - 1
    date = F.when(F.col("id") % 397 != 0, F.date_sub(F.to_date("ts"), F.when(F.col("id") % 211 == 5, 3).otherwise(0)))
    x = e.select("source", "id", date.alias("date"), (F.col("id") % 11 == 0).alias("pinned"), (F.floor(k / 4) + 1).cast("int").alias("page"), (k % 4).cast("int").alias("at"))
    pages = x.groupBy("source").agg(F.max("page").alias("pages"))
    again = x.join(pages, "source").where("source % 9 = 4 AND at = 3 AND page < pages").select("source", "id", "date", "pinned", (F.col("page") + 1).alias("page"), (F.col("at") + 4).alias("at"))
    y = x.unionByName(again)
    stuck = F.col("source") % 13 == 6
    y = y.where(~stuck).unionByName(y.where(stuck & (F.col("page") == 1)).withColumn("page", F.explode(F.array(F.lit(1), F.lit(2)))))
    item = F.struct(F.col("id").cast("string").alias("id"), "date", "pinned")
    listed = y.groupBy("source", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("i")))), lambda s: s["i"]).alias("items"))
    last = y.groupBy("source").agg(F.max("page").alias("last"))
    return listed.join(last, "source").select("source", "page", "items", ((F.col("page") < F.col("last")) | (F.col("source") % 13 == 6)).alias("has_next"))


AUDIT_SQL = f"""WITH {LISTED_SQL}, s AS (SELECT source, page, list(id ORDER BY spot) AS sig FROM r WHERE normal GROUP BY 1, 2), rp AS (SELECT a.source, min(a.page) AS again FROM s a JOIN s b ON a.source = b.source AND a.sig = b.sig AND b.page < a.page GROUP BY 1),
k AS (SELECT r.*, again FROM r LEFT JOIN rp USING (source) WHERE page < coalesce(again, 1000000)),
i AS (SELECT *, last_value(date IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY source, id ORDER BY page, spot) AS nth FROM k WHERE normal),
f AS (SELECT source, page, CAST(id AS VARCHAR) AS id, 'unknown_date' AS kind FROM i WHERE date IS NULL UNION ALL SELECT source, page, CAST(id AS VARCHAR), 'date_inversion' FROM i WHERE before < date UNION ALL SELECT source, page, CAST(id AS VARCHAR), 'overlapping_normal_item' FROM i WHERE nth > 1)"""


@query("order_findings", f"{AUDIT_SQL} SELECT source, page, id, kind FROM f")
def order_findings(spark, d):
    """What stands against each listing's order."""
    return A.audited(listings(spark, d)).findings


@query("order_verdicts", f"""{AUDIT_SQL}, v AS (SELECT source, max(page) AS pages, count(DISTINCT CASE WHEN normal THEN id END) AS items, source % 13 <> 6 AND max(again) IS NULL AS ended, max(again) AS again FROM k GROUP BY 1)
SELECT source, pages, items, ended AND items > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.source = v.source) AS verified,
  CASE WHEN again IS NOT NULL THEN 'repeated_page' WHEN NOT ended THEN 'page_cap' WHEN items > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.source = v.source) THEN 'full_listing_monotonic' ELSE 'order_not_proven' END AS reason FROM v""")
def order_verdicts(spark, d):
    return A.audited(listings(spark, d)).verdicts.drop("evidence")


@query("order_proofs_applied", f"""{AUDIT_SQL}, b AS (SELECT DISTINCT source FROM f UNION SELECT source FROM r WHERE source % 13 = 6 UNION SELECT source FROM r GROUP BY source HAVING count(*) FILTER (normal) = 0), p AS (SELECT DISTINCT source FROM r)
SELECT source, outcome, CASE WHEN outcome = 'applied' THEN 2 ELSE CASE WHEN source % 19 = 3 THEN NULL ELSE 1 END END AS version FROM (SELECT source, CASE WHEN source IN (SELECT source FROM b) THEN 'not_verified' WHEN source % 7 = 2 THEN 'expired' WHEN source % 11 = 5 THEN 'evidence_differs' WHEN source % 17 = 1 OR source % 19 = 3 THEN 'config_changed' ELSE 'applied' END AS outcome FROM p)""")
def order_proofs_applied(spark, d):
    """Proofs against what is configured now: some have run out, some rest on other pages, some configurations have changed or gone meanwhile."""
    v = A.audited(listings(spark, d)).verdicts
    s = F.col("source")
    proofs = v.select("source", "verified", F.md5(s.cast("string")).alias("config_digest"), F.when(s % 11 == 5, "other").otherwise(F.col("evidence")).alias("evidence"), (now() + F.when(s % 7 == 2, F.expr("INTERVAL -1 HOURS")).otherwise(F.expr("INTERVAL 12 HOURS"))).alias("valid_until"))
    configs = v.where(s % 19 != 3).select("source", F.md5(F.when(s % 17 == 1, "changed").otherwise(s.cast("string"))).alias("digest"), F.lit(1).alias("version"))
    return A.proofs_applied(proofs, configs, v.select("source", "evidence"), now())


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


REGISTRY_SQL = """c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), ring AS (SELECT k, coalesce(lead(k) OVER (ORDER BY k), min(k) OVER ()) AS next FROM c WHERE k % 23 = 8),
o AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, NULL AS alias_of, NULL AS campus FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 5 = 0 THEN 'r' || n_regionkey END, 'A' FROM nation
  UNION ALL SELECT 'c' || c.k, CASE WHEN c.k % 23 = 8 THEN 'c' || ring.next WHEN c.k % 29 = 5 THEN 'nowhere' ELSE 'n' || n END, CASE WHEN c.k % 31 = 7 THEN 'c' || c.k WHEN c.k % 9 = 0 THEN 'n' || n WHEN c.k % 37 = 11 THEN 'n' || ((n + 1) % 25) END, CASE WHEN c.k % 41 = 3 THEN 'Z' ELSE 'B' END FROM c LEFT JOIN ring ON c.k = ring.k
  UNION ALL SELECT 'c' || k, 'n' || n, NULL, 'B' FROM c WHERE k % 43 = 9)"""


def registry(spark, d: str):
    """Organizations with planted faults of each kind."""
    from pyspark.sql import Window

    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    null = F.lit(None).cast("string")
    r = read(spark, d, "region").select(text("r", F.col("r_regionkey")).alias("id"), null.alias("parent"), null.alias("alias_of"), null.alias("campus"))
    up = text("r", F.col("n_regionkey"))
    na = read(spark, d, "nation").select(text("n", F.col("n_nationkey")), up, F.when(F.col("n_nationkey") % 5 == 0, up), F.lit("A"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    picked = c.where(k % 23 == 8)
    low = picked.agg(F.min(k)).first()[0]
    ring = picked.select("c_custkey", F.coalesce(F.lead("c_custkey").over(Window.orderBy("c_custkey")), F.lit(low)).alias("next"))
    parent = F.when(k % 23 == 8, text("c", F.col("next"))).when(k % 29 == 5, "nowhere").otherwise(text("n", n))
    alias = F.when(k % 31 == 7, text("c", k)).when(k % 9 == 0, text("n", n)).when(k % 37 == 11, text("n", (n + 1) % 25))
    cs = c.join(ring, "c_custkey", "left").select(text("c", k), parent, alias, F.when(k % 41 == 3, "Z").otherwise("B"))
    twice = c.where(k % 43 == 9).select(text("c", k), text("n", n), null, F.lit("B"))
    return r.union(na).union(cs).union(twice), spark.createDataFrame([("A",), ("B",)], "code string")


@query("registry_violations", f"""WITH RECURSIVE {REGISTRY_SQL}, one AS (SELECT id, min(parent) AS parent FROM o GROUP BY id),
w AS (SELECT id AS first, parent AS upper, 1 AS n FROM one UNION ALL SELECT w.first, one.parent, n + 1 FROM w JOIN one ON one.id = w.upper WHERE w.upper <> w.first AND n < 2000)
SELECT 'organization key is unique' AS "constraint", id AS key, id || ' x' || count(*) AS detail FROM o GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'parent exists', id, parent FROM o WHERE parent NOT IN (SELECT id FROM o) UNION ALL SELECT 'alias target exists', id, alias_of FROM o WHERE alias_of NOT IN (SELECT id FROM o)
UNION ALL SELECT 'campus exists', id, campus FROM o WHERE campus NOT IN ('A', 'B') UNION ALL SELECT 'no cycle', first, 'on a cycle' FROM w WHERE upper = first
UNION ALL SELECT 'no alias of itself', id, alias_of FROM o WHERE alias_of = id UNION ALL SELECT 'parent of an alias is its target', id, parent || '/' || alias_of FROM o WHERE alias_of <> parent
UNION ALL SELECT 'target is no alias', id, alias_of FROM o WHERE alias_of IN (SELECT id FROM o WHERE alias_of IS NOT NULL)""")
def registry_violations(spark, d):
    """Every constraint of the registry, broken rows as rows."""
    orgs, campuses = registry(spark, d)
    rules = [
        A.Constraint("organization key is unique", "unique", "organizations", ("id",)), A.Constraint("parent exists", "foreign", "organizations", ("parent",), ("organizations", "id")),
        A.Constraint("alias target exists", "foreign", "organizations", ("alias_of",), ("organizations", "id")), A.Constraint("campus exists", "foreign", "organizations", ("campus",), ("campuses", "code")),
        A.Constraint("no cycle", "acyclic", "organizations", ("id", "parent")), A.Constraint("no alias of itself", "rule", "organizations", ("alias_of",), holds=F.col("alias_of") != F.col("id")),
        A.Constraint("parent of an alias is its target", "rule", "organizations", ("parent", "alias_of"), holds=F.col("alias_of") == F.col("parent")),
        A.Constraint("target is no alias", "foreign", "aliases", ("alias_of",), ("real", "id")),
    ]
    # what an alias stands for must be among those that are none
    tables = {"organizations": orgs, "campuses": campuses, "aliases": orgs.join(orgs.select(F.col("id").alias("t")).distinct(), F.col("alias_of") == F.col("t"), "left_semi"), "real": orgs.groupBy("id").agg(F.max("alias_of").alias("a")).where("a IS NULL").select("id")}
    return A.violations(tables, rules, {"organizations": "id", "aliases": "id", "campuses": "code", "real": "id"})


def page_graph(spark, d: str):
    """Pages as those of ten hosts: a page is found at the address of its menu's first entry (the smallest page, where several have one), and links to all."""
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("h"), (F.col("page_id") % 10).cast("string")).alias("host"), H.anchors(F.col("html")).alias("l")).where(F.size("l") > 0)
    p = p.withColumn("path", F.col("l")[0]["href"])
    first = p.groupBy("host", "path").agg(F.min_by("l", "page_id").alias("l"), F.min("page_id").alias("page_id"))
    links = first.select("host", "path", F.posexplode("l").alias("pos", "a")).select("host", "path", "pos", F.col("a.href").alias("target"))
    homes = first.groupBy("host").agg(F.min_by("path", "page_id").alias("path"))
    return homes, first.select("host", "path"), links


@query("frontier_visits")
def frontier_visits(spark, d):
    """What a visit of each host from its first page on sees, and why it stops. Tests hold it against a queue in Python."""
    return R.visits(*page_graph(spark, d), depth=3, budget=12)
