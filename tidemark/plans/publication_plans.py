"""Publishing: objects, manifests, pages, retention and export plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import publication as P
from tidemark.operators import search as S

from .binding import NOTICES_SQL, notices, query, read

ORDER = 'date DESC NULLS LAST, "at" DESC NULLS LAST, first_seen DESC NULLS LAST, id DESC'


@query("page_files", f"WITH {NOTICES_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY {ORDER}) - 1 AS position FROM notices WHERE status = 'visible'), p AS (SELECT *, position // 50 + 1 AS page FROM n) SELECT page, count(*) AS n, string_agg(id, ',' ORDER BY position) AS ids FROM p GROUP BY page")
def page_files(spark, d):
    """Fifty notices a page, in list order; positions come from a distributed numbering."""
    n = P.number(notices(spark, d).where("status = 'visible'"), S.newest_first(), 50)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"].cast("string")), ",")
    return n.groupBy("page").agg(F.count("*").alias("n"), ids.alias("ids"))


@query("index_shards", f"WITH {NOTICES_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY {ORDER}) - 1 AS position FROM notices) SELECT position // 2000 AS shard, count(*) AS n, min(id) AS lo, max(id) AS hi FROM n GROUP BY 1")
def index_shards(spark, d):
    n = P.number(notices(spark, d), S.newest_first(), 2000, "shard")
    return n.groupBy((F.col("shard") - 1).alias("shard")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


OBJECT = """SELECT n_nationkey AS key, '{"alias":null,"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS payload FROM nation"""


@query("content_objects", f"SELECT key, payload, 'v1/objects/' || sha256(payload) || '.json' AS object FROM ({OBJECT})")
def content_objects(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("alias"))
    return P.content_objects(n, F.col("id"), ["name", "id", "alias"])


@query("new_objects", f"SELECT 'v1/objects/' || sha256(payload) || '.json' AS object FROM ({OBJECT}) WHERE key >= 10")
def new_objects(spark, d):
    o = content_objects(spark, d)
    return P.new_objects(o, o.where("key < 10")).select("object")


@query("manifest_diff", """WITH l AS (SELECT o_orderkey AS key, md5(o_orderstatus) AS o FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT o_orderkey AS key, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END) AS o FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'only_left' WHEN l.key IS NULL THEN 'only_right' WHEN l.o <> r.o THEN 'differs' ELSE 'same' END AS state FROM l FULL JOIN r ON l.key = r.key""")
def manifest_diff(spark, d):
    o = read(spark, d, "orders").withColumn("key", F.col("o_orderkey"))
    left = o.where("key % 5 <> 0").select("key", F.md5("o_orderstatus").alias("object"))
    right = o.where("key % 3 <> 0").select("key", F.md5(F.when(F.col("key") % 7 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("object"))
    return P.compare_manifests(left, right)


EXPORT = """live AS (SELECT o_orderkey AS id, o_orderdate AS stamp, o_custkey AS revision, o_orderkey % 17 = 0 AS adjusting FROM orders WHERE o_orderkey % 4 <> 0),
state AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS stamp, o_custkey AS revision, CASE WHEN o_orderkey % 19 <> 0 THEN 'e' END AS entry FROM orders WHERE o_orderkey % 5 <> 0),
excluded AS (SELECT o_orderkey AS id, o_orderdate AS stamp, o_custkey AS revision FROM orders WHERE o_orderkey % 10 = 5)"""


@query("export_plan", f"""WITH {EXPORT} SELECT coalesce(l.id, s.id, x.id) AS id, CASE WHEN l.id IS NULL THEN 'dropped' WHEN s.id IS NOT NULL AND l.stamp = s.stamp AND l.revision = s.revision AND s.entry IS NOT NULL AND NOT l.adjusting THEN 'reused' WHEN s.id IS NOT NULL THEN 'changed'
WHEN x.id IS NOT NULL AND l.stamp = x.stamp AND l.revision = x.revision THEN 'excluded_kept' ELSE 'added' END AS action FROM live l FULL JOIN state s ON l.id = s.id FULL JOIN excluded x ON x.id = coalesce(l.id, s.id)""")
def export_plan(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stamp"), F.col("o_custkey").alias("revision"))
    live = o.where("id % 4 <> 0").withColumn("adjusting", F.col("id") % 17 == 0)
    state = o.where("id % 5 <> 0").withColumn("stamp", F.when(F.col("id") % 6 == 0, F.col("stamp") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("stamp"))).withColumn("entry", F.when(F.col("id") % 19 != 0, "e"))
    return P.plan_export(live, state, o.where("id % 10 = 5"))


@query("export_ratio", f"WITH {EXPORT}, c AS (SELECT count(*) AS total, count(*) FILTER (s.id IS NULL OR l.stamp <> s.stamp) AS changed FROM live l LEFT JOIN state s ON l.id = s.id) SELECT total, changed, CASE WHEN total = 0 OR changed / total > 0.3 THEN 'full' ELSE 'incremental' END AS mode FROM c")
def export_ratio(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stamp"))
    state = o.where("id % 5 <> 0").select("id", F.when(F.col("id") % 6 == 0, F.col("stamp") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("stamp")).alias("old"))
    c = o.where("id % 4 <> 0").join(state, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("old").isNull() | (F.col("old") != F.col("stamp"))).alias("changed"))
    return c.withColumn("mode", F.when((F.col("total") == 0) | (F.col("changed") / F.col("total") > 0.3), "full").otherwise("incremental"))


@query("revision_retention", "SELECT event_id AS id, user_id AS source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def revision_retention(spark, d):
    return P.latest(read(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select(F.col("event_id").alias("id"), F.col("user_id").alias("source"))


@query("backup_retention", "SELECT event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE ts >= TIMESTAMP '2024-01-29' - INTERVAL 7 DAY OR (ts >= TIMESTAMP '2024-01-29' - INTERVAL 30 DAY AND n = 1)")
def backup_retention(spark, d):
    """All of the last seven days, the newest of each day before, nothing older than the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.to_date("ts")).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    e = read(spark, d, "events").withColumn("n", F.row_number().over(w))
    day = F.lit("2024-01-29").cast("timestamp_ntz")
    return e.where((F.col("ts") >= day - F.expr("INTERVAL 7 DAYS")) | ((F.col("ts") >= day - F.expr("INTERVAL 30 DAYS")) & (F.col("n") == 1))).select(F.col("event_id").alias("id"))


@query("carried_entries", "SELECT o_orderkey AS key, 'old' AS origin FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderstatus = 'O'")
def carried_entries(spark, d):
    o = read(spark, d, "orders")
    return o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("key"), F.lit("old").alias("origin")).unionByName(o.where("o_orderkey % 4 <> 0 AND o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"), F.lit("new").alias("origin")))


@query("positions", f"WITH {NOTICES_SQL} SELECT id, row_number() OVER (ORDER BY {ORDER}) - 1 AS position FROM notices")
def positions(spark, d):
    return P.number(notices(spark, d), S.newest_first(), 50).select("id", "position")
