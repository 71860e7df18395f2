"""Revisions of what is published: kept up to date, committed, read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import incremental as I
from tidemark.operators import publication as P
from tidemark.operators import search as S
from tidemark.sources import revisions as V

from .binding import NOTICES_SQL, notices, query, read

PAGE = 50

#: the list's order as one ascending number for each part: newest first, unknown last
LISTED_SQL = f"""{NOTICES_SQL}, listed AS (SELECT id, status, org,
  coalesce(-(date - DATE '1970-01-01'), 1000000000) AS k1, coalesce(-epoch_us("at"), 9000000000000000000) AS k2, -epoch_us(first_seen) AS k3, -id AS k4, md5(category || weight) AS digest FROM notices)"""


def listed(spark, d: str) -> DataFrame:
    """All notices as list entries: ``id, key, digest``."""
    n = notices(spark, d)
    parts = [F.coalesce(-F.datediff("date", F.lit("1970-01-01")), F.lit(1_000_000_000)), F.coalesce(-F.unix_micros("at"), F.lit(9_000_000_000_000_000_000)), -F.unix_micros("first_seen"), -F.col("id")]
    return n.select("id", "status", "org", F.struct(*(p.cast("long").alias(f"k{i}") for i, p in enumerate(parts, 1))).alias("key"), F.md5(F.concat("category", F.col("weight").cast("string"))).alias("digest"))


#: what has happened since the last revision, to about one notice in a hundred: some of the oldest fifth are new, have left, or are dated a day
#: later; any may have got another text
OLDEST = "k1 > -8402"
WAS_SQL = f"was AS (SELECT id, k1, k2, k3, k4, md5('old' || digest) AS d2, digest FROM listed WHERE status <> 'hidden' AND NOT (id % 97 = 3 AND {OLDEST}))"
NOW_SQL = f"""now_ AS (SELECT id, CASE WHEN id % 89 = 5 AND {OLDEST} THEN k1 - 1 ELSE k1 END AS k1, k2, k3, k4, CASE WHEN id % 401 = 9 THEN md5('new' || digest) ELSE digest END AS digest
  FROM listed WHERE status <> 'hidden' AND NOT (id % 83 = 7 AND {OLDEST} AND id % 97 <> 3))"""


def _pages_sql(rows: str) -> str:
    return f"SELECT p // {PAGE} AS page, count(*) AS n, md5(string_agg(id || ':' || digest, ',' ORDER BY p)) AS object FROM (SELECT *, row_number() OVER (ORDER BY k1, k2, k3, k4) - 1 AS p FROM {rows}) GROUP BY 1"


def _before_and_after(spark, d: str):
    rows = listed(spark, d).where("status <> 'hidden'")
    oldest, k = F.col("key.k1") > -8402, F.col("id")
    was = rows.where(~((k % 97 == 3) & oldest)).select("id", "key", "digest")
    new = rows.where(~((k % 83 == 7) & oldest & (k % 97 != 3)))
    later = F.col("key").withField("k1", F.when((k % 89 == 5) & oldest, F.col("key.k1") - 1).otherwise(F.col("key.k1")))
    new = new.select("id", later.alias("key"), F.when(k % 401 == 9, F.md5(F.concat(F.lit("new"), "digest"))).otherwise(F.col("digest")).alias("digest"))
    changed = new.where(((k % 97 == 3) | (k % 89 == 5) | (k % 401 == 9)))
    gone = rows.where((k % 83 == 7) & oldest & (k % 97 != 3)).select("id")
    return was, new, changed, gone


def incremental(spark, d: str) -> I.Revision:
    was, _, changed, gone = _before_and_after(spark, d)
    return I.maintained(I.built(was, PAGE), changed, gone, PAGE)


@query("incremental_pages", f"""WITH {LISTED_SQL}, {WAS_SQL.replace("md5('old' || digest) AS d2, ", "")}, {NOW_SQL}, o AS ({_pages_sql("was")}), w AS ({_pages_sql("now_")})
SELECT coalesce(w.page, o.page) AS page, coalesce(w.n, 0) AS n, w.object, CASE WHEN w.page IS NULL THEN 'removed' WHEN o.object = w.object THEN 'kept' ELSE 'rewritten' END AS state FROM w FULL JOIN o ON w.page = o.page""")
def incremental_pages(spark, d):
    """Pages after a change of about one notice in a hundred, from those before it; what is kept is not read."""
    return incremental(spark, d).pages.select("page", "n", "object", "state")


@query("incremental_positions", f"WITH {LISTED_SQL}, {NOW_SQL} SELECT id, row_number() OVER (ORDER BY k1, k2, k3, k4) - 1 AS position, digest FROM now_")
def incremental_positions(spark, d):
    return incremental(spark, d).entries.select("id", "position", "digest")


@query("publication_consistency", f"""WITH {LISTED_SQL}, {NOW_SQL}, w AS (SELECT count(*) AS n, count(*) FILTER (page % 7 = 2) AS stale, count(*) FILTER (page % 5 = 3) AS lost FROM ({_pages_sql("now_")}))
SELECT 'shadow' AS run, n AS compared, 0 AS mismatched, 0 AS missing, 0 AS extra, 'OK' AS status FROM w UNION ALL SELECT 'shadow, seven hours ago', n, 0, 0, 0, 'WARN' FROM w
UNION ALL SELECT 'stale pages', n, stale, 0, 0, CASE WHEN stale > 0 THEN 'ALERT' ELSE 'OK' END FROM w UNION ALL SELECT 'lost and unknown pages', n - lost, 0, lost, lost, CASE WHEN lost > 0 THEN 'ALERT' ELSE 'OK' END FROM w""")
def publication_consistency(spark, d):
    """The incremental build against the full one, and against builds with planted faults: pages that kept an old content, pages that are
    not there, pages under names that should not be."""
    _, new, _, _ = _before_and_after(spark, d)
    name = F.concat(F.lit("notices/page/"), F.col("page").cast("string"), F.lit(".json"))
    full = I.built(new, PAGE).pages.select("page", name.alias("key"), "object")
    ours = incremental(spark, d).pages.where("n > 0").select("page", name.alias("key"), "object")
    lost = F.col("page") % 5 == 3
    runs = {
        "shadow": (ours, 1), "shadow, seven hours ago": (ours, 7), "stale pages": (ours.withColumn("object", F.when(F.col("page") % 7 == 2, "old").otherwise(F.col("object"))), 1),
        "lost and unknown pages": (ours.withColumn("key", F.when(lost, F.concat(F.lit("old/"), "key")).otherwise(F.col("key"))), 1),
    }
    out = None
    for run, (other, hours) in runs.items():
        row = I.compared(full, other)
        now = F.lit("2024-01-31 12:00:00").cast("timestamp")
        status = I.consistency(F.col("mismatched"), F.col("missing"), F.col("extra"), now - F.expr(f"INTERVAL {hours} HOURS"), now)
        row = row.select(F.lit(run).alias("run"), "compared", "mismatched", "missing", "extra", status.alias("status"))
        out = row if out is None else out.union(row)
    return out


SHARD = 200
SHARDS_SQL = f'WITH {NOTICES_SQL}, n AS (SELECT id, org, status, weight, (row_number() OVER (ORDER BY date DESC NULLS LAST, "at" DESC NULLS LAST, first_seen DESC NULLS LAST, id DESC) - 1) // {SHARD} AS shard FROM notices)'


def sharded(spark, d: str) -> DataFrame:
    n = P.number(notices(spark, d), S.newest_first(), SHARD, "shard")
    return n.select("id", "org", "status", "weight", (F.col("shard") - 1).alias("shard"))


@query("revision_served", f"{SHARDS_SQL} SELECT 'r1' AS revision, shard, count(*) AS n, min(id) AS lo, max(id) AS hi, sum(weight) AS weight FROM n GROUP BY shard")
def revision_served(spark, d):
    """A reader beside a writer that has written the next revision but for its pointer: it sees the one before, whole."""
    base, rows = V.shared_path(spark, "revisions"), sharded(spark, d)
    V.publish(spark, base, "r1", "2024-01-31T00:00:00Z", {"index": rows})
    V.write_shards(base, "r2", "2024-01-31T01:00:00Z", {"index": rows.withColumn("weight", F.lit(0)).where("id % 2 = 0")})
    got = V.served(spark, base, ["index"])
    return got.tables["index"].groupBy(F.lit(got.revision).alias("revision"), F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("weight").cast("long").alias("weight"))


@query("revision_problems", f"""{SHARDS_SQL}, s AS (SELECT shard, min(id) AS lo FROM n GROUP BY shard)
SELECT 'index' AS name, shard, CASE shard % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'content' WHEN 2 THEN 'missing' ELSE 'revision' END AS problem FROM s WHERE shard % 5 <> 4 UNION ALL SELECT 'index', 100000, 'extra'""")
def revision_problems(spark, d):
    """Faults planted between manifest and shards: a row too few, a row that is another, no shard, a shard of another revision, one too many."""
    base, rows = V.shared_path(spark, "revisions"), sharded(spark, d)
    low = rows.groupBy("shard").agg(F.min("id").alias("lo"))
    kind, first = F.col("shard") % 5, F.col("id") == F.col("lo")
    bad = rows.join(low, "shard").where(~((kind == 0) & first) & (kind != 2)).withColumn("weight", F.when((kind == 1) & first, F.col("weight") + 1).otherwise(F.col("weight"))).drop("lo")
    more = spark.range(3).select("id", F.lit(1).cast(rows.schema["org"].dataType).alias("org"), F.lit("visible").alias("status"), F.lit(1).cast("long").alias("weight"), F.lit(100_000).cast("long").alias("shard"))
    stamped = lambda df, revision: df.withColumns({"revision": F.lit(revision), "generated_at": F.lit("t")})
    whole = stamped(bad.where(kind != 3).unionByName(more), "r1").unionByName(stamped(bad.where(kind == 3), "r0"))
    V.write_table(whole, f"{base}/r/r1/index")
    V.write_manifest(base, "r1", "t", {"index": rows})
    V.point(spark, base, "r1", "t")
    return V.served(spark, base, ["index"]).problems


@query("snapshot_damage", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 5 THEN 'lost' WHEN o_orderkey % 97 = 7 THEN 'doubled' ELSE 'changed' END AS finding FROM orders WHERE o_orderkey % 97 IN (5, 7, 11)")
def snapshot_damage(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    k = F.col("id") % 97
    after = o.where(k != 5).withColumn("o_totalprice", F.when(k == 11, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return V.damage(o, after.unionByName(o.where(k == 7)), "id")


@query("snapshot_verified", "SELECT kind, n AS rows, total AS expected, kind = 'whole' AS intact FROM (SELECT 'whole' AS kind, count(*) AS n, count(*) AS total FROM orders UNION ALL SELECT 'one row lost', count(*) - 1, count(*) FROM orders UNION ALL SELECT 'one row in place of another', count(*), count(*) FROM orders)")
def snapshot_verified(spark, d):
    """A snapshot beside its sidecar: as written, with a row lost, and with a row in place of another."""
    o, out = read(spark, d, "orders"), None
    first = o.agg(F.min("o_orderkey")).first()[0]
    faults = {"whole": None, "one row lost": o.where(F.col("o_orderkey") != first), "one row in place of another": o.withColumn("o_custkey", F.when(F.col("o_orderkey") == first, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))}
    for kind, fault in faults.items():
        path = V.shared_path(spark, "snapshot")
        V.snapshot(o, path)
        if fault is not None:
            fault.write.mode("overwrite").parquet(f"{path}/rows")
        row = V.verified(spark, path).select(F.lit(kind).alias("kind"), "rows", "expected", "intact")
        out = row if out is None else out.union(row)
    return out
