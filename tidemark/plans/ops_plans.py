"""Self-checks, queues and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .binding import RUNS_SQL, query, read, runs

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("due_sources", f"""WITH {RUNS_SQL}, h AS (SELECT source, max(ts) AS last, max(ts) FILTER (NOT failed) AS ok, arg_max(failed, (ts, id)) AS failing FROM runs GROUP BY source)
SELECT source, last FROM h WHERE failing OR last <= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR ORDER BY last, source LIMIT 25""")
def due_sources(spark, d):
    """Sources whose interval has passed or whose last run failed, longest waiting first."""
    h = runs(spark, d).groupBy("source").agg(F.max("ts").alias("last"), F.max_by("failed", F.struct("ts", "id")).alias("failing"))
    return h.where(F.col("failing") | (F.col("last") <= now() - F.expr("INTERVAL 6 HOURS"))).select("source", F.col("last").cast("timestamp_ntz").alias("last")).orderBy("last", "source").limit(25)


@query("retry_items", f"WITH {RUNS_SQL} SELECT id, source FROM runs WHERE failed AND (id % 4 = 0 OR ts <= TIMESTAMP '{NOW}' - INTERVAL 10 DAY) ORDER BY CASE WHEN id % 4 = 0 THEN NULL ELSE ts END NULLS FIRST, id LIMIT 20")
def retry_items(spark, d):
    """Items with an error whose next attempt is unset or has come."""
    r = runs(spark, d).withColumn("next", F.when(F.col("id") % 4 != 0, F.col("ts")))
    return r.where(F.col("failed") & (F.col("next").isNull() | (F.col("next") <= now() - F.expr("INTERVAL 10 DAYS")))).orderBy(F.col("next").asc_nulls_first(), "id").limit(20).select("id", "source")


@query("access_failures", f"""WITH {RUNS_SQL}, w AS (SELECT source, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS b FROM runs)
SELECT source, count(*) AS failures, count(*) >= 3 AS stuck FROM w WHERE b = 0 GROUP BY source ORDER BY failures DESC, source LIMIT 20""")
def access_failures(spark, d):
    """Sources whose newest runs all failed, the most first; three in a row are stuck."""
    from tidemark.operators.state import newest_streak

    f = newest_streak(runs(spark, d), "source", [F.col("ts").desc(), F.col("id").desc()], ~F.col("failed")).where("streak > 0")
    return f.select("source", F.col("streak").alias("failures"), (F.col("streak") >= 3).alias("stuck")).orderBy(F.col("failures").desc(), "source").limit(20)


@query("zombie_runs", f"WITH {RUNS_SQL} SELECT id, source, round((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 3600, 1) AS hours FROM runs WHERE partial AND ts < TIMESTAMP '{NOW}' - INTERVAL 120 MINUTE")
def zombie_runs(spark, d):
    from tidemark.functions.dates import age_hours

    return runs(spark, d).where(F.col("partial") & (F.col("ts") < now() - F.expr("INTERVAL 120 MINUTES"))).select("id", "source", age_hours(F.col("ts"), now()).alias("hours"))


@query("date_pollution", "SELECT count(*) FILTER (o_orderdate > TIMESTAMP '2001-06-01') AS future, count(*) FILTER (o_orderdate < TIMESTAMP '1995-02-01') AS ancient FROM orders")
def date_pollution(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return read(spark, d, "orders").agg(F.count_if(F.col("o_orderdate") > at("2001-06-01")).alias("future"), F.count_if(F.col("o_orderdate") < at("1995-02-01")).alias("ancient"))


@query("window_shortfall", "SELECT o_custkey AS source, CAST(min(o_orderdate) AS DATE) AS oldest FROM orders GROUP BY 1 HAVING min(o_orderdate) > TIMESTAMP '1995-06-01' ORDER BY oldest DESC, source LIMIT 20", days=("oldest",))
def window_shortfall(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.min("o_orderdate").alias("oldest")).where(F.col("oldest") > F.lit("1995-06-01").cast("timestamp_ntz"))
    return o.select("source", F.to_date("oldest").alias("oldest")).orderBy(F.col("oldest").desc(), "source").limit(20)


@query("publish_delay", "SELECT max(o_orderdate) AS published, (SELECT max(l_shipdate) FROM lineitem) AS finished, round((epoch((SELECT max(l_shipdate) FROM lineitem)) - epoch(max(o_orderdate))) / 3600, 1) AS lag_hours FROM orders")
def publish_delay(spark, d):
    from tidemark.functions.dates import age_hours

    o = read(spark, d, "orders").agg(F.max("o_orderdate").alias("published"))
    l = read(spark, d, "lineitem").agg(F.max("l_shipdate").alias("finished"))
    return o.join(l, F.lit(True)).withColumn("lag_hours", age_hours(F.col("published"), F.col("finished")))  # one row each


@query("worst_status", f"WITH {RUNS_SQL}, s AS (SELECT source, CASE WHEN avg(CASE WHEN failed THEN 1 ELSE 0 END) > 0.25 THEN 'alert' WHEN count(*) FILTER (failed) > 0 THEN 'warn' ELSE 'ok' END AS status FROM runs GROUP BY source) SELECT max_by(status, CASE status WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM s")
def worst_status(spark, d):
    s = runs(spark, d).groupBy("source").agg(F.avg(F.when(F.col("failed"), 1).otherwise(0)).alias("share"), F.count_if("failed").alias("f"))
    s = s.select(F.when(F.col("share") > 0.25, "alert").when(F.col("f") > 0, "warn").otherwise("ok").alias("status"))
    rank = F.when(F.col("status") == "alert", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return s.agg(F.max_by("status", rank).alias("worst"), F.count("*").alias("n"))


@query("inventory", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus <> 'F') AS remaining, count(*) FILTER (o_orderstatus = 'P') AS blocked FROM orders")
def inventory(spark, d):
    s = F.col("o_orderstatus")
    return read(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("complete"), F.count_if(s != "F").alias("remaining"), F.count_if(s == "P").alias("blocked"))


@query("rotation", "SELECT c_custkey AS id FROM customer ORDER BY c_custkey <= 100, c_custkey LIMIT 60")
def rotation(spark, d):
    """The next ones after a cursor, from the start again at the end."""
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).orderBy(F.col("id") <= 100, "id").limit(60)


@query("preferred_mirrors", "SELECT host, url FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, url, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) ORDER BY NOT starts_with(url, 'https'), length(url), url) AS n FROM pages) WHERE n = 1")
def preferred_mirrors(spark, d):
    p = read(spark, d, "pages").select(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]*)", 1)).alias("host"), "url")
    w = Window.partitionBy("host").orderBy(~F.col("url").startswith("https"), F.length("url"), "url")
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("registry_sync", """WITH o AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS parent FROM nation WHERE n_nationkey <> 3), n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 8 = 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey % 6 = 1 THEN 0 ELSE n_regionkey END AS parent FROM nation WHERE n_nationkey <> 9)
SELECT count(*) FILTER (o.k IS NULL) AS added, count(*) FILTER (n.k IS NULL) AS retired, count(*) FILTER (o.name <> n.name) AS renamed, count(*) FILTER (o.parent <> n.parent) AS moved FROM o FULL JOIN n ON o.k = n.k""")
def registry_sync(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    old = n.where("k <> 3").select("k", F.col("name").alias("o_name"), F.col("parent").alias("o_parent"), F.lit(True).alias("o"))
    new = n.where("k <> 9").select("k", F.when(F.col("k") % 8 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"), F.when(F.col("k") % 6 == 1, 0).otherwise(F.col("parent")).alias("parent"), F.lit(True).alias("n"))
    j = old.join(new, "k", "full_outer")
    return j.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("retired"), F.count_if(F.col("o_name") != F.col("name")).alias("renamed"), F.count_if(F.col("o_parent") != F.col("parent")).alias("moved"))


@query("retire_missing", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def retire_missing(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("request_gaps", "SELECT source, count(*) AS close FROM (SELECT user_id AS source, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE ts < p + INTERVAL 30 MINUTE GROUP BY source")
def request_gaps(spark, d):
    """Per source, the runs that came sooner after the one before than the least gap allows."""
    w = Window.partitionBy("source").orderBy("ts", "id")
    r = runs(spark, d).select("source", "ts", F.lag("ts").over(w).alias("p"))
    return r.where(F.col("ts") < F.col("p") + F.expr("INTERVAL 30 MINUTES")).groupBy("source").agg(F.count("*").alias("close"))


@query("backfill_stall", f"""WITH {RUNS_SQL}, h AS (SELECT source, count(*) FILTER (failed) AS remaining, max(ts) AS last FROM runs GROUP BY source)
SELECT source, remaining, CASE WHEN remaining = 0 THEN 'complete' WHEN last < TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 'stalled' ELSE 'in_progress' END AS state FROM h""")
def backfill_stall(spark, d):
    """Sources with work left on which nothing has happened for a day."""
    h = runs(spark, d).groupBy("source").agg(F.count_if("failed").alias("remaining"), F.max("ts").alias("last"))
    state = F.when(F.col("remaining") == 0, "complete").when(F.col("last") < now() - F.expr("INTERVAL 1 DAY"), "stalled").otherwise("in_progress")
    return h.select("source", "remaining", state.alias("state"))
