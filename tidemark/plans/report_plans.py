"""Events as runs of collections, users as their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reports as R

from .binding import query, read

NOW, UNTIL = "2024-01-30 12:00:00", "2024-02-10 00:00:00"


def runs(spark, d: str):
    """Events as runs: errors have failed; of the last day some are under way."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    state = F.when((F.col("ts") > F.lit("2024-01-30").cast("timestamp")) & (F.col("event_id") % 50 == 7), "queued").otherwise("completed")
    result = F.when(F.col("event_type") == "error", "failure").when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), "timed_out").otherwise("success")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created"), state.alias("state"), result.alias("result"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("finished"), F.col("user_id").alias("source"))


RUNS_SQL = """runs AS (SELECT event_id AS id, ts AS created, CASE WHEN ts > TIMESTAMP '2024-01-30' AND event_id % 50 = 7 THEN 'queued' ELSE 'completed' END AS state,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'timed_out' ELSE 'success' END AS result, ts + INTERVAL 5 MINUTE AS finished, user_id AS source FROM events)"""


@query("runs_in_short", f"""WITH {RUNS_SQL}, broke AS (SELECT max(created) AS b FROM runs WHERE state <> 'queued' AND result = 'success')
SELECT count(*) FILTER (state = 'queued') AS active, count(*) FILTER (created >= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE) AS recent, count(*) FILTER (state <> 'queued' AND result <> 'success' AND created > b) AS failures, max(created) AS last_created FROM runs, broke""")
def runs_in_short(spark, d):
    return R.runs_in_short(runs(spark, d), F.lit(NOW).cast("timestamp"))


INVENTORY_SQL = f"""WITH {RUNS_SQL}, broke AS (SELECT max(created) AS b FROM runs WHERE state <> 'queued' AND result = 'success'),
s AS (SELECT count(*) FILTER (state = 'queued') AS active, count(*) FILTER (created >= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE) AS recent, count(*) FILTER (state <> 'queued' AND result <> 'success' AND created > b) AS failures, max(created) AS last_created, max(finished) FILTER (state <> 'queued') AS last_activity FROM runs, broke),
t AS (SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS complete FROM customer),
v AS (SELECT *, total - complete AS remaining, round(epoch(TIMESTAMP '{NOW}' - greatest(last_activity, last_created)) / 60, 1) AS idle_minutes FROM s, t)"""


@query("watchdog_report", f"""{INVENTORY_SQL} SELECT reason = 'dispatch' AS dispatch, * FROM (SELECT CASE WHEN total = 0 THEN 'no targets' WHEN remaining <= 0 THEN 'complete' WHEN active > 0 THEN 'running' WHEN failures >= 3 THEN 'failing'
  WHEN epoch(TIMESTAMP '{NOW}' - last_created) / 60 < 10 THEN 'cooling down' WHEN recent >= 4 THEN 'too many' ELSE 'dispatch' END AS reason, total, complete, remaining, idle_minutes, idle_minutes >= {R.STALE_MINUTES} AS stalled, greatest(last_activity, last_created) AS last_activity, active, recent, failures, last_created FROM v)""")
def watchdog_report(spark, d):
    """Customers as the sources to collect, complete where their balance is positive."""
    r = runs(spark, d)
    activity = r.select(F.col("created").alias("started"), F.when(F.col("state") != "queued", F.col("finished")).alias("finished"))
    inventory = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("complete"))
    return R.watchdog_report(inventory, r, activity, F.lit(UNTIL).cast("timestamp"), F.lit(NOW).cast("timestamp"))


LINES_SQL = f"""{RUNS_SQL}, h AS (SELECT source, max(created) FILTER (result = 'success') AS last_success, count(*) FILTER (result <> 'success') % 4 AS failures FROM runs GROUP BY source),
lines AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'paused' END AS status, last_success, coalesce(failures, 0) AS failures,
  CASE WHEN source IS NULL THEN 'not_started' WHEN failures = 0 THEN 'complete' ELSE 'in_progress' END AS backfill, source IS NOT NULL AND failures = 0 AS complete, CASE WHEN failures > 2 THEN 'budget' END AS stop_reason FROM customer LEFT JOIN h ON source = c_custkey WHERE c_custkey % 11 <> 0)"""


def lines(spark, d: str):
    good = F.col("result") == "success"
    health = runs(spark, d).groupBy(F.col("source").alias("id")).agg(F.max(F.when(good, F.col("created"))).alias("last_success"), (F.count(F.when(~good, 1)) % 4).alias("failures"))
    health = health.withColumns({"complete": F.col("failures") == 0, "backfill": F.when(F.col("failures") == 0, "complete").otherwise("in_progress"), "stop_reason": F.when(F.col("failures") > 2, "budget")})
    k = F.col("c_custkey")
    sources = read(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, "active").otherwise("paused").alias("status"), (k % 11 != 0).alias("public"))
    return R.status_lines(sources, health)


@query("status_lines", f"WITH {LINES_SQL} SELECT * FROM lines")
def status_lines(spark, d):
    return lines(spark, d)


@query("publication_status", f"""WITH {LINES_SQL}, n AS (SELECT created, finished, result FROM runs ORDER BY created DESC, id DESC LIMIT 1)
SELECT count(*) AS sources, count(*) FILTER (status = 'active') AS active, count(*) FILTER (failures > 0) AS failing, count(*) FILTER (complete) AS backfilled, count(*) FILTER (NOT complete) AS to_backfill,
  any_value(n.created) AS last_started, any_value(n.finished) AS last_finished, any_value(n.result) AS last_result FROM lines, n""")
def publication_status(spark, d):
    """One row over all sources' lines and the newest collection."""
    r = runs(spark, d)
    return R.publication_status(lines(spark, d), r.select("id", F.col("created").alias("started"), "finished", "result"))


@query("catalogue", """SELECT (SELECT string_agg(r_regionkey || '=' || r_name, ',' ORDER BY r_name, r_regionkey) FROM region) AS campuses,
  (SELECT string_agg(vocabulary || ':' || words, ';' ORDER BY vocabulary) FROM (SELECT vocabulary, string_agg(code || '=' || label, ',' ORDER BY code) AS words FROM
    (SELECT DISTINCT 'category' AS vocabulary, lower(substr(o_orderpriority, 3)) AS code, substr(o_orderpriority, 3) AS label FROM orders UNION SELECT DISTINCT 'segment', lower(c_mktsegment), c_mktsegment FROM customer) GROUP BY vocabulary)) AS vocabularies,
  'accounts=false,deadlines=true' AS features""")
def catalogue(spark, d):
    """Campuses, the vocabularies that the tables use, and features, as text."""
    words = lambda t, name, c: read(spark, d, t).select(F.lit(name).alias("vocabulary"), F.lower(c).alias("place"), F.lower(c).alias("code"), c.alias("label")).distinct()
    vocabularies = words("orders", "category", F.expr("substring(o_orderpriority, 3)")).union(words("customer", "segment", F.col("c_mktsegment")))
    got = R.catalogue(vocabularies, read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), {"accounts": False, "deadlines": True})
    pairs = lambda a, k, v: F.array_join(F.transform(a, lambda x: F.concat(x[k].cast("string"), F.lit("="), x[v].cast("string"))), ",")
    listed = F.array_join(F.transform(F.map_entries("vocabularies"), lambda x: F.concat(x["key"], F.lit(":"), pairs(x["value"], "code", "label"))), ";")
    return got.select(pairs("campuses", "id", "name").alias("campuses"), listed.alias("vocabularies"), pairs(F.map_entries("features"), "key", "value").alias("features"))
