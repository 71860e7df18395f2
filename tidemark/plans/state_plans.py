"""Revision histories, streaks, upserts and change sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import state as S

from .binding import RUNS_SQL, query, read, runs


@query("revisions", """WITH c AS (SELECT conv_id AS item, turn, sha256(role) AS h, lag(sha256(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), n AS (SELECT * FROM c WHERE p IS NULL OR p <> h)
SELECT item, turn, h AS content_hash, row_number() OVER (PARTITION BY item ORDER BY turn) AS revision FROM n""")
def revisions(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("item"), "turn", "role")
    return S.revisions(c, "item", ["turn"], F.col("role")).select("item", "turn", "content_hash", F.col("revision").cast("long").alias("revision"))


@query("current_revisions", "SELECT conv_id AS item, max(turn) AS turn, max_by(role, turn) AS role, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def current_revisions(spark, d):
    return read(spark, d, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.min("turn").alias("first_turn"))


@query("missing_streaks", f"""WITH {RUNS_SQL}, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, id) AS i FROM runs)
SELECT id, source, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source, i ORDER BY ts, id) AS streak FROM i""")
def missing_streaks(spark, d):
    return S.streaks(runs(spark, d), "source", ["ts", "id"], ~F.col("failed")).select("id", "source", "streak")


@query("removed_items", f"""WITH {RUNS_SQL}, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, id) AS i FROM runs), s AS (SELECT source, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source, i ORDER BY ts, id) AS streak FROM i)
SELECT source, max(streak) AS longest, max(streak) >= 3 AS removed FROM s GROUP BY source""")
def removed_items(spark, d):
    s = S.streaks(runs(spark, d), "source", ["ts", "id"], ~F.col("failed"))
    return s.groupBy("source").agg(F.max("streak").alias("longest"), (F.max("streak") >= 3).alias("removed"))


@query("newest_failures", f"""WITH {RUNS_SQL}, s AS (SELECT source, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS b FROM runs), c AS (SELECT source, count(*) FILTER (b = 0) AS streak FROM s GROUP BY source)
SELECT source, streak, CASE WHEN streak > 0 THEN ([1, 2, 4, 8, 24])[least(streak, 5)] ELSE 0 END AS backoff_hours, CASE WHEN streak >= 3 THEN 'delayed' ELSE 'active' END AS status FROM c""")
def newest_failures(spark, d):
    """Failures on end from the newest run back, and what follows from them."""
    s = S.newest_streak(runs(spark, d), "source", [F.col("ts").desc(), F.col("id").desc()], ~F.col("failed"))
    return s.select("source", "streak", R.backoff_hours(F.col("streak")).alias("backoff_hours"), R.failure_status(F.lit("http_error"), F.col("streak")).alias("status"))


@query("run_outcomes", f"WITH {RUNS_SQL}, g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (failed) AS f, count(*) FILTER (partial) AS p FROM runs GROUP BY 1) SELECT day, n, CASE WHEN f = n THEN 'failed' WHEN f + p > 0 THEN 'partial' ELSE 'success' END AS outcome FROM g", days=("day",))
def run_outcomes(spark, d):
    g = runs(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if("failed").alias("f"), F.count_if("partial").alias("p"))
    return g.select("day", "n", S.run_outcome(F.col("n"), F.col("f"), F.col("p")).alias("outcome"))


@query("upsert", "SELECT o_orderkey AS id, 'N' AS status FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0")
def upsert(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return S.upsert(o, o.where("id % 10 = 0").withColumn("status", F.lit("N")), ["id"])


@query("row_changes", """WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS v FROM lineitem WHERE l_linenumber <= 4), n AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 5 = 0 THEN 'Z' ELSE l_returnflag END AS v FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5),
j AS (SELECT coalesce(o.k, n.k) AS k, coalesce(o.n, n.n) AS n, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' WHEN o.v IS DISTINCT FROM n.v THEN 'update' END AS change FROM (SELECT k, n, min(v) AS v FROM o GROUP BY ALL) o FULL JOIN (SELECT k, n, min(v) AS v FROM n GROUP BY ALL) n ON o.k = n.k AND o.n = n.n)
SELECT change, count(*) AS rows FROM j WHERE change IS NOT NULL GROUP BY change""")
def row_changes(spark, d):
    l = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("v"))
    new = l.where("n BETWEEN 2 AND 5").withColumn("v", F.when(F.col("k") % 5 == 0, "Z").otherwise(F.col("v")))
    return S.row_changes(l.where("n <= 4"), new, ["k", "n"], ["v"]).groupBy("change").agg(F.count("*").alias("rows"))


@query("touched_parents", "SELECT l_orderkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' UNION SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01'")
def touched_parents(spark, d):
    """Parents that a change of any child touches, each once."""
    l = read(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("id"))
    o = read(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz")).select("o_orderkey")
    return l.union(o).distinct()


@query("versions", "SELECT conv_id AS id, turn AS valid_from, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS valid_to, role FROM conversations")
def versions(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("valid_from"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("valid_to"), "role")


@query("order_inversions", "SELECT user_id AS source, count(*) FILTER (value > p) AS inversions, count(*) FILTER (p IS NULL) AS unknown FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def order_inversions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("p", F.lag("value").over(w))
    return e.groupBy(F.col("user_id").alias("source")).agg(F.count_if(F.col("value") > F.col("p")).alias("inversions"), F.count_if(F.col("p").isNull()).alias("unknown"))


@query("whole_page_pins", "SELECT event_id AS id, CASE WHEN count(*) OVER p >= 2 AND bool_and(event_id % 3 <> 0) OVER p THEN false ELSE event_id % 3 <> 0 END AS pinned FROM events WINDOW p AS (PARTITION BY event_id // 4)")
def whole_page_pins(spark, d):
    """A page of which every row is pinned has none pinned."""
    w = Window.partitionBy(F.floor(F.col("event_id") / 4))
    pin = F.col("event_id") % 3 != 0
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.when((F.count("*").over(w) >= 2) & F.bool_and(pin).over(w), False).otherwise(pin).alias("pinned"))


@query("details_due", """WITH r AS (SELECT event_id AS id, ts AS checked_at, event_id % 17 <> 0 AS known, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-02' END AS b, event_id % 13 <> 0 AS rev, CASE WHEN event_type = 'error' THEN 'e' END AS err, event_id % 19 = 0 AS t, event_id % 3 = 0 AS pinned FROM events)
SELECT id, CASE WHEN NOT known THEN true WHEN b > TIMESTAMP '2024-02-01' THEN false WHEN NOT rev OR err IS NOT NULL THEN true WHEN t THEN true WHEN pinned THEN TIMESTAMP '2024-02-01' - checked_at >= INTERVAL 1 DAY ELSE TIMESTAMP '2024-02-01' - checked_at >= INTERVAL 7 DAY END AS due FROM r""")
def details_due(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    no = F.lit(False)
    r = {"known": i % 17 != 0, "backoff_until": F.when(i % 5 == 0, F.lit("2024-02-02").cast("timestamp")), "has_revision": i % 13 != 0, "error": F.when(F.col("event_type") == "error", "e"), "title_changed": i % 19 == 0, "date_changed": no, "checked_at": F.col("ts").cast("timestamp"), "deferred": no, "pinned": i % 3 == 0, "active_deadline": no, "published": F.lit(None).cast("date")}
    return e.select(i.alias("id"), S.detail_due(r, F.lit("2024-02-01").cast("timestamp")).alias("due"))


@query("backfill_diff", "SELECT o_orderkey AS id, lower(substr(o_orderpriority, 3)) AS before, CASE WHEN o_totalprice > 150000 THEN 'urgent' ELSE lower(substr(o_orderpriority, 3)) END AS after FROM orders WHERE o_totalprice > 150000 AND lower(substr(o_orderpriority, 3)) <> 'urgent'")
def backfill_diff(spark, d):
    """What a changed rule changes: the audit rows of a backfill, from which it can be taken back."""
    before = F.lower(F.expr("substring(o_orderpriority, 3)"))
    after = F.when(F.col("o_totalprice") > 150000, "urgent").otherwise(before)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), before.alias("before"), after.alias("after")).where("before <> after")
