"""Merges, backfills, selections, and what pages say of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merging as M
from tidemark.sources import listings as L

from .binding import ITEMS_SQL, items, nodes, query, read

PAIRS = "pairs AS (SELECT c_custkey AS absorb, c_custkey - c_custkey % 10 AS keep FROM customer WHERE c_custkey % 10 IN (0, 3))"


def pairs(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").where((k % 10).isin(0, 3)).select(k.alias("absorb"), (k - k % 10).alias("keep"))


@query("merged_links", f"""WITH {PAIRS}, l AS (SELECT *, o_orderstatus <> 'F' AS active, o_orderkey % 2 = 0 AS main FROM orders)
SELECT o_orderkey AS id, CASE WHEN active AND keep <> absorb THEN keep ELSE o_custkey END AS notice, active AS is_active, main AND NOT coalesce(active AND keep <> absorb, false) AS is_primary,
  CASE WHEN active AND keep <> absorb THEN 'same text' END AS reason FROM l LEFT JOIN pairs ON o_custkey = absorb""")
def merged_links(spark, d):
    """Links after notices were merged."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("notice"), (F.col("o_orderstatus") != "F").alias("is_active"), (F.col("o_orderkey") % 2 == 0).alias("is_primary"), F.lit(None).cast("string").alias("reason"))
    return M.merge_links(o, pairs(spark, d), "same text")


@query("merge_records", f"""WITH {PAIRS} SELECT absorb AS from_id, keep AS to_id, 'auto' AS actor, 'notice.merge' AS action, '{{"absorbed":' || absorb || '}}' AS after, 'same text' AS reason FROM pairs WHERE keep <> absorb""")
def merge_records(spark, d):
    return M.merge_records(pairs(spark, d), "same text")


def _values(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    stored = o.select(k.alias("id"), F.col("o_orderpriority").alias("value"))
    return stored, o.select(k.alias("id"), F.when(k % 3 == 0, "other").otherwise(F.col("o_orderpriority")).alias("value"))


@query("backfill_audit", "SELECT o_orderkey AS id, o_orderpriority AS before, 'other' AS after FROM orders WHERE o_orderkey % 3 = 0")
def backfill_audit(spark, d):
    return M.changes(*_values(spark, d))


@query("backfill_reverted", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'edited' ELSE o_orderpriority END AS value, o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 AS reverted FROM orders")
def backfill_reverted(spark, d):
    """A backfill taken back by its audit; what was edited since stays as it is."""
    stored, wanted = _values(spark, d)
    current = wanted.withColumn("value", F.when(F.col("id") % 6 == 0, "edited").otherwise(F.col("value")))
    return M.reverted(current, M.changes(stored, wanted))


@query("resolved_entities", """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 3 AND c_custkey % 8 < 6 THEN c_custkey + 1000000 END AS known_id,
  CASE WHEN c_custkey % 4 = 3 OR c_custkey % 8 >= 6 THEN 'new' WHEN c_custkey % 4 = 0 THEN 'registry_key' WHEN c_custkey % 4 = 1 THEN 'path' ELSE 'name' END AS strategy FROM customer""")
def resolved_entities(spark, d):
    """Customers of a new list matched with those stored, by key, then by path, then by name."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    key, path = F.concat(F.lit("k"), k.cast("string")), F.concat(F.lit("p"), k.cast("string"))
    wanted = c.select(k.alias("id"), F.when(k % 4 == 0, key).alias("registry_key"), F.when(k % 4 == 1, path).alias("path"), F.when(k % 4 == 2, F.col("c_name")).alias("name"))
    known = c.where(k % 8 < 6).select((k + 1000000).alias("id"), key.alias("registry_key"), path.alias("path"), F.col("c_name").alias("name"))
    return M.resolve(wanted, known, ["registry_key", "path", "name"])


@query("selections", """WITH p AS (SELECT o_custkey AS owner, o_orderkey AS position, CASE o_orderkey % 3 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'n' || c_nationkey ELSE 'r' || n_regionkey END AS id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), l AS (SELECT owner, id, max(position) AS position FROM p GROUP BY owner, id)
SELECT owner, id FROM l QUALIFY position = max(position) OVER (PARTITION BY owner)""")
def selections(spark, d):
    """What stays selected of picks along one line of the tree: each owner's last one."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.col("o_orderkey") % 3
    picks = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("position"), F.when(kind == 0, of("c", "o_custkey")).when(kind == 1, of("n", "c_nationkey")).otherwise(of("r", "n_regionkey")).alias("id"))
    return M.normalized_selection(picks, nodes(spark, d))


@query("daily_full", """WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 10 > 0 THEN ts END AS last, ts + to_hours(CAST(event_id % 12 AS INTEGER)) AS now FROM events)
SELECT id, CASE WHEN last IS NULL THEN 'unknown' WHEN now >= last + INTERVAL 8 HOUR THEN 'gap' WHEN CAST(now + INTERVAL 9 HOUR AS DATE) > CAST(last + INTERVAL 9 HOUR AS DATE) AND hour(now + INTERVAL 9 HOUR) >= 4 THEN 'new_day' END AS reason FROM e""")
def daily_full(spark, d):
    """Whether all is to be published anew, and why."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return read(spark, d, "events").select(k.alias("id"), M.daily_full(F.when(k % 10 > 0, ts), ts + F.make_interval(hours=(k % 12).cast("int")), 4, 6).alias("reason"))


@query("self_adjusting", """SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 >= 1) AS again FROM orders""")
def self_adjusting(spark, d):
    """Notices whose shown date changes with time, and which are made anew each time."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    original = F.when(k % 5 != 0, F.date_add(day, (k % 3 - 1).cast("int")))
    return read(spark, d, "orders").select(k.alias("id"), M.self_adjusting(k % 2 == 0, original, day).alias("again"))


@query("category_codes", """SELECT o_custkey AS id, coalesce(max(o_orderpriority) FILTER (o_orderkey % 4 = 0), 'other') AS main, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 4 <> 0)), ','), '') AS others FROM orders GROUP BY o_custkey""")
def category_codes(spark, d):
    """Each notice's main category and its others, in order."""
    main, code = F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")
    got = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.when(main, code)).alias("main"), F.collect_set(F.when(~main, code)).alias("others"))
    return got.select("id", F.coalesce("main", F.lit("other")).alias("main"), F.array_join(F.array_sort("others"), ",").alias("others"))


@query("search_texts", f"WITH {ITEMS_SQL} SELECT id, md5(substr(coalesce(title, '') || chr(10) || coalesce(body, ''), 1, 4000)) AS digest FROM items")
def search_texts(spark, d):
    """The text that is searched (the first 4,000 characters of title and body, as the rule says), by its digest."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return items(spark, d).select("id", F.md5(F.substring(text, 1, 4000)).alias("digest"))


@query("order_proofs", "SELECT event_id AS id, event_type <> 'error' AND TIMESTAMP '2024-01-31 00:00:00' < ts + INTERVAL 12 HOUR AS valid FROM events")
def order_proofs(spark, d):
    """Proofs of a listing's order, which hold for twelve hours."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), ((F.col("event_type") != "error") & (now < F.col("ts").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))).alias("valid"))


@query("next_pages", "SELECT page_id AS id, greatest(page_id % 5, page_id % 7) > page_id % 6 AS more FROM pages WHERE html IS NOT NULL")
def next_pages(spark, d):
    """Whether the pager of a list page leads on."""
    k = F.col("page_id")
    link = lambda n, start: F.concat(F.lit(f'<a href="/list{start}page='), (k % n).cast("string"), F.lit('">n</a>'))
    html = F.concat("html", F.lit('<div class="pg_wrap">'), link(5, "?"), link(7, "?sort=1&amp;"), F.lit("</div>"))
    return read(spark, d, "pages").where("html IS NOT NULL").select(k.alias("id"), L.has_next(html, k % 6).alias("more"))


@query("page_files_linked", """SELECT page_id AS id, 'Plan ' || page_id || '.pdf' AS name, 'pdf' AS kind, (page_id % 50) * 1024 + 512 AS bytes, '/f?no=' || page_id AS url FROM pages WHERE html IS NOT NULL
UNION ALL SELECT page_id, 'form.HWP', 'hwp', NULL, '/g' FROM pages WHERE html IS NOT NULL""")
def page_files_linked(spark, d):
    """Files that detail pages link to."""
    k = F.col("page_id").cast("string")
    plan = lambda url: F.concat(F.lit(f'<a href="{url}'), k, F.lit('">Plan '), k, F.lit(".pdf ("), (F.col("page_id") % 50).cast("string"), F.lit(".5KB)</a>"))
    html = F.concat("html", plan("/f?no="), plan("/again?no="), F.lit('<a href="/g" class="x">form.HWP</a><a href="javascript:go()">run.exe (1MB)</a>'))
    return read(spark, d, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("id"), F.inline(L.attachments(html)))


@query("pinned_rows", "SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS pinned FROM orders")
def pinned_rows(spark, d):
    """Rows of a listing that are pinned, by their mark or their number cell."""
    k = F.col("o_orderkey")
    number = F.when(k % 4 == 1, "notice").when(k % 4 == 2, "[top]").otherwise(F.format_number(k, 0))
    return read(spark, d, "orders").select(k.alias("id"), L.is_pinned(number, F.when(k % 4 == 3, "row is-notice").otherwise("row")).alias("pinned"))


@query("host_candidates", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 's.example.org,s' || s_suppkey || '.example.org' ELSE 's' || s_suppkey || '.example.org,s' || s_suppkey || '_kor.example.org' END AS hosts FROM supplier""")
def host_candidates(spark, d):
    k = F.col("s_suppkey")
    site = F.concat(F.lit(" s"), k.cast("string"), F.when(k % 2 == 1, "_kor").otherwise(" "))
    return read(spark, d, "supplier").select(k.alias("id"), F.array_join(L.host_candidates(site, "example.org"), ",").alias("hosts"))
