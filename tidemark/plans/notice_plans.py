"""Scans, filters, joins and aggregates over notices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators import publication as P
from tidemark.operators import search as S

from .binding import NOTICES_SQL, NOW, START, notices, query, read



def now():
    return F.lit(NOW).cast("timestamp")


def start():
    return F.lit(START).cast("date")


PUBLIC = "status = 'visible' AND c_acctbal >= 0"


def public(spark, d):
    return notices(spark, d).join(read(spark, d, "customer"), F.col("org") == F.col("c_custkey")).where(PUBLIC)


@query("scan_light", f"WITH {NOTICES_SQL} SELECT id, first_seen, weight AS revision FROM notices JOIN customer ON org = c_custkey WHERE {PUBLIC}")
def scan_light(spark, d):
    """Ids, stamps and revisions of public notices; no wide column is read."""
    return public(spark, d).select("id", "first_seen", F.col("weight").alias("revision"))


@query("join_current", f"WITH {NOTICES_SQL} SELECT id, c_name AS org, n_name AS parent, r_name AS root, l_shipdate AS stamp FROM notices JOIN customer ON org = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = id AND l_linenumber = 1 WHERE {PUBLIC}")
def join_current(spark, d):
    first = read(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.col("l_shipdate").alias("stamp"))
    n = public(spark, d).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(first, F.col("id") == F.col("l_orderkey")).select("id", F.col("c_name").alias("org"), F.col("n_name").alias("parent"), F.col("r_name").alias("root"), "stamp")


@query("late_bodies", f"""WITH {NOTICES_SQL}, top AS (SELECT id FROM notices ORDER BY date DESC NULLS LAST, "at" DESC NULLS LAST, first_seen DESC, id DESC LIMIT 50)
SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS price, l_shipdate AS shipped FROM lineitem WHERE l_orderkey IN (SELECT id FROM top)""")
def late_bodies(spark, d):
    """The newest fifty are picked on narrow columns; wide columns are read for them alone (at most fifty keys are sent out)."""
    top = notices(spark, d).orderBy(*S.newest_first()).limit(50).select("id")
    return read(spark, d, "lineitem").join(F.broadcast(top), F.col("l_orderkey") == F.col("id"), "left_semi").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipped"))


@query("keyset_page", f"WITH {NOTICES_SQL} SELECT id, category FROM notices WHERE id > 1000 ORDER BY id LIMIT 100")
def keyset_page(spark, d):
    return notices(spark, d).where("id > 1000").select("id", "category").orderBy("id").limit(100)


@query("publication_window", f"""WITH {NOTICES_SQL} SELECT id, CASE WHEN coalesce("at" > TIMESTAMP '{NOW}', date > CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), false) THEN true
  WHEN pinned AND curated THEN true WHEN "at" IS NOT NULL THEN "at" >= TIMESTAMP '{START}' - INTERVAL 9 HOUR ELSE coalesce(date >= DATE '{START}', false) END AS published FROM notices""")
def publication_window(spark, d):
    n = notices(spark, d)
    return n.select("id", P.within_window(n.date, n.at, n.pinned, n.curated, now(), start()).alias("published"))


@query("public_total", f"""WITH {NOTICES_SQL}, p AS (SELECT category, CASE WHEN coalesce("at" > TIMESTAMP '{NOW}', date > CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), false) THEN true
  WHEN pinned AND curated THEN true WHEN "at" IS NOT NULL THEN "at" >= TIMESTAMP '{START}' - INTERVAL 9 HOUR ELSE coalesce(date >= DATE '{START}', false) END AS published FROM notices JOIN customer ON org = c_custkey WHERE {PUBLIC})
SELECT category, count(*) AS n, count(*) FILTER (published) AS n_published FROM p GROUP BY category""")
def public_total(spark, d):
    n = public(spark, d)
    n = n.withColumn("published", P.within_window(n.date, n.at, n.pinned, n.curated, now(), start()))
    return n.groupBy("category").agg(F.count("*").alias("n"), F.count_if("published").alias("n_published"))


@query("display_dates", f"""WITH {NOTICES_SQL}, f AS (SELECT *, coalesce("at" > TIMESTAMP '{NOW}', date > CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE), false) AS future, coalesce(pinned AND curated AND date < DATE '{START}', false) AS old FROM notices)
SELECT id, CASE WHEN future THEN CAST(first_seen + INTERVAL 9 HOUR AS DATE) WHEN old THEN DATE '{START}' ELSE date END AS shown,
  CASE WHEN future THEN 'datetime' WHEN old THEN 'date' WHEN "at" IS NOT NULL THEN 'datetime' WHEN date IS NOT NULL THEN 'date' ELSE 'unknown' END AS precision, future OR old AS adjusted FROM f""", days=("shown",))
def display_dates(spark, d):
    n = notices(spark, d)
    precision = F.when(n.at.isNotNull(), "datetime").when(n.date.isNotNull(), "date")
    s = D.display_published(n.date, n.at, precision, n.pinned, n.curated, n.first_seen, now(), start())
    return n.select("id", s["date"].alias("shown"), s["precision"].alias("precision"), s["adjusted"].alias("adjusted"))


@query("membership_filter", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE category IN ('urgent', 'high') AND status IN ('visible', 'removed') AND org % 4 = 1")
def membership_filter(spark, d):
    return notices(spark, d).where(F.col("category").isin("urgent", "high") & F.col("status").isin("visible", "removed") & (F.col("org") % 4 == 1)).select("id")


@query("newest_first_page", f"""WITH {NOTICES_SQL} SELECT id, date, "at" FROM notices WHERE status = 'visible' ORDER BY date DESC NULLS LAST, "at" DESC NULLS LAST, first_seen DESC NULLS LAST, id DESC LIMIT 51 OFFSET 100""", days=("date",))
def newest_first_page(spark, d):
    return S.page(notices(spark, d).where("status = 'visible'"), S.newest_first(), 100, 50).select("id", "date", "at")


@query("first_match", f"""WITH {NOTICES_SQL} SELECT id FROM notices WHERE category LIKE '%urgent%' AND date BETWEEN DATE '1999-05-02' AND DATE '1999-06-01' ORDER BY date DESC, "at" DESC NULLS LAST, first_seen DESC, id DESC LIMIT 1""")
def first_match(spark, d):
    """The newest notice of the last thirty days whose label contains a term."""
    near = F.col("date").between(F.date_sub(D.local_date(now()), 30), D.local_date(now()))
    return notices(spark, d).where(F.col("category").contains("urgent") & near).orderBy(*S.newest_first()).limit(1).select("id")


@query("nested_children", """SELECT l_orderkey AS id, count(*) AS n, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS children FROM lineitem GROUP BY l_orderkey""")
def nested_children(spark, d):
    """Children of each notice as one list, in a fixed order."""
    kids = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    text = F.array_join(F.transform(kids, lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ",")
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), text.alias("children"))


@query("counts_by_status", f"WITH {NOTICES_SQL} SELECT status, count(*) AS n, count(DISTINCT org) AS orgs, max(date) AS newest FROM notices GROUP BY status", days=("newest",))
def counts_by_status(spark, d):
    return notices(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("org").alias("orgs"), F.max("date").alias("newest"))


@query("source_projection", """SELECT c_custkey AS id, c_name AS name, n_name AS owner, coalesce(n, 0) AS notices, CASE WHEN newest IS NULL THEN 'unknown' WHEN newest >= TIMESTAMP '2001-07-01' THEN 'fresh' ELSE 'stale' END AS state
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey""")
def source_projection(spark, d):
    """Sources with their owner and how many live notices they have; those without are kept."""
    n = read(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
    s = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    state = F.when(F.col("newest").isNull(), "unknown").when(F.col("newest") >= F.lit("2001-07-01").cast("timestamp_ntz"), "fresh").otherwise("stale")
    return s.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("owner"), F.coalesce("n", F.lit(0)).alias("notices"), state.alias("state"))


@query("silent_sources", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def silent_sources(spark, d):
    return read(spark, d, "customer").where("c_acctbal > 0").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("other_live_source", "SELECT l_orderkey AS notice, l_suppkey AS source FROM lineitem a WHERE l_linestatus = 'F' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_linestatus = 'O')")
def other_live_source(spark, d):
    """Ended source links of notices that another live source still has: one pass over the links per notice, no self join."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice"), F.col("l_suppkey").alias("source"), "l_linestatus")
    live = l.where("l_linestatus = 'O'").groupBy("notice").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    return l.where("l_linestatus = 'F'").join(live, "notice").where("lo <> source OR hi <> source").select("notice", "source")


@query("audience_keys", "SELECT o_orderkey AS notice, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM (SELECT o_orderkey, unnest(['org:' || o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'university' ELSE 'campus:' || o_custkey % 2 END]) AS key FROM orders) GROUP BY 1")
def audience_keys(spark, d):
    from tidemark.functions.text import audience_key

    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k.alias("notice"), F.array(audience_key(F.lit("organization"), F.col("o_custkey").cast("string")), audience_key(F.when(k % 3 == 0, "university").otherwise("campus"), (F.col("o_custkey") % 2).cast("string"))).alias("k"))
    return rows.select("notice", F.array_join(F.array_sort(F.array_distinct("k")), ",").alias("keys"))


@query("campus_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 2 = 1 OR o_custkey % 50 = 4")
def campus_filter(spark, d):
    """University-wide notices pass, and those of the campus or of an organization that has no campus or this one."""
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").withColumn("a", F.array(F.concat(F.lit("org:"), F.col("o_custkey").cast("string")), F.when(k % 3 == 0, "university").otherwise(F.concat(F.lit("campus:"), (F.col("o_custkey") % 2).cast("string")))))
    here = F.when(F.col("o_custkey") % 50 == 4, F.array(F.col("o_custkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    return rows.where(S.campus_passes(F.col("a"), "1", here)).select(k.alias("id"))


@query("transition_histogram", "SELECT a || ' -> ' || b AS step, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1")
def transition_histogram(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("b", F.lead("event_type").over(w)).where("b IS NOT NULL")
    return e.groupBy(F.concat("event_type", F.lit(" -> "), "b").alias("step")).agg(F.count("*").alias("n"))


@query("read_meter", "SELECT lang, count(*) AS n, CAST(sum(strlen(text)) + 8 * count(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def read_meter(spark, d):
    """Rows and bytes: the UTF-8 length of texts, eight for any other value that is not null."""
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), (F.sum(F.octet_length("text")) + 8 * F.count("n_chars")).alias("bytes"))


@query("contacts_filter", "SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, n_name)), 'china') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def contacts_filter(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.where(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", "n_name")).contains("china") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("id"))


@query("priced_report", """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 0) AS net FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def priced_report(spark, d):
    l = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("net"))
