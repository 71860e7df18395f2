"""Customers put into a stored book of contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contact_book as B

from .binding import query, read

CHANNEL, EVIDENCE = "array<struct<kind:string,display:string,value:string,extension:string>>", "array<struct<source:string,url:string,field:string,observed_at:timestamp>>"


def rows(spark, d: str):
    """A row per customer, under a nation's name, its alias, or a club's; a second row of some."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    text = k.cast("string")
    none = F.lit(None).cast("string")
    channel = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.coalesce(value, F.lit("-")).alias("display"), value.alias("value"), none.alias("extension"))
    name = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.lower("n_name")).otherwise(F.concat(F.lit("club "), (k % 7).cast("string")))
    service = F.when((k % 5 == 0) | (k % 2 == 0), F.col("c_name"))
    channels = F.array(channel("phone", F.concat(F.lit("02-"), text)), channel("pager", text), channel("email", F.when(k % 6 != 0, F.concat(text, F.lit("@x")))), channel("fax", text)).cast(CHANNEL)
    proof = lambda i: F.struct(F.lit("page").alias("source"), F.concat(F.lit("https://x/"), i.cast("string")).alias("url"), F.lit("phone").alias("field"), F.lit(None).cast("timestamp").alias("observed_at"))
    evidence = F.transform(F.sequence(F.lit(1), F.when(k % 50 == 0, 25).otherwise(2)), proof).cast(EVIDENCE)
    shared = {"given": F.when(k % 5 != 0, F.concat(F.lit(" k"), text, F.lit(" "))), "organization": name, "type": F.lit("club"), "service": service, "hours": none, "url": none, "status": none, "verified_at": F.lit(None).cast("timestamp"), "note": text}
    same = [v.alias(n) for n, v in shared.items()]
    one = c.select(k.alias("at"), *same, none.alias("location"), channels.alias("channels"), F.array(F.lit("Seoul"), F.lit("Nowhere"), F.lit("Seoul")).alias("campuses"), evidence.alias("evidence"))
    web = F.array(channel("website", F.concat(F.lit("https://k/"), text))).cast(CHANNEL)
    two = c.where(k % 10 == 1).select((k + 10**12).alias("at"), *same, F.lit("second").alias("location"), web.alias("channels"), F.array(F.lit("Global"), F.lit("Seoul")).alias("campuses"), F.transform(F.sequence(F.lit(2), F.lit(3)), proof).cast(EVIDENCE).alias("evidence"))
    return one.unionByName(two)


def stored(spark, d: str) -> dict:
    n, k = read(spark, d, "nation"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    entry = lambda key: [key.alias("id"), F.lit("n0").alias("organization"), F.lit("old").alias("service"), F.lit("old").alias("location"), none.alias("hours"), none.alias("url"), F.lit("verified").alias("status"), F.lit(None).cast("timestamp").alias("verified_at"), none.alias("note"), F.lit("").alias("search")]
    entries = read(spark, d, "customer").where((k % 4 == 0) & (k % 5 != 0)).select(*entry(F.concat(F.lit("k"), k.cast("string")))).union(read(spark, d, "supplier").select(*entry(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))))
    return {
        "organizations": n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("college").alias("type"), F.array(F.lower("n_name")).alias("aliases")),
        "campuses": spark.createDataFrame([("s", "Seoul"), ("g", "Global")], "id string, name string"),
        "entries": entries,
        "channels": entries.select(F.col("id").alias("contact"), F.lit(0).alias("priority"), F.lit("phone").alias("kind"), F.lit("old").alias("display"), F.lit("old").alias("value"), none.alias("extension")),
        "places": entries.select(F.col("id").alias("contact"), F.lit("g").alias("campus")),
        "evidence": entries.select(F.concat(F.lit("o"), "id").alias("id"), F.col("id").alias("contact"), F.lit("old").alias("source"), F.lit("old").alias("url"), F.lit("old").alias("field"), F.lit(None).cast("timestamp").alias("observed_at")),
    }


BOOK_SQL = """SELECT coalesce(CAST(c_custkey AS VARCHAR), '-') AS note, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN (SELECT n_name FROM nation WHERE n_nationkey = 0) WHEN c_custkey % 3 < 2 THEN n_name ELSE 'club ' || c_custkey % 7 END AS organization,
  CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 'old' WHEN c_custkey % 5 = 0 OR c_custkey % 2 = 0 THEN c_name ELSE '대표 안내' END AS service, CASE WHEN c_custkey % 10 = 1 THEN 'second' END AS location,
  CASE WHEN c_custkey % 10 = 1 THEN '0 website https://k/' || c_custkey || ' https://k/' || c_custkey ELSE '0 phone 02-' || c_custkey || ' tel:02-' || c_custkey || ',2 email ' || CASE WHEN c_custkey % 6 = 0 THEN '- -' ELSE c_custkey || '@x mailto:' || c_custkey || '@x' END || ',3 fax ' || c_custkey || ' -' END AS channels,
  CASE WHEN c_custkey % 10 = 1 THEN 'g,s' ELSE 's' END AS campuses, CASE WHEN c_custkey % 50 = 0 THEN 20 WHEN c_custkey % 10 = 1 THEN 3 WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 3 ELSE 2 END AS evidence FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT '-', (SELECT n_name FROM nation WHERE n_nationkey = 0), 'old', 'old', '0 phone old tel:old', 'g', 1 FROM supplier"""


@query("contact_import", BOOK_SQL)
def contact_import(spark, d):
    """The book after the import, one row per contact."""
    got = B.reached(B.imported(rows(spark, d), **stored(spark, d), root="university"))
    channels = F.array_join(F.transform("channels", lambda x: F.concat_ws(" ", x["priority"].cast("string"), x["kind"], x["display"], F.coalesce(x["url"], F.lit("-")))), ",")
    return got.select(F.coalesce("note", F.lit("-")).alias("note"), "organization", "service", "location", channels.alias("channels"), F.array_join("campuses", ",").alias("campuses"), "evidence")


@query("contact_import_counts", """SELECT sum(CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 0 ELSE 1 END) AS created, sum(CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 1 ELSE 0 END) + sum(CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END) AS updated FROM customer""")
def contact_import_counts(spark, d):
    return B.imported(rows(spark, d), **stored(spark, d), root="university")["counts"]


@query("contacts_matched", f"""SELECT note, organization, service FROM ({BOOK_SQL}) WHERE contains(campuses, 'g') AND organization NOT LIKE 'club%' AND contains(lower(concat_ws(' ', organization, service, location, channels)), 'second')""")
def contacts_matched(spark, d):
    """Contacts of one campus, of the nations' organizations, by a word."""
    nations = [r.n_name for r in read(spark, d, "nation").select("n_name").collect()]  # 25 names
    served = B.reached(B.imported(rows(spark, d), **stored(spark, d), root="university"))
    return B.matching(served, F.lit("SECOND"), ["g"], nations).select(F.coalesce("note", F.lit("-")).alias("note"), "organization", "service")
