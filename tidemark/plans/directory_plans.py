"""A directory of regions, nations and customers as lines, read back as contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import directory as D
from tidemark.operators.spread import running

from .binding import query, read

CAMPUSES = {"first": "seoul", "second": "global"}


def directory_lines(spark, d: str):
    """Each region a section with a desk of its own; each nation an organization with an office, its fax and a group of desks, one per customer."""
    text, digits = (lambda *c: F.array(*(F.lit(x) if isinstance(x, str) else x for x in c))), lambda k: F.lpad((k % 10000).cast("string"), 4, "0")
    r = read(spark, d, "region").select("r_regionkey", "r_name", F.when(F.col("r_regionkey") < 3, "first").otherwise("second").alias("doc"))
    n = read(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    place = lambda region, nation, customer: [F.col("doc"), *(x.cast("long").alias(name) for x, name in ((region, "a"), (nation, "b"), (customer, "c")))]
    none = F.lit(-1)
    parts = [
        r.select(*place(F.col("r_regionkey"), none, none), text(F.col("r_name"), F.col("r_name"), "", "main desk", "0114").alias("l")),
        n.select(*place(F.col("r_regionkey"), F.col("n_nationkey"), none), text(F.col("n_name"), F.col("n_name"), "office", "0100~2", "FAX", "0199", "desks").alias("l")),
        c.select(*place(F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")), text(F.concat(F.lit("- "), "c_name"), digits(F.col("c_custkey"))).alias("l")),
    ]
    lines = parts[0].union(parts[1]).union(parts[2]).select("doc", "a", "b", "c", F.posexplode("l").alias("at", "line"))
    lines = running(lines.withColumn("key", F.struct("doc", "a", "b", "c", "at")).withColumn("one", F.lit(1).cast("long")), "key", sums=("one",))
    return lines.select("doc", F.col("one_before").alias("n"), "line")


@query("directory_contacts", """WITH r AS (SELECT r_regionkey AS k, r_name AS section, CASE WHEN r_regionkey < 3 THEN 'first' ELSE 'second' END AS doc, CASE WHEN r_regionkey < 3 THEN '02-961-' ELSE '031-201-' END AS area FROM region)
SELECT doc, section, 'main desk' AS organization, NULL AS grp, 'main desk' AS label, '대표 문의' AS service, 'phone:' || area || '0114' AS channels FROM r
UNION ALL SELECT doc, section, n_name, NULL, 'office', 'office', 'phone:' || area || '0100,phone:' || area || '0101,phone:' || area || '0102,fax:' || area || '0199' FROM r JOIN nation ON n_regionkey = k
UNION ALL SELECT doc, section, n_name, 'desks', c_name, 'desks · ' || c_name, 'phone:' || area || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') FROM r JOIN nation ON n_regionkey = k JOIN customer ON c_nationkey = n_nationkey""")
def directory_contacts(spark, d):
    """Contacts with their channels, from lines alone."""
    sections = [x.r_name for x in read(spark, d, "region").select("r_name").collect()]
    got = D.contacts(D.parsed(directory_lines(spark, d), sections), CAMPUSES)
    listed = F.array_join(F.transform("channels", lambda x: F.concat(x["kind"], F.lit(":"), x["number"])), ",")
    return got.select("doc", "section", "organization", "grp", "label", "service", listed.alias("channels"))
