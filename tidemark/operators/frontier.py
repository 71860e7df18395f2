"""Breadth-first visits of linked pages, with a limit of depth and a budget of pages for each host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import dealt_join, settled


def visits(homes: DataFrame, pages: DataFrame, links: DataFrame, depth: int = 3, budget: int = 80) -> DataFrame:
    """``homes(host, path)``, ``pages(host, path)`` that there are, ``links(host, path, pos, target)`` in the order in which they stand on a page, to
    ``host, path, level, place, outcome``, one row for each page that was noted.

    Pages are visited host by host in the order in which they are noted: level by level, within a level by the place of the page that names them first, then by
    the link's. Outcomes are ``visited``, ``missing`` (visited, but there is no such page), ``budget`` (noted when the host's budget was
    spent) and ``depth`` (noted beyond the depth). ``place`` is the number of the visit at its host, from 0, null for pages not visited. A page
    is noted once. Links of missing pages lead nowhere.

    A round is a level: the links of the pages just visited, each new target once, and of those the first that the host's budget still has room for,
    a top-k that is taken within each task before hosts meet. There are ``depth`` + 1 rounds at most, whatever the number of pages; links of one page that
    has very many are dealt out.
    """
    there = pages.select("host", "path").distinct().withColumn("there", F.lit(True))
    home = homes.groupBy("host").agg(F.min("path").alias("path")).withColumns({"level": F.lit(0), "place": F.lit(0).cast("long")})
    level = settled(home.join(there, ["host", "path"], "left").withColumn("outcome", F.when(F.col("there").isNull(), "missing").otherwise("visited")).drop("there"))
    noted, spent, k = level, level.select("host", F.lit(1).cast("long").alias("spent")), 0
    edges = links.select(F.struct("host", "path").alias("page"), "pos", "target")
    while True:
        k += 1
        open_ = level.where("outcome = 'visited'").select(F.struct("host", "path").alias("page"), F.col("place").alias("by"))
        named = dealt_join(edges, open_, "page").groupBy(F.col("page.host").alias("host"), F.col("target").alias("path")).agg(F.min(F.struct("by", "pos")).alias("first"))
        new = settled(named.join(noted.select("host", "path"), ["host", "path"], "left_anti"))
        if new.isEmpty():
            return noted
        if k > depth:
            return noted.unionByName(new.select("host", "path", F.lit(k).alias("level"), F.lit(None).cast("long").alias("place"), F.lit("depth").alias("outcome")))
        nth = Window.partitionBy("host").orderBy("first", "path")
        ranked = new.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= budget)  # no host has room for more
        taken = ranked.join(spent, "host").where(F.col("nth") + F.col("spent") <= budget).withColumn("place", F.col("nth") + F.col("spent") - 1)
        taken = taken.join(there, ["host", "path"], "left")
        level = settled(taken.select("host", "path", F.lit(k).alias("level"), F.col("place").cast("long").alias("place"), F.when(F.col("there").isNull(), "missing").otherwise("visited").alias("outcome")))
        rest = new.join(level.select("host", "path"), ["host", "path"], "left_anti").select("host", "path", F.lit(k).alias("level"), F.lit(None).cast("long").alias("place"), F.lit("budget").alias("outcome"))
        noted = settled(noted.unionByName(level).unionByName(rest))
        spent = settled(spent.union(level.groupBy("host").agg(F.count("*").alias("spent"))).groupBy("host").agg(F.sum("spent").alias("spent")))
