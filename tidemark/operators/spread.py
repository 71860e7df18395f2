"""Sums along an order, joins and connections that no single task has to see whole."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of one key that are joined in one place, if the keys with more of them are no more than MOST_HUBS
HUB, MOST_HUBS = 1024, 65_536


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder (``spark.checkpoint.dir``; one of its own only where that is unset, as in tests) and read
    from there, so that a lost executor costs its own tasks and what was dealt out stays as it was."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-shared-"))
    return df.checkpoint()


#: rows that one task sorts
SORTED = 1 << 20


def parts(rows: DataFrame) -> int:
    """Into how many parts rows are dealt for a sort, so that a part, and a task's memory with it, does not grow with the input."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORTED))


def running(rows: DataFrame, key: str, sums: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``<name>_before`` for each of ``sums``, the sum over the rows of smaller ``key``, and ``<name>_last`` for each of ``last``, its
    last value that is not null up to the row. Rows of one key are in any order.

    Rows are dealt out by ranges of the key and written; a range is summed by itself, and the ranges' totals, one row each, are added up.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    each = Window.partitionBy("_part").orderBy(key)
    earlier, upto = each.rowsBetween(Window.unboundedPreceding, -1), each.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = dealt.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums} | {f"{c}_last": F.last(c, ignorenulls=True).over(upto) for c in last})
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_l_{c}") for c in last))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums), *(F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_l_{c}") for c in last))
    got = got.join(F.broadcast(totals), "_part")
    got = got.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_s_{c}") for c in sums} | {f"{c}_last": F.coalesce(f"{c}_last", f"_l_{c}") for c in last})
    return got.drop("_part", *(f"_s_{c}" for c in sums), *(f"_l_{c}" for c in last))


#: narrow values that are sent to all tasks
FEW = 1 << 19


def dealt_join(rows: DataFrame, values: DataFrame, key: str, how: str = "inner", narrow: bool = False) -> DataFrame:
    """``rows`` joined with ``values``, which has one row per ``key``. Rows of keys that have very many are dealt out by the task they come from, and
    the key's value is sent to each share. Such keys are no more than MOST_HUBS; null keys match nothing. ``narrow`` values, like ids with names, are sent
    to all tasks where they are no more than FEW: the rows then stay where they are."""
    if narrow and values.count() <= FEW:
        return rows.join(F.broadcast(values), key, how)
    count = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = count.agg(F.sum("_n")).first()[0] or 0
    hubs = settled(count.where(F.col("_n") > max(HUB, -(-total // MOST_HUBS))).select(key, F.ceil(F.col("_n") / HUB).cast("int").alias("_salts")))
    if hubs.isEmpty():
        return rows.join(values, key, how)
    hubs = F.broadcast(hubs)  # at most MOST_HUBS rows
    dealt = rows.join(hubs, key, "left").withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    sent = values.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1))).drop("_salts")
    return dealt.join(sent, [key, "_salt"], how).drop("_salt")


def connected(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: the smallest node that edges lead to, whichever way.

    Stars are contracted (Kiveris and others 2014): every larger neighbour of a node is pointed at the smallest of its neighbourhood, then every
    smaller one; the number of rounds is about the logarithm of the longest chain. Edges of a hub are dealt out.
    """
    e = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = dealt_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, down, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        new = settled(small.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct())
        if new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v"), F.col("v")).distinct())
        e = new
