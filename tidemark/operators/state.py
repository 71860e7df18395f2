"""Histories and the states that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revisions(log: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """The rows at which content changes, numbered: A, B, A are three revisions, A, A is one."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = log.withColumn("_hash", F.sha2(F.coalesce(content, F.lit("")), 256)).withColumn("_last", F.lag("_hash").over(w))
    new = changed.where(F.col("_last").isNull() | (F.col("_last") != F.col("_hash")))
    return new.withColumn("revision", F.row_number().over(w)).withColumnRenamed("_hash", "content_hash").drop("_last")


def streaks(log: DataFrame, key: str, order: list[str], broken: Column, name: str = "streak") -> DataFrame:
    """Adds how many rows on end, up to this one, do not break the streak."""
    w = Window.partitionBy(key).orderBy(*order)
    island = log.withColumn("_i", F.sum(F.when(broken, 1).otherwise(0)).over(w))
    n = F.sum(F.when(broken, 0).otherwise(1)).over(Window.partitionBy(key, "_i").orderBy(*order))
    return island.withColumn(name, n.cast("long")).drop("_i")


def newest_streak(log: DataFrame, key: str, newest: list[Column], broken: Column) -> DataFrame:
    """Per key, how many of the newest rows come before the first that breaks the streak."""
    w = Window.partitionBy(key).orderBy(*newest)
    seen = F.sum(F.when(broken, 1).otherwise(0)).over(w)
    return log.withColumn("_b", seen).groupBy(key).agg(F.count_if(F.col("_b") == 0).alias("streak"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys. A rewrite: files know no update."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def row_changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with ``change``: insert, delete or update. Equal rows are left out."""
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(~F.col("_o").eqNullSafe(F.col("_n")), "update")
    return o.join(n, keys, "full_outer").withColumn("change", kind).where("change IS NOT NULL").select(*keys, "change")


def detail_due(r: dict[str, Column], now: Column, recheck_days: int = 7) -> Column:
    """Whether an item's detail page is to be fetched: the first rule that applies.

    ``r`` names the columns known, backoff_until, has_revision, error, title_changed, date_changed,
    checked_at, deferred, pinned, active_deadline, published.
    """
    day = F.expr("INTERVAL 1 DAY")
    watched = r["pinned"] | r["active_deadline"] | (r["published"] >= F.date_sub(F.to_date(now), 14))
    elapsed = now - r["checked_at"]
    return (
        F.when(~r["known"], True)
        .when(r["backoff_until"] > now, False)
        .when(~r["has_revision"] | r["error"].isNotNull(), True)
        .when(r["title_changed"] | r["date_changed"], True)
        .when(r["checked_at"].isNull(), True)
        .when(r["deferred"] & ~r["pinned"] & ~r["active_deadline"], False)
        .otherwise(F.when(F.coalesce(watched, F.lit(False)), elapsed >= day).otherwise(elapsed >= F.expr(f"INTERVAL {recheck_days} DAY")))
    )


def run_outcome(n: Column, failed: Column, partial: Column) -> Column:
    return F.when((n > 0) & (failed == n), "failed").when(failed + partial > 0, "partial").otherwise("success")
