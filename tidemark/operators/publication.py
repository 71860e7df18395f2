"""What is published, in which order and pages, and how one revision follows another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D

from .spread import settled


def within_window(date: Column, at: Column, pinned: Column, exempt: Column, now: Column, start: Column) -> Column:
    """Future rows publish; so do exempt pinned ones, timed ones from the window's first instant on, dated ones
    from its first day on. Rows of unknown date publish only where no window is set."""
    open_ = F.when(at.isNotNull(), at >= D.day_start(start)).otherwise(date >= start)
    return F.when(start.isNull(), True).when(D.is_future(date, at, now), True).when(pinned & exempt, True).otherwise(F.coalesce(open_, F.lit(False)))


def number(rows: DataFrame, order: list[Column], size: int, into: str = "page") -> DataFrame:
    """Adds ``position`` (from 0) in a total order and the page it falls on (from 1).

    Rows are range-partitioned by the order, numbered within partitions, and shifted by the sizes of the
    partitions before: no task sees them all.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    ranked = settled(ranked)
    sizes = ranked.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    placed = ranked.join(F.broadcast(before), "_part")  # one row per partition
    position = (F.col("_before") + F.col("_rank") - 1).cast("long")
    return placed.withColumn("position", position).withColumn(into, (F.floor(position / size) + 1).cast("long")).drop("_part", "_rank", "_before")


def content_objects(rows: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """``(key, payload, object)``: canonical JSON (fields by name, nulls kept) and its content address."""
    payload = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return rows.select(key.alias("key"), payload.alias("payload")).withColumn("object", F.concat(F.lit("v1/objects/"), F.sha2("payload", 256), F.lit(".json")))


def new_objects(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """The objects that are not stored yet, each once."""
    return objects.select("object", "payload").dropDuplicates(["object"]).join(stored.select("object"), "object", "left_anti")


def compare_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(key, object)`` twice to ``key, state``: only_left, only_right, differs or same."""
    l, r = left.select("key", F.col("object").alias("l")), right.select("key", F.col("object").alias("r"))
    state = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("l") != F.col("r"), "differs").otherwise("same")
    return l.join(r, "key", "full_outer").select("key", state.alias("state"))


def plan_export(live: DataFrame, state: DataFrame, excluded: DataFrame) -> DataFrame:
    """``live(id, stamp, revision, adjusting)`` against ``state(id, stamp, revision, entry)`` and ``excluded(id,
    stamp, revision)`` to ``id, action``: reused, changed, added, excluded_kept or dropped."""
    s = state.select("id", F.col("stamp").alias("s_stamp"), F.col("revision").alias("s_rev"), "entry", F.lit(True).alias("known"))
    x = excluded.select("id", F.col("stamp").alias("x_stamp"), F.col("revision").alias("x_rev"), F.lit(True).alias("out"))
    j = live.withColumn("live", F.lit(True)).join(s, "id", "full_outer").join(x, "id", "full_outer")
    same = F.col("stamp").eqNullSafe(F.col("s_stamp")) & F.col("revision").eqNullSafe(F.col("s_rev")) & F.col("entry").isNotNull() & ~F.col("adjusting")
    kept = F.col("out").isNotNull() & F.col("stamp").eqNullSafe(F.col("x_stamp")) & F.col("revision").eqNullSafe(F.col("x_rev"))
    action = F.when(F.col("live").isNull(), "dropped").when(F.col("known") & same, "reused").when(F.col("known"), "changed").when(kept, "excluded_kept").otherwise("added")
    return j.select("id", action.alias("action"))


def latest(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")
