"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing (tests on one machine) a local folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later work starts from the
    files, so a lost executor costs one task and not the whole lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: copies of a row that are made from one array
COPIES = 65_536


def copies(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says (null or less than one: not at all), streamed in portions, so
    that no array grows with the number of copies."""
    portion, left = fresh(df, "copy_portion"), fresh(df, "copy_left")
    first = F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))))
    got = df.select("*", first.alias(portion))
    size = F.least(F.lit(COPIES), F.col(times) - F.col(portion) * COPIES).cast("int")
    return got.select("*", F.explode(F.array_repeat(F.lit(0), size)).alias(left)).select(df.columns)


#: rows of one key that are joined in one place, if the keys with more of them are no more than MOST_HUBS
HUB, MOST_HUBS = 256, 65_536


def spread_join(rows: DataFrame, key: str, by: str, values: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) on ``key`` with ``values``, one row per key with ``n``, how many rows the key has (no key null).
    ``values`` is read three times, so it should come from files (:func:`cut`).

    A key with many rows is sent once per salt, and its rows go by a salt of their column ``by`` and of the task they come from, so that
    equal rows part too. More than
    HUB rows are many, or more than what MOST_HUBS keys at most can have, whichever is more; so no more than MOST_HUBS keys are
    sent to all tasks to mark the rows of such keys.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    salts = F.least(F.lit(1 << 20), F.ceil(F.col("n") / max(HUB, -(-total // MOST_HUBS)))).cast("int")
    salt, many = fresh(rows, "salt"), fresh(rows, "salts")
    wide = values.withColumn(many, salts).drop("n")
    hubs = F.broadcast(wide.where(F.col(many) > 1).select(key, many))  # at most MOST_HUBS rows
    dealt = rows.join(hubs, key, "left").withColumn(salt, F.pmod(F.xxhash64(by, F.spark_partition_id()), F.coalesce(many, F.lit(1))).cast("int")).drop(many)
    sent = wide.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(many) - 1))).drop(many)
    return dealt.join(sent, [key, salt], how).drop(salt)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph: ``edges(a, b)`` longs to ``(node, root)``,
    the root being the smallest node that can be reached.

    Large-star/small-star rounds (Kiveris et al. 2014), each step of which is written to the shared folder once and read where it is used; the driver sees
    one count. A node's neighbours are folded into their minimum before the shuffle (``min`` combines on the map
    side), and to bring the minimum back a node's edges are dealt out by a salt of the neighbour, with as many
    salts as its degree asks for: a hub's edges are never one task's. No edges: no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # large star: every larger neighbour of u points at the smallest of u's neighbourhood
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), name)
        large = cut(spread_join(both.where("v > u"), "u", "v", low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # small star: smaller neighbours and u itself point at the smallest of them
        down = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        small = spread_join(large, "u", "v", down).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        new = cut(small.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct(), name)
        # a forest of stars: no node points at two, or both points and is pointed at
        ends = new.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(new.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.agg(F.count_if((F.col("out") > 1) | (F.col("out") + F.col("into") > 1))).first()[0]:
            break
        e = new
    roots = new.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(new.select(F.col("v"), F.col("v")).distinct())


def linked_rows(rows: DataFrame, links: DataFrame, edges: DataFrame, roots: bool = False) -> DataFrame:
    """``rows(id, node, ...)`` with ``class_id``, ``n_links`` and ``component_id``.

    Rows with one node are equal and linked with each other; ``links(node, n)`` are parts of
    how many rows of other nodes a node is linked with, and ``edges(a, b)`` join what is linked.
    Rows whose node is null are linked with nothing. ids named are the smallest of their class
    and of their component; ids may be null or repeated, so they are no keys. With ``roots`` a column ``root`` is
    the component's key (a node; null where a row is linked with nothing). Only nodes that have a link at all are
    joined back.
    """
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"), F.min("id").alias("class_id"))
    total = links.groupBy("node").agg(F.sum("n").alias("n"))
    info = classes.join(total, "node", "left").join(components(edges), "node", "left").where("rows > 1 OR root IS NOT NULL")
    info = info.select("node", "class_id", "rows", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    info = cut(info, "links")
    found = cut(info.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")), "links-found")
    info = cut(spread_join(info, "root", "node", found).drop(*([] if roots else ["root"])).withColumnRenamed("rows", "n"), "links")
    # rows of one class, which may be a third of all, are dealt by a salt of their id; those of no class need no join
    known = spread_join(rows.where("node IS NOT NULL"), "node", "id", info, "left")
    bare = rows.where("node IS NULL").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in info.schema if f.name not in ("node", "n")))
    got = known.select(bare.columns).unionByName(bare)
    return got.select(*rows.columns, F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), *(["root"] if roots else []))


def labels_of(n: int, a, b):
    """Local connected components of n things by pairs (numpy arrays a, b): each thing's smallest companion."""
    import numpy as np

    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
