"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: hash bits that the directory can use
BITS = 60
SHARD_BYTES = 64 << 20
#: the limit of the query: small enough that even small tables are split
QUERY_BYTES = 1 << 19
#: cells are cut so many bits finer than an even spread would need
SPARE_BITS = 5


def _hash(text: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``key`` and ``bytes``) with ``copy``: 1, 2, ... among the rows of the same key and size.

    Rows are written with a number of their own first, whose upper part is the partition that they lay in. Copies are counted per
    partition, and a copy's number is that within its partition and those of the partitions before: no task has
    more of them than a partition of the input had.
    """
    at, n, before = fresh(rows, "shard_at"), fresh(rows, "shard_n"), fresh(rows, "shard_before")
    tagged = cut(rows.withColumn(at, F.monotonically_increasing_id()), "shard-rows")
    same = [F.coalesce(F.concat(F.lit("k"), "key"), F.lit("n")).alias("k_"), F.col("bytes").alias("b_"), F.shiftright(at, 33).alias("p_")]
    parts = tagged.select(*same).groupBy("k_", "b_", "p_").agg(F.count("*").alias(n))
    every = Window.partitionBy("k_", "b_")
    ahead = every.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    many = parts.select("*", F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before), F.sum(n).over(every).alias("all_")).where("all_ > 1").drop(n, "all_")
    got = tagged.select("*", *same).join(many, ["k_", "b_", "p_"], "left")
    within = F.row_number().over(Window.partitionBy("k_", "b_", "p_").orderBy(at))
    return got.withColumn("copy", (F.coalesce(before, F.lit(0)) + within).cast("int")).drop("k_", "b_", "p_", at, before)


def assign_shards(rows: DataFrame, limit: int = SHARD_BYTES, spare: int = SPARE_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``key`` and ``bytes`` to ``(assignment, directory)``.

    assignment: ``rows`` with all their columns and ``copy, hash, shard`` (columns of these names, and those
    whose names end in ``_`` and stand for a row's group, are replaced); key comes as text. directory: one row
    per shard, ``shard, depth, prefix, shard_bytes, shard_rows``; the entry for any longer
    hash prefix is the shard whose prefix it starts with.

    A bucket is the set of hashes with one prefix. Bytes are summed per cell (a prefix of
    ``log2(total / limit) + spare`` bits, combined before the shuffle) and rolled up to all
    shorter prefixes; a bucket becomes a shard when it fits and its parent does not, so
    only buckets over ``limit`` were split. Cells that still do not fit go another round of
    16 bits, with their rows alone.

    Rows with the same key and size are numbered (``copy``), and
    the number is hashed too: a key with a third of all rows is split like any other.
    A row over the limit gets a shard of its own (depth -1) and splits nothing. Null keys
    are one key; null bytes count 0. An empty table gives two empty tables. When all BITS
    bits are used the bucket stays as it is; that takes equal 60-bit hashes.
    """
    clean = rows.drop("copy", "hash", "shard", "k_", "b_", "p_", "all_", "cell")
    each = numbered(clean.withColumn("key", F.col("key").cast("string")).withColumn("bytes", F.coalesce(F.col("bytes"), F.lit(0)).cast("long")))
    each = each.withColumn("hash", _hash(F.concat_ws("/", F.coalesce(F.concat(F.lit("k"), "key"), F.lit("n")), "bytes", "copy")))
    each = cut(each, "shard-numbered")
    name = lambda depth, prefix: F.concat(F.lit("h"), F.lpad(F.bin(prefix), depth, "0"))
    own = each.where(F.col("bytes") > limit).withColumn("shard", F.concat(F.lit("x"), F.lpad(F.hex("hash"), 15, "0"), F.lit("-"), F.col("copy").cast("string")))
    assigned = [own]
    directory = [own.select("shard", F.lit(-1).alias("depth"), F.col("hash").alias("prefix"), F.col("bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows"))]
    active = each.where(F.col("bytes") <= limit)
    total = active.agg(F.sum("bytes")).first()[0] or 0
    low, depth = 0, min(BITS, max(0, -(-total // limit)).bit_length() + spare)
    while True:
        at = lambda d: F.shiftright(F.col("hash"), BITS - d)
        cells = active.withColumn("cell", at(depth)).groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        cells = cut(cells, "shard-cells")
        above = F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth")
        ups = cells.select("cell", "bytes", "n", above).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        nodes = ups.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        over = nodes.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = F.col("shard_bytes") <= limit if depth < BITS else (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        leaves = nodes.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        first = leaves.where(F.col("depth") == low).drop("parent")
        leaves = leaves.join(over, ["depth", "parent"], "left_semi").select(first.columns)
        leaves = cut((leaves if low else leaves.union(first)).withColumn("shard", name(F.col("depth"), F.col("prefix"))), "shard-leaves")
        directory.append(leaves.select("shard", F.col("depth").cast("int").alias("depth"), "prefix", "shard_bytes", "shard_rows"))
        of_cell = ups.select("cell", "depth", "prefix").join(leaves.select("depth", "prefix", "shard"), ["depth", "prefix"]).select("cell", "shard")
        assigned.append(active.withColumn("cell", at(depth)).join(of_cell, "cell").select(each.columns + ["shard"]))
        rest = cells.where(F.col("bytes") > limit).select("cell")
        if depth == BITS or rest.isEmpty():
            break
        active = active.withColumn("cell", at(depth)).join(rest, "cell", "left_semi").select(each.columns)
        low, depth = depth, min(BITS, depth + 16)
    out, shards = assigned[0].select(each.columns + ["shard"]), directory[0]
    for a, d in zip(assigned[1:], directory[1:], strict=True):
        out, shards = out.union(a), shards.union(d)
    return out, shards


def op6_sharding(spark, sf_dir: str, limit: int = QUERY_BYTES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.octet_length("text").alias("bytes"))
    rows, shards = assign_shards(docs, limit)
    out = rows.join(shards, "shard")
    return out.select(F.col("key").cast("long").alias("doc_id"), "bytes", "copy", "hash", "shard", "depth", "shard_bytes", "shard_rows")


def op6_sql(limit: int = QUERY_BYTES) -> str:
    return f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bytes) AS copy FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce('k' || doc_id, 'n') || '/' || bytes || '/' || copy), 1, 15) AS BIGINT) AS hash FROM c),
e AS (SELECT h.*, g.depth, hash >> ({BITS} - g.depth) AS prefix FROM h, generate_series(0, {BITS}) AS g(depth) WHERE bytes <= {limit}),
n AS (SELECT *, CAST(sum(bytes) OVER p AS BIGINT) AS shard_bytes, count(*) OVER p AS shard_rows FROM e WINDOW p AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY hash, copy, doc_id ORDER BY depth) AS o FROM n WHERE shard_bytes <= {limit} OR depth = {BITS})
SELECT doc_id, bytes, copy, hash, 'h' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard,
  CAST(depth AS INTEGER) AS depth, shard_bytes, shard_rows FROM f WHERE o = 1
UNION ALL
SELECT doc_id, bytes, copy, hash, 'x' || lpad(upper(to_hex(hash)), 15, '0') || '-' || copy, -1, bytes, 1 FROM h WHERE bytes > {limit}
"""


OP6_SQL = op6_sql()
