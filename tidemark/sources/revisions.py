"""Published revisions: shards, a manifest that says what they hold, and one pointer written last; snapshots with a sidecar."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.spread import settled

MANIFEST = "name string, shard long, rows long, digest decimal(38,0), revision string, generated_at string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder that no other run uses."""
    settled(spark.range(0))  # sets the folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def row_digest(columns: list[str]) -> Column:
    """The sum of the rows' hashes, in whatever order they come; with their number it tells a table that has lost, doubled or changed a row."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")


def _file_context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def point(spark: SparkSession, base: str, revision: str, generated_at: str) -> None:
    """Makes ``revision`` the one that readers see: the pointer is written beside the old one and put in its place by one rename."""
    jvm, at, _ = _file_context(spark, f"{base}/latest.json")
    new = jvm.org.apache.hadoop.fs.Path(f"{base}/.latest-{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(new, False)
    try:
        out.write(bytearray(json.dumps({"revision": revision, "generated_at": generated_at}).encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, at, options)


def pointer(spark: SparkSession, base: str) -> dict | None:
    """What the pointer says; None where nothing has been published."""
    _, at, system = _file_context(spark, f"{base}/latest.json")
    return json.loads("\n".join(r.value for r in spark.read.text(f"{base}/latest.json").collect())) if system.exists(at) else None


def write_shards(base: str, revision: str, generated_at: str, tables: dict[str, DataFrame]) -> None:
    """Writes each table's rows (``shard`` says where) below the revision's own folder; no reader looks there yet. A revision is written once:
    an existing one is an error."""
    for name, rows in tables.items():
        stamped = rows.withColumns({"revision": F.lit(revision), "generated_at": F.lit(generated_at)})
        write_table(stamped, f"{base}/r/{revision}/{name}")


#: folders of a table: beyond as many shards, several on end share one, so that their number does not grow with the table
FOLDERS = 256


def write_table(rows: DataFrame, path: str) -> None:
    """``rows`` in folders named after the first of their shards, each written by one task in the shards' order; a row's ``_at`` is how far its
    shard is from that one."""
    last = rows.agg(F.max("shard")).first()[0] or 0
    at = F.pmod(F.col("shard"), F.lit(last // FOLDERS + 1))
    placed = rows.withColumn("_at", at.cast("int")).withColumn("shard", F.col("shard") - F.col("_at"))
    placed.repartition("shard").sortWithinPartitions("shard", "_at").write.partitionBy("shard").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_table`` has written; files without ``_at`` hold their folder's shard alone."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.withColumn("shard", F.col("shard").cast("long") + F.coalesce("_at", F.lit(0))).drop("_at")


def _held(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    own = sorted(c for c in rows.columns if c not in ("shard", "revision", "generated_at"))
    return rows.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("rows"), row_digest(own).alias("digest"), *more).withColumn("name", F.lit(name))


def write_manifest(base: str, revision: str, generated_at: str, tables: dict[str, DataFrame]) -> None:
    """One row per shard: how many rows it has and their digest."""
    spark = next(iter(tables.values())).sparkSession
    every = spark.createDataFrame([], MANIFEST)
    for name, rows in tables.items():
        every = every.unionByName(_held(rows, name).withColumns({"revision": F.lit(revision), "generated_at": F.lit(generated_at)}))
    every.coalesce(1).write.parquet(f"{base}/r/{revision}/manifest")


def publish(spark: SparkSession, base: str, revision: str, generated_at: str, tables: dict[str, DataFrame]) -> None:
    """Shards, then the manifest, then the pointer: a reader sees the whole revision or the one before."""
    write_shards(base, revision, generated_at, tables)
    write_manifest(base, revision, generated_at, tables)
    point(spark, base, revision, generated_at)


@dataclass
class Served:
    """A revision as read: ``problems(name, shard, problem)``, one row per shard that is not what the manifest says, and the rows of the
    shards that are."""

    base: str
    revision: str
    problems: DataFrame
    tables: dict[str, DataFrame]


def served(spark: SparkSession, base: str, names: list[str]) -> Served:
    """The revision that the pointer names, checked shard by shard.

    Problems are ``missing`` (no rows), ``extra`` (not in the manifest), ``revision`` (rows of another revision or time), ``count`` and ``content``
    (other rows than written). Shards with a problem give no rows, others all. Without a pointer: FileNotFoundError.
    """
    found = pointer(spark, base)
    if found is None:
        raise FileNotFoundError(f"{base}/latest.json")
    root = f"{base}/r/{found['revision']}"
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    problems, tables = spark.createDataFrame([], "name string, shard long, problem string"), {}
    for name in names:
        rows = read_table(spark, f"{root}/{name}")
        foreign = F.count_if((F.col("revision") != found["revision"]) | (F.col("generated_at") != found["generated_at"])).alias("foreign")
        held = _held(rows, name, foreign).select("shard", F.col("rows").alias("has"), F.col("digest").alias("own"), "foreign")
        both = manifest.where(F.col("name") == name).join(held, "shard", "full_outer")
        problem = (
            F.when(F.col("has").isNull(), "missing").when(F.col("rows").isNull(), "extra").when(F.col("foreign") > 0, "revision").when(F.col("rows") != F.col("has"), "count").when(F.col("digest") != F.col("own"), "content")
            .when((F.col("manifest_revision") != found["revision"]) | (F.col("manifest_time") != found["generated_at"]), "revision")
        )
        both = both.withColumnsRenamed({"revision": "manifest_revision", "generated_at": "manifest_time"})
        bad = settled(both.select(F.lit(name).alias("name"), "shard", problem.alias("problem")).where("problem IS NOT NULL"))
        problems = problems.unionByName(bad)
        tables[name] = rows.join(F.broadcast(bad.select("shard")), "shard", "left_anti").drop("revision", "generated_at")  # shards, not rows
    return Served(base, found["revision"], problems, tables)


def snapshot(rows: DataFrame, path: str) -> None:
    """``rows`` at ``path``, and beside it how many they are and their digest."""
    rows.write.parquet(f"{path}/rows")
    spark_rows = rows.sparkSession.read.parquet(f"{path}/rows")
    spark_rows.agg(F.count("*").alias("rows"), row_digest(sorted(rows.columns)).alias("digest")).coalesce(1).write.parquet(f"{path}/sidecar")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``rows``, ``expected`` and whether the snapshot at ``path`` is what its sidecar says (``intact``)."""
    rows = spark.read.parquet(f"{path}/rows")
    side = spark.read.parquet(f"{path}/sidecar").select(F.col("rows").alias("expected"), F.col("digest").alias("wanted"))
    now = rows.agg(F.count("*").alias("rows"), row_digest(sorted(rows.columns)).alias("digest"))
    return now.join(side).select("rows", "expected", ((F.col("rows") == F.col("expected")) & (F.col("digest") == F.col("wanted"))).alias("intact"))  # one row each


def damage(before: DataFrame, after: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """``(key, finding)``: what ``after`` has lost, doubled, changed or added against ``before``.

    Buckets of keys are compared by number and digest first; only rows of buckets that differ are compared one by one.
    """
    columns = sorted(before.columns)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    sums = lambda df, side: df.groupBy(bucket).agg(F.count("*").alias(f"n_{side}"), row_digest(columns).alias(f"d_{side}"))
    differ = sums(before, "l").join(sums(after, "r"), "_bucket", "full_outer").where("NOT (n_l <=> n_r AND d_l <=> d_r)").select("_bucket")
    differ = F.broadcast(differ)  # at most ``buckets`` rows
    rows = lambda df, side: df.withColumn("_bucket", bucket).join(differ, "_bucket", "left_semi").groupBy(key).agg(F.count("*").alias(f"n_{side}"), row_digest(columns).alias(f"d_{side}"))
    both = rows(before, "l").join(rows(after, "r"), key, "full_outer")
    finding = F.when(F.col("n_r").isNull(), "lost").when(F.col("n_l").isNull(), "added").when(F.col("n_r") > F.col("n_l"), "doubled").when(F.col("n_r") < F.col("n_l"), "lost").when(F.col("d_l") != F.col("d_r"), "changed")
    return both.select(key, finding.alias("finding")).where("finding IS NOT NULL")
