"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import copies, cut, fresh, table

#: a word is a run of anything but ASCII white space
WORDS = r"[^\x20\x09-\x0D]+"
#: no document and no source is taken more often than this
MAX_COPIES = 3
#: rows of one source and size class are numbered in so many independent runs, and those in parts of at most about RUN_ROWS rows
RUNS, RUN_ROWS = 64, 2048
#: runs whose rows are added up before those of other such groups of runs
GROUP = 1024
SEED = "mix-1"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _hash32(text: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes(source, source_size)`` to the same with ``target``.

    Sources by code point, null last, weigh 1, 2, 3 and so on in turn. A target is
    ``min(max_copies * size, level * weight)``; the level that shares out the whole is the
    largest of the levels found by capping the first 0, 1, 2, ... sources in order of
    ``cap / weight``. There is one row per source here, not per document.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(rank) - 1) % 3 + 1).withColumn("cap", max_copies * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    w = w.withColumn("level", level)
    w = w.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
    return w.select("source", "source_size", "target")


def _before(runs: DataFrame) -> DataFrame:
    """``runs(key, cls, run, n)`` with ``before``, the rows of the key's runs that come earlier: those of earlier classes, of earlier groups of
    GROUP runs in the class, of earlier runs in the group. No window sees more than a key's classes, a class's groups or a group's runs."""
    runs = runs.withColumn("group", F.floor(F.col("run") / GROUP))
    groups = runs.groupBy("key", "cls", "group").agg(F.sum("n").alias("n"))
    classes = groups.groupBy("key", "cls").agg(F.sum("n").alias("n"))
    earlier = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("key", "cls", earlier("key", "cls").alias("of_class"))
    groups = groups.select("key", "cls", "group", earlier("key", "cls", "group").alias("of_group")).join(classes, ["key", "cls"])
    found = runs.withColumn("before", earlier("key", "cls", "group", "run")).join(groups, ["key", "cls", "group"])
    return found.withColumn("before", F.col("before") + F.col("of_group") + F.col("of_class")).drop("group", "of_group", "of_class")


MIXED = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, max_copies: int = MAX_COPIES, seed: str = SEED, names: tuple[str, ...] | None = None, sizes: F.Column | None = None) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (or the four ``names``; a name
    that ``docs`` has itself gets underscores until it is new).

    Within a source every document is expected ``target / source_size`` times, so the
    prefix sum of expected copies is rank times that rate; with one random offset per
    source a document comes out once for each integer that its stretch crosses. Ranks run
    in order of size class, then of a hash, so the words taken stay close to the target.
    A rank is the number within (source, size class, hash run) plus the rows of the
    runs before; runs grow in number with the rows, so a source with a third of all rows is spread over
    many tasks. Sizes per run are summed once, written, and used for targets and ranks alike.

    Null text, or one of white space only, has size 0 and is sampled like others; a null
    source is a source of its own; a source without any word has the target 0 and is left
    out. Repeated rows count one by one. An empty table gives an empty table. Needs
    ``doc_id``, ``source`` and ``text`` (or, in its place, ``sizes``: the words of each row, not null); other columns are kept. The result does not depend
    on how rows lie in partitions.
    """
    size, source_size, target, times = names or tuple(fresh(docs, f"mix_{n}") for n in MIXED)
    key, cls, run, tick, off, rate, shift = (fresh(docs, f"mix_{n}") for n in ("key", "class", "run", "tick", "before", "rate", "shift"))
    parts = 1 + docs.count() // (RUNS * RUN_ROWS)
    rows = (
        docs.withColumn(size, word_count(F.col("text")) if sizes is None else sizes)
        .withColumn(key, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .withColumn(cls, F.floor(F.sqrt(size)))
        .withColumn(tick, _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        .withColumn(run, F.col(tick) % RUNS * parts + F.floor(F.col(tick) * parts / 2**32))
    )
    runs = rows.groupBy(F.col(key).alias("key"), F.col(cls).alias("cls"), F.col(run).alias("run")).agg(F.count("*").alias("n"), F.sum(size).alias("words"), F.min("source").alias("source"))
    runs = cut(runs, "mix-runs")
    goals = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), max_copies)
    runs = _before(runs)
    goals = goals.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), F.col("source_size").alias("total"), F.col("target").alias("goal"))
    goals = goals.withColumn("rate", F.when(F.col("total") > 0, F.col("goal") / F.col("total")).otherwise(0.0))
    goals = goals.withColumn("shift", _hash32(F.concat(F.lit(seed + "/"), "key")) / F.lit(4294967296.0))
    plan = runs.join(goals, "key").select(F.col("key").alias(key), F.col("cls").alias(cls), F.col("run").alias(run), F.col("before").alias(off), F.col("total").alias(source_size), F.col("goal").alias(target), F.col("rate").alias(rate), F.col("shift").alias(shift))
    within = Window.partitionBy(key, cls, run).orderBy(tick, "doc_id", size)
    k = F.col(off) + F.row_number().over(within)
    ranked = rows.join(plan, [key, cls, run]).withColumn(off, k)
    reach = lambda at: F.floor(F.col(shift) + at * F.col(rate))
    drawn = F.least(F.lit(max_copies), reach(F.col(off)) - reach(F.col(off) - 1)).cast("int")
    return ranked.withColumn(times, drawn).select(*docs.columns, size, source_size, target, times)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with the columns of ``docs`` (whatever their
    names). Odd rows are treated as ``mix`` says; an empty table gives an empty one."""
    names = tuple(fresh(docs, f"mix_{n}") for n in MIXED)
    return copies(mix(docs, names=names), names[3]).select(docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix(cut(sized, "mix-sizes"), sizes=F.col("words"))  # texts are read once
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS tick
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {MAX_COPIES} * source_size AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{SEED}/' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), tick % {RUNS}, tick, doc_id, size) AS k FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target,
  CAST(least({MAX_COPIES}, floor(shift + k.k * rate) - floor(shift + (k.k - 1) * rate)) AS BIGINT) * k.size AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""
