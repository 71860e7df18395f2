"""Duplicate notices: blocked candidate pairs, a verdict for each, and routing of merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

from .spread import connected, settled

#: blocks of more items are no evidence of anything and are left out, as the rule has it
LARGEST_BLOCK = 400
LONG_BODY, REVIEW, POSTER_REVIEW, ATTACHMENT_REVIEW = 200, 0.86, 0.95, 0.6


def prepare(items: DataFrame) -> DataFrame:
    """Adds what pairs are compared by, once per item: ``grams, print, years, rounds, semesters``."""
    head = F.concat(F.col("title"), F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, 2000))
    return items.withColumns({"grams": T.trigrams(T.normalize_title(F.col("title"))), "print": T.body_fingerprint(F.col("body")), "body_chars": F.length(F.coalesce("body", F.lit(""))), "years": T.markers(head, T.YEAR_MARK), "rounds": T.markers(head, T.ROUND_MARK), "semesters": T.markers(head, T.SEMESTER_MARK)})


def print_pairs(items: DataFrame) -> DataFrame:
    """Candidate pairs by equal body fingerprints; of the items only ids, sources and fingerprints move."""
    prints = settled(items.select("id", "source", T.body_fingerprint(F.col("body")).alias("print")).where("print IS NOT NULL"))
    return candidate_pairs(prints, F.array("print"))


def judged(items: DataFrame) -> DataFrame:
    """Verdicts on the pairs of ``print_pairs``. Only items of some pair are prepared, once."""
    pairs = settled(print_pairs(items))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return verdict(pairs, settled(prepare(items.join(ids, "id", "left_semi"))))


def candidate_pairs(items: DataFrame, keys: Column, largest: int = LARGEST_BLOCK) -> DataFrame:
    """``(a, b)``, a < b, of items from different sources that share a key of ``keys`` (an array).
    Block sizes are counted before the join, so an oversize block never meets itself."""
    k = items.select("id", "source", F.explode(F.array_distinct(keys)).alias("key"))
    ok = k.groupBy("key").count().where(F.col("count").between(2, largest)).select("key")
    k = k.join(ok, "key", "left_semi")
    l, r = k.alias("l"), k.alias("r")
    return l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.source") != F.col("r.source"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def oversized_blocks(items: DataFrame, keys: Column, largest: int = LARGEST_BLOCK) -> DataFrame:
    """``(key, items)`` of the blocks that ``candidate_pairs`` leaves out, for separate handling."""
    k = items.select("id", F.explode(F.array_distinct(keys)).alias("key"))
    return k.groupBy("key").agg(F.count("*").alias("items")).where(F.col("items") > largest)


def conflict(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def verdict(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of ``prepare``d items to ``a, b, decision, score``: the first rule that holds.
    Optional item columns ``audiences``, ``files`` and ``posters`` (arrays of keys) take part if present."""
    have = set(items.columns)
    cols = ["id", "source", "grams", "print", "body_chars", "years", "rounds", "semesters", *sorted(have & {"audiences", "files", "posters"})]
    side = lambda s: items.select(*(F.col(c).alias(f"{s}_{c}") for c in cols))
    p = pairs.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), F.col("b") == F.col("r_id"))
    c = lambda n: (F.col(f"l_{n}"), F.col(f"r_{n}"))
    shared = lambda n: F.arrays_overlap(*c(n)) if n in have else F.lit(False)
    p = p.withColumn("sim", T.set_similarity(*c("grams")))
    same = F.coalesce(F.col("l_print") == F.col("r_print"), F.lit(False))
    long = F.least(*c("body_chars")) >= LONG_BODY
    clash = conflict(*c("years")) | conflict(*c("rounds")) | conflict(*c("semesters"))
    if "audiences" in have:
        clash = clash | conflict(*c("audiences"))
    s = F.col("sim")
    decision = (
        F.when((F.col("a") == F.col("b")) | (F.col("l_source") == F.col("r_source")), "distinct")
        .when(clash, F.when(same | (s >= REVIEW), "review").otherwise("distinct"))
        .when(same & long & (s >= 0.5), "merge")
        .when(same & ~long, "review")
        .when(shared("posters") & (s >= POSTER_REVIEW), "review")
        .when(s >= REVIEW, "review")
        .when(shared("files") & (s >= ATTACHMENT_REVIEW), "review")
        .otherwise("distinct")
    )
    score = F.when(F.col("l_source") == F.col("r_source"), 0.0).when(decision == "merge", F.greatest(s, F.lit(0.95))).otherwise(s)
    return p.select("a", "b", decision.alias("decision"), score.alias("score"))


def recorded(verdicts: DataFrame) -> DataFrame:
    return verdicts.where((F.col("decision") != "distinct") | (F.col("score") >= 0.5))


def primary_order() -> list[Column]:
    """The order in which a cluster's primary item is picked: rank of the source, a body, its length, date, id."""
    return [F.col("rank"), (F.col("body_chars") == 0), F.col("body_chars").desc(), F.col("published").asc_nulls_last(), F.col("id")]


def merge_targets(merges: DataFrame) -> DataFrame:
    """``merges(a, b)`` to ``(node, target)``: the smallest id that merges lead to. A merge with itself names a node of its own."""
    alone = merges.where("a = b").select(F.col("a").alias("node")).distinct()
    found = connected(merges.select("a", "b"))
    return found.select("node", F.col("root").alias("target")).union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("target")))
