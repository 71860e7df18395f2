"""The organization tree as it is drawn: under campuses, without aliases, pruned, and flattened to the rows that are seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import drawn, rootless
from .spread import running, settled

ROOT, OTHER = "root", "other"
#: between the parts of a node's place in the order, and between keys
STEP = "\u0001"


def _part(rank: Column, name: Column, ident: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit("|"), name, F.lit("|"), ident)


def tree(nodes: DataFrame, campuses: list[str]) -> DataFrame:
    """``nodes(id, parent, name, is_alias, kind, campuses array, active)`` to the drawn tree's rows: ``key, path, place, depth, kind, id, name, grp, active``.

    Campuses stand under the root in the order given, then what belongs to none. An alias is drawn as what it stands for, which gets its ``active``
    boards and its children. A node stands below its parent, at the top if it has none, if that is no node, or if the way up never ends; at the top it
    stands under each of its campuses, with all that is below it, so one node may have several rows. ``key`` names the way from the root, ``path`` the
    keys from the root to the row, ``place`` sorts rows as a walk meets them: colleges first, then by name and id. ``grp`` (college or other) is given for
    nodes directly under a campus. One join per level of the tree.
    """
    spark, text = nodes.sparkSession, lambda x: F.lit(x).cast("string")
    lost = rootless(nodes.select("id", "parent")).withColumn("lost", F.lit(True))
    d = drawn(nodes.select("id", "parent", "is_alias"))
    boards = d.join(nodes.select("id", "active"), "id").groupBy(F.col("drawn_id").alias("id")).agg(F.sum("active").alias("active"))
    up = d.select(F.col("id").alias("parent"), F.col("drawn_id").alias("up"))
    rows = nodes.drop("active").join(d.where("id = drawn_id").select("id"), "id", "left_semi").join(lost, "id", "left").join(up, "parent", "left").join(boards, "id")
    above = F.when(F.col("lost").isNull() & (F.col("up") != F.col("id")), F.col("up"))
    rows = settled(rows.select("id", above.alias("up"), "name", "kind", "campuses", "active", F.when(F.col("kind") == "college", 0).otherwise(1).alias("rank")))
    tops = [(i, f"campus:{c}", c) for i, c in enumerate(campuses)] + [(len(campuses), OTHER, OTHER)]
    buckets = spark.createDataFrame([(ROOT, [ROOT], ROOT, 0, "root", ROOT)] + [(k, [ROOT, k], f"{ROOT}{STEP}{i:04d}", 1, "other" if c == OTHER else "campus", c) for i, k, c in tops], "key string, path array<string>, place string, depth int, kind string, name string")
    own = F.array_distinct(F.filter(F.coalesce("campuses", F.array().cast("array<string>")), lambda c: c.isin(campuses)))
    first = rows.where("up IS NULL").withColumn("bucket", F.explode(F.when(F.size(own) > 0, F.transform(own, lambda c: F.concat(F.lit("campus:"), c))).otherwise(F.array(F.lit(OTHER)))))
    first = first.join(F.broadcast(buckets.select(F.col("key").alias("bucket"), F.col("path").alias("p"), F.col("place").alias("at"))), "bucket")  # campuses
    group = F.when(F.col("kind") == "college", "college").otherwise("other")

    def below(found: DataFrame, depth: int, grp: Column) -> DataFrame:
        key = F.concat(F.element_at("p", -1), F.lit("/"), "id")
        return settled(found.select(key.alias("key"), F.concat("p", F.array(key)).alias("path"), F.concat("at", F.lit(STEP), _part(F.col("rank"), F.col("name"), F.col("id"))).alias("place"), F.lit(depth).alias("depth"), "kind", "id", "name", grp.alias("grp"), "active"))

    level = below(first, 2, group)
    out = buckets.select("key", "path", "place", "depth", "kind", text(None).alias("id"), "name", text(None).alias("grp"), F.lit(0).cast("long").alias("active")).unionByName(level)
    depth = 2
    while not level.isEmpty():
        depth += 1
        level = below(level.select(F.col("id").alias("up"), F.col("path").alias("p"), F.col("place").alias("at")).join(rows, "up"), depth, text(None))
        out = out.unionByName(level)
    return out


def pruned(rows: DataFrame, keep: Column) -> DataFrame:
    """The rows of ``tree`` that ``keep`` holds for, and all above them; the root always stays."""
    kept = rows.where(F.coalesce(keep, F.lit(False))).select(F.explode("path").alias("key")).union(rows.where("kind = 'root'").select("key")).distinct()
    return rows.join(kept, "key", "left_semi")


def visible(rows: DataFrame, selected: DataFrame, campus: str | None = None, keyword: str = "", show_empty: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """What is seen of ``tree`` with the organizations ``selected(id)``: ``position, type, key, depth, name, has_children, open, covered``.

    Kept are organizations whose name has the keyword, if there is one; else those selected, colleges, those with boards or notices (``counts(id, n)``),
    and, with ``show_empty``, all; and what leads to them. Open are the root, the campus one is at, and the ways to selected organizations
    and these themselves; with a keyword everything. A row is seen when all above it are open, and covered when one of them is selected. Under a campus
    that has both, colleges and others get a caption.
    """
    chosen, all_open = selected.select("id").distinct().withColumn("chosen", F.lit(True)), bool(keyword.strip())
    r = rows.join(chosen, "id", "left")
    r = r.join(counts.select("id", "n"), "id", "left") if counts is not None else r.withColumn("n", F.lit(0))
    own = F.lower("name").contains(keyword.strip().lower()) if all_open else (F.col("chosen").isNotNull() | (F.col("kind") == "college") | F.lit(show_empty) | (F.col("active") > 0) | (F.coalesce("n", F.lit(0)) > 0))
    r = settled(pruned(r, F.col("id").isNotNull() & own))
    ways = rows.join(chosen, "id").select(F.explode("path").alias("key"))
    opened = ways.union(rows.where((F.col("kind") == "root") | (F.col("key") == F.lit(f"campus:{campus}"))).select("key")).distinct().withColumn("is_open", F.lit(True))
    parents = r.where("depth > 0").select(F.element_at("path", -2).alias("key"), "grp").groupBy("key").agg(F.lit(True).alias("has_children"), F.max(F.col("grp") == "college").alias("colleges"), F.max(F.col("grp") == "other").alias("others"))
    r = r.join(opened, "key", "left").join(parents, "key", "left").withColumn("is_open", F.lit(all_open) | F.coalesce("is_open", F.lit(False)))
    r = settled(r.withColumn("has_children", F.coalesce("has_children", F.lit(False))))
    # how many of the rows above are open, and whether one is selected
    above = r.select("key", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("a")).join(r.select(F.col("key").alias("a"), "is_open", "chosen"), "a")
    above = above.groupBy("key").agg(F.count_if("is_open").alias("ways"), F.max(F.coalesce("chosen", F.lit(False))).alias("covered"))
    seen = r.join(above, "key", "left").where(F.coalesce("ways", F.lit(0)) == F.size("path") - 1)
    node = seen.select(F.lit("node").alias("type"), "key", "place", "depth", "name", "has_children", (F.col("is_open") & F.col("has_children")).alias("open"), F.coalesce("covered", F.lit(False)).alias("covered"))
    split = seen.where("kind IN ('campus', 'other') AND is_open AND colleges AND others").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"))
    name = F.when(F.col("rank") == 0, "college").otherwise("other")
    # before all of its group: no name sorts before none
    caption = split.select(F.lit("caption").alias("type"), F.concat("key", F.lit("#"), name).alias("key"), F.concat("place", F.lit(STEP), F.col("rank").cast("string"), F.lit("|")).alias("place"), (F.col("depth") + 1).alias("depth"), name.alias("name"), F.lit(False).alias("has_children"), F.lit(False).alias("open"), F.lit(False).alias("covered"))
    placed = running(node.unionByName(caption).withColumn("one", F.lit(1).cast("long")), "place", sums=("one",))
    return placed.select(F.col("one_before").alias("position"), "type", "key", "depth", "name", "has_children", "open", "covered")
