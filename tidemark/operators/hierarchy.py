"""Trees given as parent links: closures, scopes, paths and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import dealt_join, settled

#: no real tree is deeper; a closure ends here
DEPTH = 12


def closure(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``nodes(id, parent)`` to ``(ancestor, descendant, depth)``, each node its own ancestor at 0.
    One join with the nodes for each level that the tree has, and no bound on rows, as a recursive query has one
    (``spark.sql.cteRecursionRowLimit``). Levels are written."""
    up = nodes.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    level = nodes.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"), F.col("parent").alias("next"))
    found = level
    for k in range(1, depth + 1):
        level = level.where("next IS NOT NULL").select(F.col("next").alias("ancestor"), "descendant").join(up, "ancestor").select("ancestor", "descendant", F.lit(k).alias("depth"), "next")
        level = settled(level)
        if level.isEmpty():
            break
        found = found.union(level)
    return found.drop("next")


def scope(nodes: DataFrame, picked: DataFrame) -> DataFrame:
    """Ids that a selection reaches: the picked ones, all below them, and all above the picked ones."""
    c = closure(nodes)
    p = picked.select(F.col("id").alias("p"))
    below = c.join(p, c.ancestor == p.p, "left_semi").select(F.col("descendant").alias("id"))
    above = c.join(p, c.descendant == p.p, "left_semi").select(F.col("ancestor").alias("id"))
    return below.union(above).distinct()


def paths(nodes: DataFrame) -> DataFrame:
    """``nodes(id, parent, name)`` to ``(id, path)``, names from the root down."""
    c = closure(nodes.select("id", "parent"))
    named = c.join(nodes.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    return named.groupBy(F.col("descendant").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))), lambda x: x["name"]), " / ").alias("path"))


def drawn(nodes: DataFrame) -> DataFrame:
    """``nodes(id, parent, is_alias)`` to ``(id, drawn_id)``: an alias stands for its first ancestor that is none,
    or for itself where all are."""
    c = closure(nodes.select("id", "parent"))
    real = nodes.where(~F.col("is_alias")).select(F.col("id").alias("ancestor"))
    nearest = c.join(real, "ancestor", "left_semi").groupBy(F.col("descendant").alias("id")).agg(F.min_by("ancestor", "depth").alias("drawn_id"))
    return nodes.select("id").join(nearest, "id", "left").select("id", F.coalesce("drawn_id", "id").alias("drawn_id"))


def _endless(nodes: DataFrame) -> DataFrame:
    """``(id, to)`` of the nodes whose way up never ends, and a node on the cycle that it leads to.

    The step from child to parent is doubled: after as many steps as the longest way that ends, or leads into a cycle, what is still reached are
    the nodes on cycles alone, and then the number of nodes reached no longer falls. A round is one join; rounds are the logarithm of that way.
    """
    step = settled(nodes.where("parent IS NOT NULL").select(F.col("id"), F.col("parent").alias("to")))
    reached = -1
    while (n := step.select("to").distinct().count()) != reached:
        reached = n
        step = settled(dealt_join(step, step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
    return step


def cyclic(nodes: DataFrame) -> DataFrame:
    """Ids that lie on a cycle of whatever length; ``nodes(id, parent)`` has one parent per id."""
    return _endless(nodes).select(F.col("to").alias("id")).distinct()


def rootless(nodes: DataFrame) -> DataFrame:
    """Ids that lie on a cycle or below one."""
    return _endless(nodes).select("id").distinct()
