"""Merges, their audit and what takes them back; resolving entities; selections in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import closure
from .spread import dealt_join, settled


def merge_links(links: DataFrame, pairs: DataFrame, reason: str) -> DataFrame:
    """``links(id, notice, is_active, is_primary, reason)`` after ``pairs(keep, absorb)``, one per absorbed notice:
    its active links go to the kept one, no longer primary; others stay. A pair of one notice with itself does nothing."""
    p = pairs.where("keep <> absorb").select(F.col("absorb").alias("notice"), "keep")
    moves = F.col("is_active") & F.col("keep").isNotNull()
    return links.join(p, "notice", "left").select(
        "id",
        F.when(moves, F.col("keep")).otherwise(F.col("notice")).alias("notice"),
        "is_active",
        (F.col("is_primary") & ~F.coalesce(moves, F.lit(False))).alias("is_primary"),
        F.when(moves, F.lit(reason)).otherwise(F.col("reason")).alias("reason"),
    )


def merge_records(pairs: DataFrame, reason: str, actor: str = "auto") -> DataFrame:
    """The redirect and the audit row of each merge."""
    after = F.to_json(F.struct(F.col("absorb").alias("absorbed")))
    return pairs.where("keep <> absorb").select(
        F.col("absorb").alias("from_id"), F.col("keep").alias("to_id"), F.lit(actor).alias("actor"), F.lit("notice.merge").alias("action"), after.alias("after"), F.lit(reason).alias("reason")
    )


def changes(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Audit rows ``(id, before, after)`` of what a backfill changes; both sides are ``(id, value)``."""
    s, w = stored.select("id", F.col("value").alias("before")), wanted.select("id", F.col("value").alias("after"))
    return s.join(w, "id").where(~F.col("before").eqNullSafe(F.col("after")))


def reverted(current: DataFrame, audit: DataFrame) -> DataFrame:
    """``current(id, value)`` with each audited change taken back, unless the value has been changed again since."""
    got = current.join(audit.withColumn("audited", F.lit(True)), "id", "left")
    back = F.col("audited").isNotNull() & F.col("value").eqNullSafe(F.col("after"))
    return got.select("id", F.when(back, F.col("before")).otherwise(F.col("value")).alias("value"), F.coalesce(back, F.lit(False)).alias("reverted"))


def resolve(wanted: DataFrame, known: DataFrame, strategies: list[str]) -> DataFrame:
    """``(id, known_id, strategy)``: each wanted row claims a known row by the first strategy (a key column of both sides)
    that finds one; a known row is claimed once. Several rows of one key are paired in the order of their ids; null
    keys match nothing; rows without a claim are ``new``."""
    left, free, found = wanted, known, None
    ranked = lambda df, key: df.where(F.col(key).isNotNull()).select(key, "id", F.row_number().over(Window.partitionBy(key).orderBy("id")).alias("rank"))
    for key in strategies:
        got = ranked(left, key).join(ranked(free, key).withColumnRenamed("id", "known_id"), [key, "rank"]).select("id", "known_id", F.lit(key).alias("strategy"))
        got = settled(got)  # else each further strategy reads all earlier ones again, several times over
        found = got if found is None else found.union(got)
        left = left.join(got.select("id"), "id", "left_anti")
        free = free.join(got.select(F.col("known_id").alias("id")), "id", "left_anti")
    rest = left.select("id", F.lit(None).cast(known.schema["id"].dataType).alias("known_id"), F.lit("new").alias("strategy"))
    return rest if found is None else found.union(rest)


def normalized_selection(picks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``picks(owner, position, id)`` to the ``(owner, id)`` that stay when a pick takes out the picked nodes above and
    below it: a node stays if none of those is picked after its own last pick. Ids that are no nodes stay."""
    last = settled(picks.groupBy("owner", "id").agg(F.max("position").alias("position")))
    # up from each pick, not down: a node has few above it, but any number below
    up = closure(nodes.select("id", "parent")).where("depth > 0").groupBy(F.col("descendant").alias("id")).agg(F.collect_set("ancestor").alias("others"))
    pairs = dealt_join(last, up, "id").select("owner", "id", "position", F.explode("others").alias("other"))
    both = pairs.join(last.select("owner", F.col("id").alias("other"), F.col("position").alias("then")), ["owner", "other"]).where("then <> position")
    gone = both.select("owner", F.when(F.col("then") > F.col("position"), F.col("id")).otherwise(F.col("other")).alias("id")).distinct()
    return last.join(gone, ["owner", "id"], "left_anti").select("owner", "id")


def daily_full(last: Column, now: Column, hour: int, every_hours: int, offset_hours: int = 9) -> Column:
    """Why everything must be made anew, or null: ``unknown``, ``gap`` or ``new_day`` (by the local clock)."""
    local = lambda t: t + F.expr(f"INTERVAL {offset_hours} HOURS")
    new_day = (F.to_date(local(now)) > F.to_date(local(last))) & (F.hour(local(now)) >= hour)
    gap = now >= last + F.expr(f"INTERVAL {max(1, every_hours) + 2} HOURS")
    return F.when(last.isNull(), "unknown").when(gap, "gap").when(new_day, "new_day")


def self_adjusting(adjusted: Column, original: Column, shown: Column) -> Column:
    """True if the shown date changes with time alone; where a date is missing, to be safe."""
    return F.coalesce(adjusted, F.lit(False)) & F.coalesce(original >= shown, F.lit(True))
