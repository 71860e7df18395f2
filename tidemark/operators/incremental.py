"""Keeping the published list and its page files up to date from what has changed, and checking that against a full build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import dealt_join, running, settled


@dataclass
class Revision:
    """``entries(id, key, digest, position)`` in list order, and ``pages(page, n, object, state)``: pages count from 0; the object
    is a digest of the ids and digests on the page; the state is kept, rewritten, or removed (no such page any more, n 0)."""

    entries: DataFrame
    pages: DataFrame


def page_content(entries: DataFrame, size: int) -> DataFrame:
    """``(page, n, object)`` of entries with positions. A page has at most ``size`` entries."""
    listed = F.array_sort(F.collect_list(F.struct("position", F.concat(F.col("id").cast("string"), F.lit(":"), F.col("digest")).alias("x"))))
    pages = entries.groupBy(F.floor(F.col("position") / size).alias("page")).agg(F.count("*").alias("n"), listed.alias("l"))
    return pages.select("page", "n", F.md5(F.array_join(F.transform("l", lambda r: r["x"]), ",")).alias("object"))


def built(entries: DataFrame, size: int) -> Revision:
    """A full build: all of ``entries(id, key, digest)`` are put in the order of ``key``."""
    placed = running(entries.withColumn("one", F.lit(1)), "key", sums=("one",))
    placed = settled(placed.select("id", "key", "digest", F.col("one_before").cast("long").alias("position")))
    return Revision(placed, page_content(placed, size).withColumn("state", F.lit("rewritten")))


def maintained(previous: Revision, changes: DataFrame, gone: DataFrame, size: int) -> Revision:
    """The revision after ``previous``, without putting the list in order again.

    ``changes(id, key, digest)`` are entries that are new or may differ, ``gone(id)`` those that leave (unless they change). ``key`` gives the
    order and is unique. Entries move by the number of insertions before them less that of removals, so:

    1. An insertion's page is found from the pages' first keys, its place from the at most ``size`` keys there.
    2. Insertions and removals, summed along the list page by page, give the shift at each page's start. A page with no event of its
       own and no shift is kept: its entries are not read.
    3. Entries of other pages get their shift from the page's own events; those pages are written anew.

    Work beyond one look at the page table is proportional to the changes and to what they move. No window holds more than a page
    and its events; events of one place are one row, however many are inserted there. Empty changes keep every page.
    """
    old = previous.entries.withColumn("page", F.floor(F.col("position") / size))
    asked = changes.select("id", F.col("key").alias("new_key"), F.col("digest").alias("new_digest")).join(gone.select("id", F.lit(True).alias("leaves")), "id", "full_outer")
    hit = settled(asked.join(old, "id", "left"))
    same = F.col("new_key").isNotNull() & F.col("new_key").eqNullSafe(F.col("key"))
    removed = hit.where(F.col("position").isNotNull() & ~same)
    touched = hit.where(same & ~F.col("digest").eqNullSafe(F.col("new_digest")))
    inserted = hit.where(F.col("new_key").isNotNull() & ~same).select("id", F.col("new_key").alias("key"), F.col("new_digest").alias("digest"))

    fences = settled(old.groupBy("page").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    marks = fences.select("key", "page", F.lit(None).cast(inserted.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("digest"))
    found = running(marks.unionByName(inserted.withColumn("page", F.lit(None).cast("long"))), "key", last=("page",)).where("id IS NOT NULL")
    found = found.select("id", "key", "digest", F.coalesce("page_last", F.lit(0)).alias("page"))
    keys = old.join(found.select("page").distinct(), "page", "left_semi").groupBy("page").agg(F.collect_list("key").alias("keys"))
    found = dealt_join(found, keys, "page", "left")
    ahead = F.coalesce(F.size(F.filter("keys", lambda k: k < F.col("key"))), F.lit(0))
    found = found.select("id", "key", "digest", (F.col("page") * size + ahead).alias("at"))
    # an insertion's own position: entries before it, less removals among them, and insertions before it
    order = found.select("key", "id", "digest", "at", F.lit(1).alias("born"), F.lit(0).alias("dead")).unionByName(
        removed.select("key", "id", "digest", F.lit(None).cast("long").alias("at"), F.lit(0).alias("born"), F.lit(1).alias("dead"))
    )
    placed = running(order, "key", sums=("born", "dead")).where("born = 1")
    placed = settled(placed.select("id", "key", "digest", "at", (F.col("at") + F.col("born_before") - F.col("dead_before")).cast("long").alias("position")))

    events = placed.select("at", F.lit(1).alias("shift")).union(removed.select("position", F.lit(-1))).groupBy("at").agg(F.sum("shift").alias("shift"))
    events = settled(events.withColumn("page", F.floor(F.col("at") / size)))
    by_page = events.groupBy("page").agg(F.sum("shift").alias("shift"), F.lit(True).alias("event"))
    by_page = by_page.join(touched.groupBy("page").agg(F.lit(True).alias("touch")), "page", "full_outer")
    starts = running(fences.join(by_page, "page", "left").select("page", F.coalesce("shift", F.lit(0)).alias("shift"), (F.col("event").isNotNull() | F.col("touch").isNotNull()).alias("dirty")), "page", sums=("shift",))
    starts = settled(starts.select("page", F.col("shift_before").alias("start"), (F.col("dirty") | (F.col("shift_before") != 0)).alias("dirty")))
    dirty = starts.where("dirty").select("page", "start")

    # within a page: the running sum of its events, at most two rows for each of its places
    body = old.join(dirty, "page").join(removed.select("id"), "id", "left_anti").join(touched.select("id", "new_digest"), "id", "left")
    body = body.select("page", "start", F.col("position").alias("at"), F.lit(0).alias("shift"), "id", "key", F.coalesce("new_digest", "digest").alias("digest"))
    nothing = [F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("id", "key", "digest")]
    steps = body.unionByName(events.join(dirty, "page").select("page", "start", "at", "shift", *nothing))
    moved = steps.withColumn("position", (F.col("at") + F.col("start") + F.expr("sum(shift) OVER (PARTITION BY page ORDER BY at RANGE UNBOUNDED PRECEDING)")).cast("long")).where("key IS NOT NULL")
    made = settled(moved.select("id", "key", "digest", "position").unionByName(placed.select("id", "key", "digest", "position")))
    kept = old.join(starts.where("NOT dirty").select("page"), "page", "left_semi").select("id", "key", "digest", "position")

    new = page_content(made, size).withColumn("state", F.lit("rewritten"))
    clean = previous.pages.where("n > 0").join(starts.where("NOT dirty").select("page"), "page", "left_semi").select("page", "n", "object", F.lit("kept").alias("state"))
    left = dirty.select("page").join(new.select("page"), "page", "left_anti").select("page", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("object"), F.lit("removed").alias("state"))
    return Revision(kept.unionByName(made), clean.unionByName(new).unionByName(left))


def compared(full: DataFrame, other: DataFrame) -> DataFrame:
    """One row on two manifests ``(key, object)``: ``compared``, ``mismatched``, ``missing`` (of the other), ``extra``."""
    l, r = full.select("key", F.col("object").alias("l")), other.select("key", F.col("object").alias("r"))
    both = l.join(r, "key", "full_outer")
    here, there = F.col("l").isNotNull(), F.col("r").isNotNull()
    counts = {"compared": here & there, "mismatched": here & there & (F.col("l") != F.col("r")), "missing": here & ~there, "extra": there & ~here}
    return both.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def consistency(mismatched: Column, missing: Column, extra: Column, generated: Column, now: Column, stale_hours: int = 6) -> Column:
    """ALERT where the incremental build differs from the full one in any file, WARN where the record is missing or older than
    ``stale_hours``, else OK."""
    stale = generated.isNull() | (now - F.expr(f"INTERVAL {stale_hours} HOURS") > generated)
    wrong = F.coalesce(mismatched, F.lit(0)) + F.coalesce(missing, F.lit(0)) + F.coalesce(extra, F.lit(0))
    return F.when(wrong > 0, "ALERT").when(stale, "WARN").otherwise("OK")
