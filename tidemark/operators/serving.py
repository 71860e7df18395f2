"""What lists and cards show: listed items, categories, boards, cards, departments, pages of a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

from .hierarchy import drawn


def fresh(stored: Column, now: Column, window: str) -> Column:
    """True if ``stored`` is less than ``window`` before ``now`` or later than it; null: false."""
    return F.coalesce(now < stored + F.expr(f"INTERVAL {window}"), F.lit(False))


def listed(stored: DataFrame, listing: DataFrame, now: Column, window: str) -> DataFrame:
    """``stored(id, last_seen, status, streak, pinned)`` after ``listing(id, pinned)``, one row per id, was read without
    opening its items. What was listed is available, has no streak and the listing's pin, and is seen now unless its
    stored moment is fresh; unknown ids become new rows; the rest stays. ``changed`` marks rows that are to be written."""
    s, l = stored.withColumn("known", F.lit(True)), listing.select("id", F.coalesce("pinned", F.lit(False)).alias("pin"))
    both = s.join(l, "id", "full_outer")
    seen, old = F.col("pin").isNotNull(), F.struct("last_seen", "status", "streak", "pinned")
    new = F.struct(
        F.when(seen & ~fresh(F.col("last_seen"), now, window), now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, "available").otherwise(F.col("status")).alias("status"),
        F.when(seen, 0).otherwise(F.col("streak")).alias("streak"),
        F.coalesce("pin", "pinned").alias("pinned"),
    )
    return both.select("id", new.alias("new"), (F.col("known").isNull() | ~old.eqNullSafe(new)).alias("changed")).select("id", "new.*", "changed")


def category_rows(decisions: DataFrame) -> DataFrame:
    """``decisions(id, main, others)`` to the rows kept of them, ``(id, code, is_primary)``: each code once, the main one first of all."""
    others = F.array_except(F.coalesce("others", F.array().cast("array<string>")), F.array("main", F.lit(None)))
    marked = F.concat(F.array(F.struct(F.col("main").alias("code"), F.lit(True).alias("is_primary"))), F.transform(others, lambda c: F.struct(c.alias("code"), F.lit(False).alias("is_primary"))))
    return decisions.select("id", F.inline(marked))


def board_order(boards: DataFrame) -> DataFrame:
    """``boards(id, organization, live, position)`` with ``first``, the position of the organization's first board, in order
    of it; within an organization live boards come first, then by position. Positions are unique."""
    first = boards.groupBy("organization").agg(F.min("position").alias("first"))
    return boards.join(first, boards.organization.eqNullSafe(first.organization)).drop(first.organization).orderBy("first", F.desc("live"), "position")


def kept_rows(rows: Column) -> Column:
    """Of a card's ``array<struct<value, has_condition, condition>>`` those that may be shown: with a value and, where they
    have a place for a condition, with a condition."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.filter(rows, lambda r: r.isNotNull() & said(r["value"]) & (~r["has_condition"] | said(r["condition"])))


def _compact(c: Column) -> Column:
    return T.compact(T.search_text(c, compatible=False))


def matches_card(asked: Column, terms: Column) -> Column:
    """True if a term of a card, of two characters at least, occurs in what was asked; blanks and case don't count."""
    q = _compact(F.coalesce(asked, F.lit("")))
    return F.coalesce(F.exists(F.transform(terms, _compact), lambda t: (F.length(t) > 1) & F.contains(q, t)), F.lit(False))


def alias_words(fields: list[Column], rules: list[tuple[str, list[str]]]) -> Column:
    """The names that rules ``(match, names)`` add to a row: those of each rule whose match occurs in one of the fields."""
    folded = [_compact(F.coalesce(f, F.lit(""))) for f in fields]

    def names(match: str, words: list[str]) -> Column:
        m = _compact(F.lit(match))
        hit = F.exists(F.array(*folded), lambda f: (m != "") & F.contains(f, m))
        return F.when(hit, F.lit(" ".join(words)))

    return F.concat_ws(" ", *(names(*r) for r in rules)) if rules else F.lit("")


def department_organizations(wanted: DataFrame, organizations: DataFrame) -> DataFrame:
    """``wanted(name)``, each once, to the ``organizations(id, name, is_department, root)`` that it means: ``(name, root, id)``.

    Those of exactly that name, else departments whose names differ in their ending only (of two characters at least
    without it). Aliases share a ``root``, and all ids of it are given; a name that leads to several roots gives none."""
    one = [F.min("root").alias("root"), F.max("root").alias("last")]
    exact = wanted.join(organizations.select("name", "root"), "name").groupBy("name").agg(*one)
    keyed = wanted.join(exact, "name", "left_anti").withColumn("key", T.department_key(F.col("name"))).where(F.length("key") >= 2)
    keyed = keyed.join(organizations.where("is_department").select(T.department_key(F.col("name")).alias("key"), "root"), "key").groupBy("name").agg(*one)
    return exact.union(keyed).where("root = last").select("name", "root").join(organizations.select("root", "id"), "root")


def with_freshness(rows: DataFrame, freshness: DataFrame) -> DataFrame:
    """``rows`` with ``freshness(source, code, checked)`` of their column ``source``; a source without any is an error."""
    marked = freshness.select("source", F.col("code").alias("freshness"), "checked", F.lit(True).alias("found"))
    absent = F.raise_error(F.concat(F.lit("no freshness of source "), F.coalesce(F.col("source").cast("string"), F.lit("null"))))
    got = rows.join(marked, "source", "left")
    return got.withColumn("freshness", F.when(F.col("found"), F.col("freshness")).otherwise(absent)).drop("found")


def rolled_up(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``counts(id, n)`` added up by the node that each id is drawn as, aliases under what they stand for."""
    return drawn(nodes).join(counts, "id").groupBy(F.col("drawn_id").alias("id")).agg(F.sum("n").alias("n"))


def consistent_pages(pages: DataFrame) -> DataFrame:
    """``pages(feed, page, revision)``: a feed's pages if all have its first page's revision or that has none, else the
    first page only. Pages are numbered once."""
    said = F.coalesce("revision", F.lit(""))
    feeds = pages.groupBy("feed").agg(F.min("page").alias("first"), F.min_by(said, "page").alias("of"), F.min(said).alias("low"), F.max(said).alias("high"))
    return pages.join(feeds, "feed").where("page = first OR of = '' OR low = high").select(pages.columns)


def iso_stamp(at: Column) -> Column:
    """A moment in UTC (without a zone) as ISO text with Z, microseconds only where there are any."""
    fine = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fine == "000000", "").otherwise(F.concat(F.lit("."), fine)), F.lit("Z"))
