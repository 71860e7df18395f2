"""Proof that a listing is in order, its application, and constraints of registries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import cyclic
from .spread import dealt_join, running, settled


@dataclass
class Audit:
    """``verdicts(source, pages, items, verified, reason, evidence)`` and ``findings(source, page, id, kind)``."""

    verdicts: DataFrame
    findings: DataFrame


def audited(pages: DataFrame, most: int = 1000) -> Audit:
    """Whether whole listings are in falling order: ``pages(source, page, items array<struct<id, date, pinned>>, has_next)``, pages from 1.

    Pages are looked at up to the last one (``has_next`` false), up to ``most``, and up to one whose items have all stood on one page before in the
    same order, which means that paging does not work (``repeated_page``). Of what is looked at and not pinned, findings are ``unknown_date``,
    ``date_inversion`` (later than the last known date before it) and ``overlapping_normal_item`` (the item stood before). A listing is verified if
    its end was seen, it has items, and nothing was found. ``evidence`` is a digest of the pages looked at, in whatever order they are read.

    Within a page everything is a function of its array; from page to page only the last known date is handed on, along (source, page)
    for all sources together, so no source's pages meet in one task. Empty pages are pages without items; null items too.
    """
    p = pages.withColumn("items", F.coalesce("items", F.array().cast(pages.schema["items"].dataType)))
    p = p.withColumn("normal", F.filter("items", lambda i: ~F.coalesce(i["pinned"], F.lit(False))))
    ids = F.transform("normal", lambda i: i["id"])
    p = settled(p.select("source", "page", "has_next", "normal", F.size("items").alias("n"), F.when(F.size("normal") > 0, F.xxhash64(ids)).alias("signature"), F.xxhash64("page", "items").alias("hash")))
    ends = p.where(~F.col("has_next")).groupBy("source").agg(F.min("page").alias("last"))
    again = p.where("signature IS NOT NULL").groupBy("source", "signature").agg(F.min_by(F.struct("page"), "page").alias("one"), F.collect_set("page").alias("all")).where(F.size("all") > 1)
    again = again.select("source", F.array_min(F.array_remove("all", F.col("one.page"))).alias("again")).groupBy("source").agg(F.min("again").alias("again"))
    bounds = settled(p.select("source").distinct().join(ends, "source", "left").join(again, "source", "left"))
    seen = dealt_join(p, bounds, "source").where((F.col("page") <= most) & (F.coalesce("last", F.col("page")) >= F.col("page")) & (F.coalesce("again", F.col("page") + 1) > F.col("page")))
    seen = settled(seen.drop("last", "again"))

    # the last known date before each page: a page asks at its own place and hands on after it
    known = F.filter(F.transform("normal", lambda i: i["date"]), lambda d: d.isNotNull())
    place = lambda after: F.struct("source", "page", F.lit(after).alias("after")).alias("key")
    handed = F.when(F.size(known) > 0, F.struct("source", F.element_at(known, -1).alias("date")))
    steps = seen.select(place(1), handed.alias("carry"), F.lit(None).cast(seen.schema["normal"].dataType).alias("normal")).unionByName(seen.select(place(0), F.lit(None).cast("struct<source: " + seen.schema["source"].dataType.simpleString() + ", date: date>").alias("carry"), "normal"))
    asked = running(steps, "key", last=("carry",)).where("key.after = 0")
    before = F.when(F.col("carry_last.source") == F.col("key.source"), F.col("carry_last.date"))
    # along a page: each item with the last known date before it
    start = F.struct(before.alias("date"), F.array().cast("array<struct<id: string, date: date, before: date>>").alias("out"))
    walked = F.aggregate("normal", start, lambda s, i: F.struct(F.coalesce(i["date"], s["date"]).alias("date"), F.concat(s["out"], F.array(F.struct(i["id"].cast("string").alias("id"), i["date"].alias("date"), s["date"].alias("before")))).alias("out")))
    items = asked.select(F.col("key.source").alias("source"), F.col("key.page").alias("page"), F.posexplode(walked["out"]).alias("at", "i"))
    items = settled(items.select("source", "page", "at", "i.id", F.when(F.col("i.date").isNull(), "unknown_date").when(F.col("i.before") < F.col("i.date"), "date_inversion").alias("kind")))
    first = items.groupBy("source", "id").agg(F.min(F.struct("page", "at")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    twice = items.join(first, ["source", "id"]).where(F.struct("page", "at") > F.col("first")).select("source", "page", "id", F.lit("overlapping_normal_item").alias("kind"))
    findings = settled(items.where("kind IS NOT NULL").select("source", "page", "id", "kind").unionByName(twice))

    counts = seen.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.size("normal").cast("long")).alias("stood"), F.min("has_next").alias("open"), F.sum(F.col("hash").cast("decimal(38,0)")).cast("string").alias("evidence"))
    distinct = items.groupBy("source").agg(F.count_distinct("id").alias("items"))
    v = bounds.select("source", "again").join(counts, "source", "left").join(distinct, "source", "left").join(findings.groupBy("source").agg(F.count("*").alias("found")), "source", "left")
    ended = ~F.coalesce("open", F.lit(True))
    verified = ended & (F.coalesce("items", F.lit(0)) > 0) & F.col("found").isNull()
    # the repeated page itself is not looked at, so an end seen before it stands
    reason = F.when(F.col("again").isNotNull() & ~ended, "repeated_page").when(verified, "full_listing_monotonic").when(ended, "order_not_proven").otherwise("page_cap")
    return Audit(v.select("source", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("items", F.lit(0)).alias("items"), verified.alias("verified"), reason.alias("reason"), "evidence"), findings)


def proofs_applied(proofs: DataFrame, configs: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """``proofs(source, verified, config_digest, evidence, valid_until)`` against ``configs(source, digest, version)`` and ``evidence(source, evidence)``,
    what an audit gives, to ``source, outcome, version``: ``applied`` (with the next version), or why not: ``not_verified``, ``expired``,
    ``evidence_differs``, ``config_changed`` (or there is none)."""
    j = proofs.join(configs.select("source", F.col("digest"), F.col("version").alias("old")), "source", "left").join(evidence.select("source", F.col("evidence").alias("own")), "source", "left")
    outcome = (
        F.when(~F.coalesce("verified", F.lit(False)), "not_verified").when(F.coalesce(F.col("valid_until") <= now, F.lit(True)), "expired")
        .when(~F.col("evidence").eqNullSafe(F.col("own")), "evidence_differs").when(~F.col("config_digest").eqNullSafe(F.col("digest")), "config_changed").otherwise("applied")
    )
    return j.select("source", outcome.alias("outcome"), F.when(outcome == "applied", F.col("old") + 1).otherwise(F.col("old")).alias("version"))


@dataclass
class Constraint:
    """Something that rows of a table must fulfil. ``kind``: ``unique`` (no other row has the columns' value), ``foreign`` (``target``, a table and column,
    has the value; null passes), ``acyclic`` (``columns`` are id and parent), or ``rule`` (``holds``, true or null)."""

    name: str
    kind: str
    table: str
    columns: tuple[str, ...]
    target: tuple[str, str] | None = None
    holds: Column | None = None


def violations(tables: dict[str, DataFrame], constraints: list[Constraint], keys: dict[str, str]) -> DataFrame:
    """``(constraint, key, detail)`` for each row that breaks a constraint; ``keys`` names each table's key column. Tables are written once and each
    constraint is one pass: a count, a join with the distinct targets, a filter, or the doubling of ``hierarchy.cyclic``. A foreign value that many
    rows share is dealt out."""
    held = {t: settled(df) for t, df in tables.items()}
    out = None
    for c in constraints:
        rows, key = held[c.table], F.col(keys[c.table]).cast("string").alias("key")
        value = F.concat_ws("/", *(F.col(x).cast("string") for x in c.columns))
        if c.kind == "unique":
            bad = rows.groupBy(*c.columns).agg(F.count("*").alias("n"), F.first(keys[c.table]).cast("string").alias("key")).where("n > 1").select("key", F.concat(value, F.lit(" x"), F.col("n").cast("string")).alias("detail"))
        elif c.kind == "foreign":
            target = held[c.target[0]].select(F.col(c.target[1]).cast("string").alias("_value")).where("_value IS NOT NULL").distinct().withColumn("_there", F.lit(True))
            asked = rows.where(F.col(c.columns[0]).isNotNull()).select(key, F.col(c.columns[0]).cast("string").alias("_value"))
            bad = dealt_join(asked, target, "_value", "left").where("_there IS NULL").select("key", F.col("_value").alias("detail"))
        elif c.kind == "acyclic":
            one = rows.groupBy(F.col(c.columns[0]).alias("id")).agg(F.min(c.columns[1]).alias("parent"))
            bad = cyclic(one).select(F.col("id").cast("string").alias("key"), F.lit("on a cycle").alias("detail"))
        else:
            bad = rows.where(~F.coalesce(c.holds, F.lit(True))).select(key, value.alias("detail"))
        bad = bad.select(F.lit(c.name).alias("constraint"), "key", "detail")
        out = bad if out is None else out.unionByName(bad)
    return out
