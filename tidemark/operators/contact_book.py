"""A list of contacts put into the stored book: organizations, entries, channels, campuses and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids as I

from .spread import dealt_join, settled

# Kinds of channels and of organizations, names where a row gives none, evidence taken of a row, and lengths of stored texts.
CHANNELS = ("phone", "email", "fax", "website")
ORGANIZATIONS = ("university", "campus", "college", "department", "office", "council", "institute")
UNKNOWN, SERVICE, SOURCE = "미상 기관", "대표 안내", "공식 안내"
MOST_EVIDENCE, LONGEST_VALUE, LONGEST_SEARCH = 20, 300, 4000


def action_url(kind: Column, value: Column) -> Column:
    """Where a channel leads: none for faxes, for unknown kinds and without a value."""
    return F.when(value != "", F.when(kind == "phone", F.concat(F.lit("tel:"), value)).when(kind == "email", F.concat(F.lit("mailto:"), value)).when(kind == "website", value))


def _given(c: Column, default: str | None = None) -> Column:
    found = F.when(F.trim(c) != "", c)
    return found if default is None else F.coalesce(found, F.lit(default))


def organizations_by_name(organizations: DataFrame) -> DataFrame:
    """``organizations(id, name, aliases)`` to ``(name, organization)``, each name once: an organization's own name goes before aliases of others;
    of several of one name the smallest id is taken."""
    names = organizations.select("id", F.explode(F.concat(
        F.array(F.struct(F.col("name").alias("name"), F.lit(0).alias("rank"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("name"), F.lit(1).alias("rank"))),
    )).alias("n"))
    return names.where("n.name IS NOT NULL").groupBy(F.col("n.name").alias("name")).agg(F.min_by("id", F.struct("n.rank", "id")).alias("organization"))


def imported(rows: DataFrame, organizations: DataFrame, campuses: DataFrame, entries: DataFrame, channels: DataFrame, places: DataFrame, evidence: DataFrame, root: str) -> dict[str, DataFrame]:
    """The book after ``rows`` were put in, by table.

    ``rows(at, given, organization, type, service, location, hours, url, status, verified_at, note, channels array<struct<kind, display, value, extension>>,
    campuses array<string>, evidence array<struct<source, url, field, observed_at>>)``: ``at`` numbers them. Organizations are found by name or alias; unknown
    ones are founded once, below ``root``. A row is the entry of its given id, else of an id made of organization, service and campuses. Of rows with one id the first one
    founds the entry, with its organization and service, which later rows and imports leave alone; the last one gives the rest, the channels (their
    priority is the place in the list; other kinds are left out) and the campuses (unknown names are left out); the evidence of all of them, the first
    MOST_EVIDENCE of each, is added where it is not known yet. Entries that are not in the list stay as they are.

    Stored: ``organizations(id, name, type, aliases)``, ``campuses(id, name)``, ``entries(id, organization, service, location, hours, url, status,
    verified_at, note, search)``, ``channels(contact, priority, kind, display, value, extension)``, ``places(contact, campus)``, ``evidence(id, contact, source,
    url, field, observed_at)``. The result has the same tables, and ``counts(created, updated)``, rows. No rows: the book as it was.
    """
    named = rows.withColumn("name", _given(F.col("organization"), UNKNOWN)).drop("organization")
    known = settled(organizations_by_name(organizations))
    kind = F.when(F.col("type").isin(*ORGANIZATIONS), F.col("type")).otherwise("office")
    founded = named.groupBy("name").agg(F.min_by(kind, "at").alias("type")).join(known, "name", "left_anti")
    founded = settled(founded.select(I.typed_id("org", F.lit(root), F.col("name")).alias("id"), "name", "type", F.array().cast("array<string>").alias("aliases")))
    owners = known.union(founded.select("name", F.col("id").alias("organization")))
    own_id = I.typed_id("cnt", F.col("organization"), _given(F.col("service"), SERVICE), F.array_join(F.array_sort(F.coalesce("campuses", F.array().cast("array<string>"))), "\x1f"))
    # an organization may have very many rows
    put = settled(dealt_join(named, owners, "name").withColumn("contact", F.coalesce(_given(F.trim("given")), own_id)))

    fields = ["location", "hours", "url", "note"]
    last = F.struct("at", "name", "service", *fields, _given(F.col("status"), "verified").alias("status"), "verified_at", "channels", "campuses")
    first = F.struct("organization", _given(F.col("service"), SERVICE).alias("service"))
    each = settled(put.groupBy("contact").agg(F.min_by(first, "at").alias("first"), F.max_by(last, "at").alias("last"), F.count("*").alias("n")))
    stored = entries.select(F.col("id").alias("contact"), F.struct("organization", "service").alias("old"))
    both = each.join(stored, "contact", "left")
    kept = F.coalesce("old", "first")
    search = F.substring(F.concat_ws(" ", *(_given(F.col(f"last.{c}")) for c in ("name", "service", "location"))), 1, LONGEST_SEARCH)
    new = both.select(F.col("contact").alias("id"), kept["organization"].alias("organization"), kept["service"].alias("service"), *(F.col(f"last.{c}").alias(c) for c in ("location", "hours", "url", "status", "verified_at", "note")), search.alias("search"))
    others = lambda table, key: table.join(each.select(F.col("contact").alias(key)), key, "left_anti")

    listed = each.select("contact", F.posexplode("last.channels").alias("priority", "c"))
    listed = listed.withColumn("kind", _given(F.col("c.kind"), "phone")).where(F.col("kind").isin(*CHANNELS))
    short = lambda c: F.substring(c, 1, LONGEST_VALUE)
    listed = listed.select("contact", "priority", "kind", short(F.coalesce("c.display", F.lit(""))).alias("display"), short(F.when(F.col("c.value") != "", F.col("c.value"))).alias("value"), F.col("c.extension").alias("extension"))
    at = each.select("contact", F.explode(F.array_distinct("last.campuses")).alias("name")).join(F.broadcast(campuses.select(F.col("id").alias("campus"), "name")), "name").select("contact", "campus")  # the campuses

    said = put.select("contact", "at", F.posexplode(F.slice("evidence", 1, MOST_EVIDENCE)).alias("place", "e"))
    said = said.select("contact", "at", "place", _given(F.col("e.source"), SOURCE).alias("source"), F.coalesce("e.url", F.lit("")).alias("url"), _given(F.col("e.field"), "unknown").alias("field"), F.col("e.observed_at").alias("observed_at"))
    said = said.groupBy("contact", "url", "field").agg(F.min_by(F.struct("source", "observed_at"), F.struct("at", "place")).alias("o"))
    said = said.select(I.typed_id("obs", F.col("contact"), F.col("url"), F.col("field")).alias("id"), "contact", "o.source", "url", "field", "o.observed_at")
    added = F.coalesce(F.sum(F.col("old").isNull().cast("long")), F.lit(0))
    return {
        "organizations": organizations.select("id", "name", "type", "aliases").union(founded),
        "entries": others(entries, "id").select(new.columns).union(new),
        "channels": others(channels, "contact").select(listed.columns).union(listed),
        "places": others(places, "contact").select("contact", "campus").union(at),
        "evidence": evidence.select(said.columns).union(said.join(evidence.select("id"), "id", "left_anti")),
        "counts": both.agg(added.alias("created"), (F.coalesce(F.sum("n"), F.lit(0)) - added).alias("updated")),
    }


def reached(book: dict[str, DataFrame]) -> DataFrame:
    """One row per entry of a book as served: ``id, organization (name), service, location, status, channels`` (in order of priority, with where they lead),
    ``campuses`` (sorted) and the number of its ``evidence``."""
    c = book["channels"].groupBy(F.col("contact").alias("id")).agg(F.array_sort(F.collect_list(F.struct("priority", "kind", "display", "value", action_url(F.col("kind"), F.col("value")).alias("url"), "extension"))).alias("channels"))
    p = book["places"].groupBy(F.col("contact").alias("id")).agg(F.sort_array(F.collect_set("campus")).alias("campuses"))
    e = book["evidence"].groupBy(F.col("contact").alias("id")).agg(F.count("*").alias("evidence"))
    names = book["organizations"].groupBy(F.col("id").alias("organization")).agg(F.min("name").alias("name"))
    got = dealt_join(book["entries"], names, "organization", "left").drop("organization").join(c, "id", "left").join(p, "id", "left").join(e, "id", "left")
    return got.select("id", F.col("name").alias("organization"), "service", "location", "status", "note", "channels", "campuses", F.coalesce("evidence", F.lit(0).cast("long")).alias("evidence"))


def matching(served: DataFrame, text: Column | None = None, campuses: list[str] | None = None, organizations: list[str] | None = None) -> DataFrame:
    """Of :func:`reached` the entries of any of the ``campuses``, of one of the ``organizations`` (by name), in which ``text`` occurs, whatever its case, in the
    organization, its ``path`` (array; where the entries have one), the service, the location or the channels as displayed, joined by blanks. What is not given, or is empty, does not filter."""
    got = served
    if campuses:
        got = got.where(F.arrays_overlap(F.coalesce("campuses", F.array().cast("array<string>")), F.array(*map(F.lit, campuses))))
    if organizations:
        got = got.where(F.col("organization").isin(*organizations))
    if text is not None:
        path = [F.array_join("path", " ")] if "path" in served.columns else []
        words = F.lower(F.concat_ws(" ", "organization", *path, "service", "location", F.array_join(F.transform("channels", lambda x: x["display"]), " ")))
        got = got.where(F.contains(words, F.lower(F.coalesce(text, F.lit("")))))
    return got
