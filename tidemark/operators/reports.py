"""Reports on collection: runs in a row, the watchdog's report, lines of status, the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R

# States of a run that is not over, results that count as failures, minutes without activity until a collection is stalled.
ACTIVE = ("queued", "in_progress", "waiting", "requested", "pending")
FAILED = ("failure", "timed_out", "startup_failure")
STALE_MINUTES = 20


def runs_in_short(runs: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """``runs(id, created, state, result)`` to one row: ``active``, those not over; ``recent``, created in the last ``minutes``; ``failures``, how many
    of those that are over have failed since the newest that has not; ``last_created``. Of runs created at one moment the greater id is the newer one; a run without a moment
    counts as active alone. No runs: zeros and null.

    Two passes of sums: no task sorts the runs.
    """
    active = F.coalesce(F.col("state").isin(*ACTIVE), F.lit(False))
    failed = F.coalesce(F.col("result").isin(*FAILED), F.lit(False))
    at, over = F.struct("created", "id"), F.col("created").isNotNull() & ~active
    broke = runs.agg(F.max(F.when(over & ~failed, at)).alias("broke"))  # one row
    since = over & failed & (F.col("broke").isNull() | (at > F.col("broke")))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    recent = F.coalesce(F.col("created") >= now - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))
    return runs.crossJoin(F.broadcast(broke)).agg(n(active).alias("active"), n(recent).alias("recent"), n(since).alias("failures"), F.max("created").alias("last_created"))


def watchdog_report(inventory: DataFrame, runs: DataFrame, activity: DataFrame, until: Column, now: Column, stale_minutes: int = STALE_MINUTES) -> DataFrame:
    """One row: whether a collection is to be started and the reason, with what it rests on.

    ``inventory(id, complete)``: the sources to collect; ``runs`` as of :func:`runs_in_short`; ``activity(started, finished)``: collections as the store
    knows them. ``idle_minutes``: since the last of their moments, null if there is none; ``stalled``: something remains and nothing has moved for
    ``stale_minutes`` or ever. No sources: no start, as that is a fault of the configuration.
    """
    todo = inventory.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.coalesce(F.col("complete"), F.lit(False)).cast("long")), F.lit(0)).alias("complete")).withColumn("remaining", F.col("total") - F.col("complete"))
    moved = activity.agg(F.greatest(F.max("started"), F.max("finished")).alias("last_activity"))
    seconds = lambda t: F.unix_micros(now) - F.unix_micros(t)
    got = todo.crossJoin(runs_in_short(runs, now)).crossJoin(moved)  # one row each
    idle = F.round(seconds(F.col("last_activity")) / 60e6, 1)
    reason = R.watchdog(F.col("total"), F.col("remaining"), until, F.col("active"), F.col("failures"), seconds(F.col("last_created")) / 60e6, F.col("recent"), now)
    got = got.withColumn("reason", reason).withColumn("idle_minutes", idle)
    stalled = (F.col("remaining") > 0) & F.coalesce(F.col("idle_minutes") >= stale_minutes, F.lit(True))
    return got.select((F.col("reason") == "dispatch").alias("dispatch"), "reason", "total", "complete", "remaining", "idle_minutes", stalled.alias("stalled"), "last_activity", "active", "recent", "failures", "last_created")


def status_lines(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Public ``sources(id, name, status, public)`` with their ``health(id, last_success, failures, backfill, complete, stop_reason)``, one row a source;
    a source without one has not been tried. Order of the page: name, then id."""
    got = sources.where("public").select("id", "name", "status").join(health, "id", "left")
    return got.select("id", "name", "status", "last_success", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.coalesce("backfill", F.lit("not_started")).alias("backfill"), F.coalesce("complete", F.lit(False)).alias("complete"), "stop_reason")


def publication_status(lines: DataFrame, collections: DataFrame) -> DataFrame:
    """One row over :func:`status_lines` and the newest of ``collections(id, started, finished, result)``: of those started at one moment the greatest id.
    No lines: zeros; no collections: nulls."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    totals = lines.agg(F.count("*").alias("sources"), count(F.col("status") == "active").alias("active"), count(F.col("failures") > 0).alias("failing"), count(F.col("complete")).alias("backfilled"), count(~F.col("complete")).alias("to_backfill"))
    newest = collections.where("started IS NOT NULL").agg(F.max_by(F.struct("started", "finished", "result"), F.struct("started", "id")).alias("r"))
    return totals.crossJoin(newest).select(*totals.columns, F.col("r.started").alias("last_started"), F.col("r.finished").alias("last_finished"), F.col("r.result").alias("last_result"))


def catalogue(vocabularies: DataFrame, places: DataFrame, features: dict[str, bool]) -> DataFrame:
    """One row: ``campuses`` (id and name of ``places``, by name then id), each of the ``vocabularies(vocabulary, place, code, label)`` as a list in the order
    of its places, as a map, and the ``features``. For vocabularies and campuses: tens of rows, which the page carries whole."""
    lists = vocabularies.groupBy("vocabulary").agg(F.array_sort(F.collect_list(F.struct("place", "code", "label"))).alias("l"))
    listed = F.transform("l", lambda x: F.struct(x["code"].alias("code"), x["label"].alias("label")))
    words = lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("vocabulary"), listed.alias("codes"))))).alias("vocabularies"))
    campuses = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "id"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("campuses"))
    flags = F.create_map(*(F.lit(x) for kv in features.items() for x in kv))
    return campuses.crossJoin(words).withColumn("features", flags)
