"""Reports on collection against a replay in Python."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import reports as R

NOW = datetime.datetime(2024, 1, 31, 12)
RUNS = "id long, created timestamp, state string, result string"


def at(minutes):
    return None if minutes is None else NOW - datetime.timedelta(minutes=minutes)


def replay(rows):
    active = sum(s in R.ACTIVE for _, _, s, _ in rows)
    dated = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]), reverse=True)
    failures = 0
    for _, _, state, result in dated:
        if state in R.ACTIVE:
            continue
        if result not in R.FAILED:
            break
        failures += 1
    return active, sum(r[1] >= at(60) for r in dated), failures, dated[0][1] if dated else None


def test_runs_in_short(spark):
    dice = random.Random(7)
    for size in (0, 1, 2, 9, 9, 40, 40):
        rows = [(i, at(dice.choice([None, 0, 30, 60, 61, 90])), dice.choice(["queued", "completed", None]), dice.choice(["failure", "timed_out", "failure", "success", "cancelled", None])) for i in range(size)]
        (got,) = R.runs_in_short(spark.createDataFrame(rows, RUNS), F.lit(NOW)).collect()
        assert tuple(got) == replay(rows)


def report(spark, runs=(), sources=((1, False),), activity=(), until=at(-600)):
    args = spark.createDataFrame(list(sources), "id long, complete boolean"), spark.createDataFrame(list(runs), RUNS), spark.createDataFrame(list(activity), "started timestamp, finished timestamp")
    (got,) = R.watchdog_report(*args, F.lit(until).cast("timestamp"), F.lit(NOW)).collect()
    return got


def test_watchdog_report(spark):
    assert report(spark, sources=[])["reason"] == "no targets"
    assert report(spark, sources=[(1, True)])["reason"] == "complete"
    assert report(spark, until=None)["reason"] == "no deadline"
    assert [report(spark, until=at(-m))["reason"] for m in (15, 16)] == ["past deadline", "dispatch"]
    assert [report(spark, runs=[(1, at(m), "completed", "success")])["reason"] for m in (9, 10)] == ["cooling down", "dispatch"]
    assert report(spark, runs=[(1, None, "queued", None)])["reason"] == "running"
    assert report(spark, runs=[(i, at(90 + i), "completed", "failure") for i in range(3)])["reason"] == "failing"
    assert report(spark, runs=[(i, at(20 + i), "completed", "success") for i in range(4)])["reason"] == "too many"
    never = report(spark, sources=[(1, None)])
    assert (never["idle_minutes"], never["stalled"], never["remaining"]) == (None, True, 1)
    assert [report(spark, activity=[(at(50), at(m)), (at(40), None)])["stalled"] for m in (19, 20, 45)] == [False, True, True]
    assert report(spark, activity=[(at(50), None)], sources=[(1, True)])["stalled"] is False


def test_lines_status_and_catalogue(spark):
    sources = spark.createDataFrame([(1, "b", "active", True), (2, "a", None, True), (3, "c", "active", False), (4, "d", "paused", None)], "id long, name string, status string, public boolean")
    health = spark.createDataFrame([(1, NOW, 2, None, True, "budget"), (3, NOW, 0, "complete", True, None)], "id long, last_success timestamp, failures long, backfill string, complete boolean, stop_reason string")
    lines = R.status_lines(sources, health)
    assert sorted((r.id, r.failures, r.backfill, r.complete) for r in lines.collect()) == [(1, 2, "not_started", True), (2, 0, "not_started", False)]
    runs = spark.createDataFrame([(1, at(5), at(4), "ok"), (2, at(5), None, "partial"), (3, None, at(1), "ok")], "id long, started timestamp, finished timestamp, result string")
    assert [tuple(r) for r in R.publication_status(lines, runs).collect()] == [(2, 1, 1, 1, 1, at(5), None, "partial")]
    assert [tuple(r) for r in R.publication_status(lines.limit(0), runs.limit(0)).collect()] == [(0, 0, 0, 0, 0, None, None, None)]
    words = spark.createDataFrame([("v", 2, "b", "B"), ("v", 1, "z", "Z"), ("u", 1, "a", None)], "vocabulary string, place int, code string, label string")
    (got,) = R.catalogue(words, spark.createDataFrame([(2, "S"), (1, "T")], "id long, name string"), {"x": True}).collect()
    assert [c.id for c in got.campuses] == [2, 1]
    assert {k: [tuple(c) for c in v] for k, v in got.vocabularies.items()} == {"v": [("z", "Z"), ("b", "B")], "u": [("a", None)]}
    assert got.features == {"x": True}
    (empty,) = R.catalogue(words.limit(0), spark.createDataFrame([], "id long, name string"), {"x": True}).collect()
    assert (empty.campuses, empty.vocabularies) == ([], {})
