"""Cursors and lives: table, stream and a replay in Python agree."""

import datetime
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import spread
from tidemark.plans import collection_plans as P
from tidemark.streaming import collection as C

DAY = datetime.date(2024, 1, 1)
PAGES = "source long, run long, page int, items array<struct<id: string, date: date, pinned: boolean>>, has_next boolean, ts timestamp"


def replay(pages, window, limit):
    """The rule told again, one source at a time."""
    by, out = defaultdict(lambda: defaultdict(dict)), []
    for s, run, page, items, more, *_ in pages:
        by[s][run].setdefault(page, (items, more))
    for s, runs in by.items():
        cursor, anchor, oldest, done, ordered = 1, None, None, False, True
        for run in sorted(runs):
            if done:
                out.append((s, run, None, cursor, anchor, oldest, ordered, 0, "complete"))
                continue
            first, expected = (max(1, cursor - 1), anchor) if anchor else (1, None)
            last, met, below, before, stop = first + limit + 2 * bool(anchor) - 1, expected is None, 0, None, None
            for page in sorted(p for p in runs[run] if first <= p <= last):
                items, more = runs[run][page]
                plain = [i for i in items if not i[2]]
                met |= expected in [i[0] for i in items]
                dates = [i[1] for i in plain]
                have = [x for x in dates if x]
                oldest = min([x for x in [oldest, *have] if x], default=None)
                if ordered and dates:
                    chain = ([before] if before else []) + dates
                    ordered = None not in dates and chain == sorted(chain, reverse=True)
                    before = dates[-1]
                if items and met:
                    cursor, anchor = page, (plain or items)[-1][0]
                old = bool(window and have) and max(have) < window
                below = below + 1 if old and ordered and None not in dates else 0
                boundary = below >= C.BOUNDARY or (old and not ordered)
                if boundary or not more or not items:
                    stop, done = ("date_boundary" if boundary else "end_of_board"), met
                elif page == last:
                    stop = "page_limit"
                if stop and not met:
                    stop, cursor, anchor = "anchor_missing", 1, None
                out.append((s, run, page, cursor, anchor, oldest, ordered, below, stop))
                if stop:
                    break
            if not stop:
                out.append((s, run, None, cursor, anchor, oldest, ordered, below, "time_budget"))
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))


def made(seed, sources=12):
    rng, out = np.random.default_rng(seed), []
    for s in range(sources):
        n, taken = 6, set()
        for run in range(1, 6):
            n += int(rng.integers(0, 6))
            taken |= set(rng.integers(0, n, int(rng.integers(0, 3))).tolist())
            items = [(f"{s}-{i}", None if i % 19 == 7 and s % 4 == 1 else DAY + datetime.timedelta(days=int(i // 2 - (5 if s % 5 == 2 and i == 8 else 0))), bool(i % 7 == 3)) for i in range(n)[::-1] if i not in taken]
            pages = [items[k : k + 2] for k in range(0, len(items), 2)]
            for p, part in enumerate(pages, 1):
                if run == 3 and p > 2 and s % 3 == 0:
                    break  # the run is cut short
                out.append((s, run, p, part, p < len(pages), datetime.datetime(2024, 2, run, 1, p)))
    return out


def test_cursors_match_a_replay(spark):
    pages = made(5)
    frame, stops = spark.createDataFrame(pages + pages[:9], PAGES), set()
    for window in (None, DAY + datetime.timedelta(days=3)):
        got = plain(C.progress(frame, window, 2).collect())
        assert got == plain(replay(pages, window, 2))
        stops |= {r[-1] for r in got}
    assert stops == {None, "page_limit", "anchor_missing", "time_budget", "complete", "date_boundary", "end_of_board"}
    assert C.progress(frame.limit(0)).count() == 0


def test_the_stream_of_cursors_gives_the_same(spark, tmp_path):
    pages, window = made(6, 8), DAY + datetime.timedelta(days=3)
    later = [(99, 1, 1, [("z", DAY, False)], False, datetime.datetime(2024, 3, 1)), (99, 2, 1, [("z", DAY, False)], False, datetime.datetime(2024, 3, 2))]
    for run in range(1, 6):
        spark.createDataFrame([p for p in pages if p[1] == run], PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for row in later:  # time goes on, so that timers of the last runs fire
        spark.createDataFrame([row], PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = C.progress_stream(stream, window, 2).writeStream.format("memory").queryName("cursors").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = plain(r for r in spark.table("cursors").collect() if r.source != 99)
    assert got == plain(replay(pages, window, 2))


def test_query_of_cursors_matches_a_replay(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r.source, r.run, r.page, [tuple(i) for i in r["items"]], r.has_next) for r in P.listing_pages(spark, sf).collect()]
    got = plain(P.resume_cursors(spark, sf).collect())
    want = plain((*r[:5], r[5] and str(r[5]), *r[6:]) for r in replay(pages, P.START, C.PAGES))
    assert got == want and len({r[-1] for r in got}) > 3


def test_lives_as_a_stream(spark, tmp_path):
    kind = "notice long, turn long, item long, seen boolean, hidden boolean"
    rng = np.random.default_rng(9)
    rows = [(n, t, n * 10 + i, bool(rng.random() < 0.35), None) for t in range(1, 12) for n in range(6) for i in range(1 + n % 3)]
    rows += [(2, 4, None, None, True), (2, 9, None, None, False), (5, 2, None, None, True)]
    frame = spark.createDataFrame(rows, kind)
    want = C.lives(frame.where("item IS NOT NULL").select("notice", "item", "turn", "seen"), frame.where("item IS NULL").select("notice", "turn", "hidden"))
    want = sorted(map(tuple, want.collect()))
    misses, hidden, status, told = defaultdict(int), set(), {}, []
    for t in range(1, 12):
        for n, turn, item, seen, hide in rows:
            if turn == t and item is not None:
                misses[n, item] = 0 if seen else misses[n, item] + 1
            elif turn == t:
                (hidden.add if hide else hidden.discard)(n)
        for n in range(6):
            now = "hidden" if n in hidden else "removed" if min(misses[k] for k in misses if k[0] == n) >= 3 else "visible"
            if now != status.get(n, "visible"):
                told.append((n, t, now))
            status[n] = now
    assert want == sorted(told) and {s for *_, s in told} == {"visible", "removed", "hidden"}
    for lo in range(1, 12, 3):
        frame.where(F.col("turn").between(lo, lo + 2)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = C.life_stream(stream).writeStream.format("memory").queryName("lives").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert sorted(map(tuple, spark.table("lives").collect())) == want


def test_looks_are_dealt_into_parts_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(spread, "SORTED", 100)
    looks = spark.range(300).selectExpr("id % 50 AS notice", "id AS item", "explode(sequence(1L, 4L)) AS turn", "false AS seen")
    got = C.lives(looks, spark.createDataFrame([], "notice long, turn long, hidden boolean"))
    assert re.search(r"hashpartitioning\(notice#\d+L?, item#\d+L?, 12\)", got._jdf.queryExecution().executedPlan().toString())
    assert sorted(tuple(r) for r in got.collect()) == [(k, 3, "removed") for k in range(50)]
