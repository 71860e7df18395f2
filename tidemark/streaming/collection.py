"""Where the collection of a source stands, and whether a notice lives: the same steps over a stream and over a table."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.spread import parts

#: pages of a run, pages on end below the window that end it, and how long a run's next page is waited for
PAGES, BOUNDARY, WAIT_MS = 3, 2, 3_600_000

#: what is known of a source between pages
CURSOR = "cursor int, anchor string, oldest date, reached boolean, ordered boolean"
RUN = "run long, start int, until int, expected string, found boolean, below int, previous date, stop string"
PROGRESS = "source long, run long, page int, cursor int, anchor string, oldest date, ordered boolean, below int, stop string"


def begin_run(c: dict, run: int, pages: int) -> dict:
    """A run starts a page before the cursor, where the anchor is expected, and may take two pages more to find it; without an anchor it starts
    at the first page. A source whose end has been reached has nothing to resume."""
    start = max(1, c["cursor"] - 1) if c["anchor"] else 1
    return {"run": run, "start": start, "until": start + pages + (2 if c["anchor"] else 0), "expected": c["anchor"], "found": not c["anchor"], "below": 0, "previous": None, "stop": "complete" if c["reached"] else None}


def read_page(c: dict, r: dict, page: int, items: list, has_next: bool, window: datetime.date | None) -> bool:
    """One page of a run, if the run asks for it; both states change in place.

    The cursor and the anchor (the page's last item that is not pinned, or else its last) move only once the run's anchor has been seen;
    where a run ends without it, the listing has shifted and the source starts over (``anchor_missing``). An unknown date or one later than the one
    before breaks the assumption of order for good. In order, ``BOUNDARY`` pages on end that lie wholly before the window end the run, out of
    order one page all of whose known dates do. Pinned items count for neither.
    """
    if r["stop"] or not r["start"] <= page < r["until"]:
        return False
    normal = [i for i in items if not i["pinned"]]
    dates = [i["date"] for i in normal]
    known = [d for d in dates if d is not None]
    r["found"] = r["found"] or any(i["id"] == r["expected"] for i in items)
    if known:
        c["oldest"] = min(known) if c["oldest"] is None else min(c["oldest"], *known)
    if c["ordered"] and dates:
        falling = None not in dates and all(a >= b for a, b in zip(dates, dates[1:])) and (r["previous"] is None or r["previous"] >= dates[0])
        c["ordered"] = falling
        r["previous"] = dates[-1]
    if items and r["found"]:
        c["cursor"], c["anchor"] = page, (normal or items)[-1]["id"]
    old = bool(window and known) and all(d < window for d in known)
    r["below"] = r["below"] + 1 if old and c["ordered"] and len(known) == len(dates) else 0
    boundary = r["below"] >= BOUNDARY or old and not c["ordered"]
    if not items or not has_next or boundary:
        r["stop"] = "date_boundary" if boundary else "end_of_board"
        c["reached"] = r["found"]
    elif page == r["until"] - 1:
        r["stop"] = "page_limit"
    if r["stop"] and not r["found"]:
        r["stop"] = "anchor_missing"
        c["cursor"], c["anchor"] = 1, None
    return True


def _fresh() -> dict:
    return {"cursor": 1, "anchor": None, "oldest": None, "reached": False, "ordered": True}


def _progress(source: int, page: int | None, c: dict, r: dict) -> Row:
    return Row(source=source, run=r["run"], page=page, cursor=c["cursor"], anchor=c["anchor"], oldest=c["oldest"], ordered=c["ordered"], below=r["below"], stop=r["stop"])


def _cut_short(source: int, c: dict, r: dict) -> Row:
    """A run whose next page never came: what it had is kept, and the next run resumes there."""
    r["stop"] = "time_budget"
    return _progress(source, None, c, r)


def progress(pages: DataFrame, window: datetime.date | None = None, limit: int = PAGES) -> DataFrame:
    """``pages(source long, run long, page int, items array<struct<id string, date date, pinned boolean>>, has_next boolean)`` to one row for each
    page that a run asks for, and one for each run whose pages end early (page null, ``time_budget``): where the source stands after it.

    Rows of a source are streamed through one task in order of run and page, holding one page at a time: each step needs the one before.
    A page that comes twice counts once; pages out of a run's range are passed over. No rows: no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in PROGRESS.split(", ")]
        source, c, r, seen, out = None, _fresh(), None, None, []

        def ended() -> None:
            if r and not r["stop"]:
                out.append(_cut_short(source, c, r))

        for batch in batches:
            for x in batch.itertuples(index=False):
                if x.source != source:
                    ended()
                    source, c, r = x.source, _fresh(), None
                if r is None or x.run != r["run"]:
                    ended()
                    r, seen = begin_run(c, x.run, limit), None
                    if r["stop"]:
                        out.append(_progress(source, None, c, r))
                if x.page != seen and read_page(c, r, x.page, list(x.items), x.has_next, window):
                    out.append(_progress(source, x.page, c, r))
                seen = x.page
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        ended()
        if out:
            yield pd.DataFrame(out, columns=names)

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.select("source", "run", "page", "items", "has_next").repartition(n, "source").sortWithinPartitions("source", "run", "page")
    return dealt.mapInPandas(run, PROGRESS)


class ProgressProcessor(StatefulProcessor):
    """``progress`` over a stream: the source's cursor and its run are two values, and a timer ends a run whose next page does not come."""

    def __init__(self, window: datetime.date | None, limit: int, wait_ms: int):
        self.window, self.limit, self.wait_ms = window, limit, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.cursor, self.run = handle.getValueState("cursor", CURSOR), handle.getValueState("run", f"{RUN}, seen int, timer long")

    def _load(self) -> tuple[dict, dict | None]:
        c = dict(zip((f.split(" ")[0] for f in CURSOR.split(", ")), self.cursor.get())) if self.cursor.exists() else _fresh()
        r = dict(zip([*(f.split(" ")[0] for f in RUN.split(", ")), "seen", "timer"], self.run.get())) if self.run.exists() else None
        return c, r

    def _store(self, c: dict, r: dict) -> None:
        self.cursor.update(tuple(c.values()))
        self.run.update(tuple(r.values()))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        c, r = self._load()
        for x in sorted(rows, key=lambda x: (x.run, x.page)):  # those of one micro-batch
            if r is None or x.run != r["run"]:
                if r and not r["stop"]:
                    yield _cut_short(key[0], c, r)
                timer = r["timer"] if r else None
                r = begin_run(c, x.run, self.limit) | {"seen": None, "timer": timer}
                if r["stop"]:
                    yield _progress(key[0], None, c, r)
            if x.page != r["seen"] and read_page(c, r, x.page, [i if isinstance(i, dict) else i.asDict() for i in x["items"]], x.has_next, self.window):
                yield _progress(key[0], x.page, c, r)
            r["seen"] = x.page
            if r["timer"]:
                self.handle.deleteTimer(r["timer"])
            r["timer"] = None if r["stop"] else int(x.ts.timestamp() * 1000) + self.wait_ms
            if r["timer"]:
                self.handle.registerTimer(r["timer"])
        if r is not None:
            self._store(c, r)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        c, r = self._load()
        if r and not r["stop"]:
            yield _cut_short(key[0], c, r)
            r["timer"] = None
            self._store(c, r)

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """Several state variables and timers need the state store that keeps them; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def progress_stream(pages: DataFrame, window: datetime.date | None = None, limit: int = PAGES, wait_ms: int = WAIT_MS, late: str = "1 hour") -> DataFrame:
    """``pages`` as for ``progress`` with ``ts``, when each was read. Across micro-batches a source's pages come in order."""
    stateful(pages.sparkSession)
    rows = pages.withWatermark("ts", late).select("source", "run", "page", "items", "has_next", "ts")
    return rows.groupBy("source").transformWithState(ProgressProcessor(window, limit, wait_ms), PROGRESS, "Append", "EventTime")


#: misses on end after which an item counts as removed
MISSES = 3
LIFE = "notice long, turn long, status string"


def lives(looks: DataFrame, hands: DataFrame) -> DataFrame:
    """``looks(notice, item, turn, seen)``, one row per active item of a notice and turn, and ``hands(notice, turn, hidden)``, what operators did, to
    ``(notice, turn, status)`` at each turn at which the status changes; it is visible before the first.

    An item is removed when it was missed MISSES times on end, and back when it is seen. A notice is ``removed`` while all of its items are, and
    ``hidden`` from the turn an operator hides it until one shows it again, whatever its items do. Rows of a notice are summed per turn before they
    meet, so items of one notice need not come together; looks are dealt into parts of a bounded size. A turn without looks changes nothing.
    """
    looks = looks.repartition(parts(looks), "notice", "item")
    last = Window.partitionBy("notice", "item").orderBy("turn").rowsBetween(1 - MISSES, 0)
    each = looks.select("notice", "turn", ((F.count("*").over(last) >= MISSES) & ~F.max("seen").over(last)).alias("gone"))
    turns = each.groupBy("notice", "turn").agg(F.min("gone").alias("gone"), F.lit(None).cast("boolean").alias("hidden"))
    both = turns.unionByName(hands.select("notice", "turn", F.lit(None).cast("boolean").alias("gone"), "hidden")).groupBy("notice", "turn").agg(F.max("gone").alias("gone"), F.max("hidden").alias("hidden"))
    upto = Window.partitionBy("notice").orderBy("turn")
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(False))
    status = F.when(carried("hidden"), "hidden").when(carried("gone"), "removed").otherwise("visible")
    found = both.select("notice", "turn", status.alias("status"))
    return found.withColumn("was", F.coalesce(F.lag("status").over(upto), F.lit("visible"))).where("status <> was").drop("was")


class LifeProcessor(StatefulProcessor):
    """``lives`` over a stream: a map from a notice's items to their misses on end, and the notice's own state."""

    def init(self, handle) -> None:
        self.misses = handle.getMapState("misses", "item long", "n int")
        self.notice = handle.getValueState("notice", "hidden boolean, status string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        hidden, status = self.notice.get() if self.notice.exists() else (False, "visible")
        misses = {k[0]: v[0] for k, v in self.misses.iterator()}
        turns: dict[int, list] = {}
        for x in rows:
            turns.setdefault(x.turn, []).append(x)
        for turn in sorted(turns):
            for x in turns[turn]:
                if x["item"] is None:
                    hidden = x.hidden
                else:
                    misses[x["item"]] = 0 if x.seen else misses.get(x["item"], 0) + 1
            now = "hidden" if hidden else "removed" if misses and min(misses.values()) >= MISSES else "visible"
            if now != status:
                status = now
                yield Row(notice=key[0], turn=turn, status=status)
        for item, n in misses.items():
            self.misses.updateValue((item,), (n,))
        self.notice.update((hidden, status))

    def close(self) -> None:
        pass


def life_stream(events: DataFrame) -> DataFrame:
    """``events(notice, turn, item, seen, hidden)``: looks (``item`` not null) and what operators did (``item`` null). All rows of a turn come in one
    micro-batch, turns in order."""
    stateful(events.sparkSession)
    return events.select("notice", "turn", "item", "seen", "hidden").groupBy("notice").transformWithState(LifeProcessor(), LIFE, "Append", "None")
