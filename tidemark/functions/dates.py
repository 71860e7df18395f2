"""Publication dates in Korean Standard Time; timestamps are UTC instants."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType, TimestampNTZType

ZONE = "Asia/Seoul"

# Date and time notations, and the words beside which a date is a deadline.
DATE_WITH_SIGNS = r"(\d{4})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})"
DATE_OF_DIGITS = r"(\d{4})(\d{2})(\d{2})(?!\d)"
CLOCK = r"(\d{1,2})\s*[:시]\s*(\d{2})"
DEADLINE_WORDS = r"마감|접수\s*기간|신청\s*기간|제출\s*기한|까지|기한|모집\s*기간|응모\s*기간"


def _valid(text: Column, pattern: str) -> tuple[Column, Column]:
    """The first match as a date (null if it is none between 2000 and 2100), and what follows it."""
    y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    day = F.when(y != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    return F.when(F.year(day).between(2000, 2100), day), F.regexp_extract(text, f"(?s){pattern}(.*)$", 4)


def parse_published(raw: Column) -> Column:
    """Struct ``date, at, precision``: a time is taken only where one is written after the date."""
    text = F.trim(raw)
    (a, tail_a), (b, tail_b) = _valid(text, DATE_WITH_SIGNS), _valid(text, DATE_OF_DIGITS)
    day, tail = F.coalesce(a, b), F.when(a.isNotNull(), tail_a).otherwise(tail_b)
    hour, minute = F.regexp_extract(tail, CLOCK, 1).try_cast("int"), F.regexp_extract(tail, CLOCK, 2).try_cast("int")
    timed = day.isNotNull() & hour.between(0, 23) & minute.between(0, 59)
    local = F.make_timestamp(F.year(day), F.month(day), F.day(day), F.when(timed, hour), F.when(timed, minute), F.lit(0).cast("decimal(8,6)"), F.lit(ZONE))
    precision = F.when(F.coalesce(timed, F.lit(False)), F.lit("datetime")).when(day.isNotNull(), F.lit("date")).otherwise(F.lit("unknown"))
    return F.struct(day.alias("date"), F.when(timed, local).alias("at"), precision.alias("precision"))


def local_date(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def day_start(day: Column) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def freshness(last: Column, now: Column) -> Column:
    age = now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double")
    return F.when(last.isNull(), "unknown").when(age <= 3 * 3600, "fresh").when(age <= 86400, "delayed").otherwise("stale")


def age_hours(then: Column, now: Column, digits: int = 1) -> Column:
    return F.round((now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 3600, digits)


def is_future(date: Column, at: Column, now: Column) -> Column:
    return F.coalesce(at > now, date > local_date(now), F.lit(False))


def display_published(date: Column, at: Column, precision: Column, pinned: Column, exempt: Column, first_visible: Column, now: Column, start: Column) -> Column:
    """What is shown as the publication date, and whether that differs from the source's own."""
    future = is_future(date, at, now) & first_visible.isNotNull()
    old = F.coalesce(pinned & exempt & (date < start), F.lit(False))
    shown = F.when(future, local_date(first_visible)).when(old, start).otherwise(date)
    shown_at = F.when(future, first_visible).when(old, F.lit(None).cast("timestamp")).otherwise(at)
    return F.struct(shown.alias("date"), shown_at.alias("at"), F.when(future, "datetime").when(old, "date").otherwise(F.coalesce(precision, F.lit("unknown"))).alias("precision"), (future | old).alias("adjusted"))


def _find(text: str):
    for pattern in (DATE_WITH_SIGNS, DATE_OF_DIGITS):
        if m := re.search(pattern, text):
            try:
                day = dt.date(*map(int, m.groups()))
            except ValueError:
                continue
            if 2000 <= day.year <= 2100:
                return day, text[m.end() :]
    return None


def _deadline(title: str | None, body: str | None, published) -> tuple | None:
    best = None
    lines = ([title] if title else []) + [x for x in (body or "").splitlines() if x.strip()]
    for line in lines[:200]:
        rest = line if re.search(DEADLINE_WORDS, line) else ""
        while rest and (got := _find(rest)):
            day, rest = got
            clock = re.match(CLOCK, rest.lstrip()[:8])
            at = None
            if clock and int(clock[1]) < 24 and int(clock[2]) < 60:
                at = dt.datetime(day.year, day.month, day.day, int(clock[1]), int(clock[2])) - dt.timedelta(hours=9)
            if published is not None and day < published - dt.timedelta(days=1):
                continue
            key = (day, at or dt.datetime.min)
            if best is None or key > best[0]:
                best = key, (day, at, "datetime" if at else "date", line.strip()[:200])
    return best and best[1]


@F.pandas_udf(StructType().add("date", DateType()).add("at", TimestampNTZType()).add("precision", StringType()).add("evidence", StringType()))
def guess_deadline_udf(title: pd.Series, body: pd.Series, published: pd.Series) -> pd.DataFrame:
    """The latest date in a line that speaks of a deadline, not before the day before publication."""
    found = [_deadline(t, b, None if pd.isna(p) else p) or (None,) * 4 for t, b, p in zip(title, body, published, strict=True)]
    return pd.DataFrame(found, columns=["date", "at", "precision", "evidence"])


def board_date(raw: Column, today: Column) -> Column:
    """A board's date as it can be parsed: a year of two digits is of this century, a clock alone is today's (``today``: a local date)."""
    clock = raw.rlike(r"^\d{1,2}:\d{2}$")
    return F.when(clock, F.concat(F.date_format(today, "yyyy-MM-dd"), F.lit(" "), raw)).otherwise(F.regexp_replace(raw, r"^(\d{2})([-./])(\d{1,2})[-./](\d{1,2})$", "20$1$2$3$2$4"))


def zoned(raw: Column) -> Column:
    """The instant of a deadline, null unless it is written with its offset from UTC."""
    return F.when(raw.rlike(r"([+-]\d{2}:\d{2}|Z)$"), F.try_to_timestamp(raw))


def relative_label(at: Column, now: Column) -> Column:
    """How long ago something was: just now, whole minutes, hours or days; no record where unknown."""
    m = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000))
    whole = lambda n, unit: F.concat(F.floor(m / n).cast("string"), F.lit(unit))
    return F.when(at.isNull(), "기록 없음").when(m < 1, "방금").when(m < 60, whole(1, "분 전")).when(m < 1440, whole(60, "시간 전")).otherwise(whole(1440, "일 전"))


def is_new(first_seen: Column, now: Column) -> Column:
    """Seen for the first time less than a day ago."""
    return F.unix_micros(now) - F.unix_micros(first_seen) < 86_400_000_000
