"""The state operators over streams. Over the same rows in the same order they give what ``operators.state`` gives.

Rows of a key are put in order within a micro-batch; across micro-batches they must arrive in order. A
micro-batch's size is the source's setting (``maxFilesPerTrigger``, ``maxBytesPerTrigger``), and so is the
memory that a hot key takes. State per key is one short row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.state import run_outcome


def revision_stream(log: DataFrame) -> DataFrame:
    """``log(item long, turn long, content string)`` to ``item, turn, content_hash, revision``: the rows at
    which an item's content changes. A, B, A are three revisions, A, A is one; null content is empty."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else ("", 0)
        rows = pd.concat(batches).sort_values("turn", kind="stable")
        out = []
        for turn, content in zip(rows.turn, rows.content, strict=True):
            found = hashlib.sha256((content or "").encode()).hexdigest()
            if found != last:
                last, n = found, n + 1
                out.append((key[0], turn, found, n))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["item", "turn", "content_hash", "revision"])

    return log.select("item", "turn", "content").groupBy("item").applyInPandasWithState(
        run, "item long, turn long, content_hash string, revision long", "last string, n long", "append", GroupStateTimeout.NoTimeout
    )


def streak_stream(log: DataFrame, alarm: int = 3) -> DataFrame:
    """``log(source long, ts timestamp, id long, failed boolean)`` to ``source, id, streak, alarm``: failures on end
    up to each row, and whether they have reached ``alarm``. A success sets the streak back to 0; null counts as one."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values(["ts", "id"], kind="stable")
        out = []
        for i, failed in zip(rows.id, rows.failed, strict=True):
            streak = streak + 1 if failed else 0
            out.append((key[0], i, streak, streak >= alarm))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["source", "id", "streak", "alarm"])

    log = log.select("source", "ts", "id", F.coalesce("failed", F.lit(False)).alias("failed"))
    return log.groupBy("source").applyInPandasWithState(run, "source long, id long, streak long, alarm boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def outcome_stream(log: DataFrame, late: str = "1 day") -> DataFrame:
    """``log(ts, failed, partial)`` to ``day, n, outcome`` once the watermark has passed a day; rows later than ``late`` are dropped."""
    days = log.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    g = days.agg(F.count("*").alias("n"), F.count_if("failed").alias("f"), F.count_if("partial").alias("p"))
    return g.select(F.to_date("w.start").alias("day"), "n", run_outcome(F.col("n"), F.col("f"), F.col("p")).alias("outcome"))


def change_sink(path: str):
    """For ``writeStream.foreachBatch``: each micro-batch's rows in a folder of its own. A batch that is run again
    after a failure replaces its folder, so nothing is counted twice and nothing old is rewritten."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_rows(spark: SparkSession, path: str, keys: list[str], order: Column) -> DataFrame:
    """The upserted table that the folders of ``change_sink`` stand for: per key the row of the newest batch, within it
    the last by ``order``. Maxima are combined before the shuffle, so a key that changes often is no hot group."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("batch", order)).alias("r"))
    return latest.select(*keys, "r.*")
