"""The streams against the batch operators, over files that arrive in several micro-batches."""

from pyspark.sql import functions as F

from tidemark.operators import state as S
from tidemark.streaming import state_streams as T


def in_files(spark, folder, rows, schema, n=3):
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collected(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/check-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_revisions(spark, tmp_path):
    schema = "item long, turn long, content string"
    rows = [(i, t, [None, "a", "a", "b", "a", ""][(i * t) % 6]) for t in range(9) for i in range(4)]
    got = collected(spark, T.revision_stream(in_files(spark, tmp_path / "in", rows, schema)), "revisions_seen", tmp_path)
    want = S.revisions(spark.createDataFrame(rows, schema), "item", ["turn"], F.col("content")).select("item", "turn", "content_hash", "revision")
    assert got == sorted(map(tuple, want.collect()))


def test_streaks(spark, tmp_path):
    schema = "source long, ts timestamp_ntz, id long, failed boolean"
    made = spark.range(40).selectExpr("id % 3 source", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, int(id)) ts", "id", "id % 7 <> 0 failed")
    rows = [tuple(r) for r in made.orderBy("id").collect()]
    got = collected(spark, T.streak_stream(in_files(spark, tmp_path / "in", rows, schema)), "streaks_seen", tmp_path)
    want = S.streaks(spark.createDataFrame(rows, schema), "source", ["ts", "id"], ~F.col("failed")).select("source", "id", "streak", F.expr("streak >= 3"))
    assert got == sorted(map(tuple, want.collect()))


def test_outcomes_come_once_their_day_is_over(spark, tmp_path):
    schema = "ts timestamp, failed boolean, partial boolean"
    made = spark.range(6).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) ts", "id = 1 failed", "id = 2 partial")
    rows = [tuple(r) for r in made.orderBy("id").collect()]
    got = collected(spark, T.outcome_stream(in_files(spark, tmp_path / "in", rows, schema, 6)), "outcomes_seen", tmp_path)
    assert [(str(d), n, o) for d, n, o in got][:3] == [("2024-01-01", 1, "success"), ("2024-01-02", 1, "failed"), ("2024-01-03", 1, "partial")]


def test_changes_are_upserted_once(spark, tmp_path):
    schema, path = "id long, seq long, status string", f"file://{tmp_path}/changes"
    sink = T.change_sink(path)
    first = spark.createDataFrame([(1, 1, "N"), (2, 2, "N"), (1, 3, "O")], schema)
    second = spark.createDataFrame([(2, 1, None), (3, 2, "N")], schema)
    for batch_id, batch in enumerate([first, second]):
        sink(batch, batch_id)
    sink(second, 1)
    got = T.current_rows(spark, path, ["id"], F.col("seq"))
    assert sorted(map(tuple, got.select("id", "seq", "status").collect())) == [(1, 3, "O"), (2, 1, None), (3, 2, "N")]
