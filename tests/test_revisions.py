"""Incremental builds against full ones, the commit protocol, snapshots, connections and cycles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hierarchy, incremental, spread
from tidemark.sources import revisions


def pages_of(rows, size):
    rows = sorted(rows, key=lambda r: r[1])
    return {p: [(i, d) for i, _, d in rows[p * size : p * size + size]] for p in range(-(-len(rows) // size))}


@pytest.mark.parametrize("case", ["random", "one page", "all gone", "from nothing", "nothing", "at the end"])
def test_maintained_pages_equal_a_full_build(spark, case):
    rng, size = np.random.default_rng(7), 5
    kind = "id long, key long, digest string"
    old = [(i, i * 10, "a") for i in range(100)]
    if case == "random":
        new = {i: (i, k, d) for i, k, d in old if i % 17 != 3}
        for i in rng.integers(0, 100, 6):
            new[int(i)] = (int(i), int(rng.integers(0, 1000)) * 10 + 1 + int(i) % 8, "b")
        new |= {i: (i, int(rng.integers(0, 100)) * 10 + 9, "c") for i in (200,)} | {41: (41, 410, "touched")}
    elif case == "one page":  # many entries at one place, as many removed further on: what follows stays
        new = {i: r for i, *_ in old if not 40 <= i < 80 for r in [old[i]]} | {300 + i: (300 + i, 101 + i % 8 + i * 0, "x") if i < 8 else (300 + i, 120 - 1 - i, "x") for i in range(8)}
        new |= {400 + i: (400 + i, 200_000 + i, "end") for i in range(7)}
    elif case == "all gone":
        new = {}
    elif case == "from nothing":
        new, old = {i: (i, -i, "n") for i in range(23)}, []
    elif case == "nothing":
        new = {r[0]: r for r in old}
    else:
        new = {r[0]: r for r in old} | {500: (500, 5000, "z")}
    was = {i: (i, k, d) for i, k, d in old}
    changed = [r for i, r in new.items() if was.get(i) != r] + [r for i, r in new.items() if was.get(i) == r][:3]
    gone = [(i,) for i in was if i not in new] + [(999,), *([(changed[0][0],)] if changed else [])]
    before = incremental.built(spark.createDataFrame(old, kind), size)
    got = incremental.maintained(before, spark.createDataFrame(changed, kind), spark.createDataFrame(gone, "id long"), size)
    order = sorted(new.values(), key=lambda r: r[1])
    assert sorted((r.position, r.id, r.key, r.digest) for r in got.entries.collect()) == [(p, *r) for p, r in enumerate(order)]
    full = incremental.built(spark.createDataFrame(list(new.values()), kind), size)
    pages = {r.page: r for r in got.pages.collect()}
    assert {p: (r.n, r.object) for p, r in pages.items() if r.state != "removed"} == {r.page: (r.n, r.object) for r in full.pages.collect()}
    a, b = pages_of(old, size), pages_of(new.values(), size)
    assert {p for p, r in pages.items() if r.state == "removed"} == set(a) - set(b)
    assert all(a[p] == b[p] for p, r in pages.items() if r.state == "kept")
    if case in ("nothing", "at the end"):
        assert sum(r.state != "kept" for r in pages.values()) == (case == "at the end")


def test_sums_along_an_order_and_hot_joins(spark, monkeypatch):
    rows = [(i * 7 % 50, None if i % 3 else i) for i in range(50)]
    got = spread.running(spark.createDataFrame(rows, "k int, v long"), "k", sums=("v",), last=("v",))
    total, seen = 0, None
    for r in sorted(got.collect(), key=lambda r: r.k):
        seen = r.v if r.v is not None else seen
        assert (r.v_before, r.v_last) == (total, seen)
        total += r.v or 0
    monkeypatch.setattr(spread, "HUB", 3)
    rows = spark.createDataFrame([("hot", i) for i in range(40)] + [("a", 40), (None, 41), ("none", 42)], "k string, i int")
    values = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, v int")
    assert sorted((r.i, r.v) for r in spread.dealt_join(rows, values, "k").collect()) == [(i, 1) for i in range(40)] + [(40, 2)]
    assert {r.i: r.v for r in spread.dealt_join(rows, values, "k", "left").collect()} == {i: 1 for i in range(40)} | {40: 2, 41: None, 42: None}
    star = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(40, 60)] + [(5, 5)]
    got = {r.node: r.root for r in spread.connected(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(30)} | {i: 40 for i in range(40, 61)}
    assert spread.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 13, 100])
def test_cycles_of_any_length(spark, n):
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)]
    tail = [(f"t{i}", f"t{i + 1}") for i in range(20)] + [("t20", "r0"), ("x", None), ("y", "x"), ("z", "nowhere")]
    got = hierarchy.cyclic(spark.createDataFrame(ring + tail, "id string, parent string"))
    assert {r.id for r in got.collect()} == {i for i, _ in ring}
    assert hierarchy.cyclic(spark.createDataFrame(tail[-3:], "id string, parent string")).count() == 0


def test_a_reader_sees_whole_revisions_only(spark, tmp_path):
    base = f"file://{tmp_path}/p"
    rows = spark.createDataFrame([(i, i // 10) for i in range(35)], "id long, shard long")
    with pytest.raises(FileNotFoundError):
        revisions.served(spark, base, ["index"])
    revisions.publish(spark, base, "r1", "t1", {"index": rows})
    revisions.write_shards(base, "r2", "t2", {"index": rows.where("id < 12")})
    seen = lambda: (s := revisions.served(spark, base, ["index"])) and (s.revision, s.tables["index"].count(), s.problems.count())
    assert seen() == ("r1", 35, 0)
    revisions.write_manifest(base, "r2", "t2", {"index": rows.where("id < 12")})
    assert seen() == ("r1", 35, 0)
    revisions.point(spark, base, "r2", "t2")
    assert seen() == ("r2", 12, 0)
    with pytest.raises(Exception):  # a revision is written once
        revisions.write_shards(base, "r2", "t2", {"index": rows})
    spark.read.parquet(f"{base}/r/r2/index").where("shard = 1").select(F.col("id") + 1, "revision", "generated_at").write.mode("append").parquet(f"{base}/r/r2/index/shard=1")
    got = revisions.served(spark, base, ["index"])
    assert [(r.shard, r.problem) for r in got.problems.collect()] == [(1, "count")] and got.tables["index"].count() == 10


def test_folders_do_not_grow_with_shards(spark, tmp_path):
    base = f"file://{tmp_path}/p"
    rows = spark.range(2000).select("id", F.col("id").alias("shard"))
    revisions.publish(spark, base, "r1", "t1", {"index": rows})
    assert len(list((tmp_path / "p/r/r1/index").glob("shard=*"))) <= 256
    got = revisions.served(spark, base, ["index"])
    assert got.problems.count() == 0 and got.tables["index"].where("id = shard").count() == 2000
    # shards that are lost or changed cost no others of their folder
    held = spark.read.parquet(f"{base}/r/r1/index").where("id <> 9").withColumns({"id": F.when(F.col("id") == 7, -7).otherwise(F.col("id")), "revision": F.lit("r2")})
    held.write.partitionBy("shard").parquet(f"{base}/r/r2/index")
    revisions.write_manifest(base, "r2", "t1", {"index": rows})
    revisions.point(spark, base, "r2", "t1")
    got = revisions.served(spark, base, ["index"])
    assert sorted((r.shard, r.problem) for r in got.problems.collect()) == [(7, "content"), (9, "missing")] and got.tables["index"].count() == 1998
