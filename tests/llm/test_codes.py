"""Product codes against plain Lloyd rounds in Python's own numbers, against SQL, and on odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes

VEC = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def lloyd(rows, rounds=2):
    """``rows (id, ints)`` to codes, errors and entries: every part against every entry, first of the nearest."""
    rows = sorted(rows)
    w = len(rows[0][1]) // 16
    cut = {i: [tuple(v[p * w : p * w + w]) for p in range(16)] for i, v in rows}
    books = [[cut[i][p] for i, _ in rows[:64]] for p in range(16)]

    def assign():
        out = {}
        for i, parts in cut.items():
            out[i] = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(parts)]
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in cut if got[i][p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    got = assign()
    return {i: bytes(k for _, k in g) for i, g in got.items()}, {i: sum(d for d, _ in g) for i, g in got.items()}, books


def sha(books):
    return hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def check(spark, rows, kind=VEC, **more):
    got = codes.compress(spark.createDataFrame(rows, kind), **more)
    out = {r.vec_id: r for r in got.rows.collect()}
    want, errors, books = lloyd([(r[0], [int(np.floor(256 * np.float64(c))) for c in r[1]]) for r in rows])
    assert {i: bytes(r.code) for i, r in out.items()} == want
    assert {i: r.error for i, r in out.items()} == {i: e if e < 2**63 else None for i, e in errors.items()}
    assert got.sha256() == sha(books)
    return got


def test_codes_match_plain_rounds(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 32)) / 4
    rows = [(int(i), [float(np.float32(c)) for c in base[rng.integers(30)] + rng.normal(size=32) / 30], int(i % 4)) for i in rng.permutation(900)]
    got = check(spark, rows)
    scans = got.scans()
    assert scans[0] == 900 * 16 and 0 < scans[1] < 0.5 * scans[0]  # bounds spare most scans


def test_ties_go_to_the_lower_index(spark):
    # few distinct whole numbers: equal entries, and parts midway between entries, in plenty
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) / 256 for c in rng.integers(-2, 3, 16)], 0) for i in range(400)]
    check(spark, rows)
    check(spark, [(i, [1.0] * 16, 0) for i in range(70)])


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=16) * 10.0 ** rng.integers(0, 11)], 0) for i in range(150)]
    check(spark, rows, "vec_id long, embedding array<double>, label int")


def test_odd_rows(spark):
    assert codes.compress(spark.createDataFrame([], VEC)).rows.count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [nan] * 16, 0), (4, [inf] * 16, 0), (5, [None] + [1.0] * 15, 0), (6, [1.0] * 15, 0), (7, [1e30] * 16, 0)]
    good = [(8, [0.5] * 16, None), (8, [0.5] * 16, None), (None, [1.0] * 32, 3), ((1 << 60) + 1, [0.25] * 16, 1), (None, [0.5] * 16, 1)]
    frame = spark.createDataFrame(rows + good, VEC).select("*", F.lit("a").alias("code"), F.lit(1).alias("x"), F.lit(2).alias("far"), F.lit(3).alias("c0"))
    got = codes.compress(frame)
    out = got.rows.collect()
    assert sorted((r.vec_id or 0, r.label or 0, r.code, r.x, r.far, r.c0) for r in out) == sorted((i or 0, l or 0, "a", 1, 2, 3) for i, _, l in good)
    assert all(r[got.error_column] == 0 for r in out) and got.code_column not in frame.columns
    assert {bytes(r[got.code_column]) for r in out if r.vec_id == 8} == {bytes(16)}


@pytest.mark.parametrize("table", [SF, "odd"])
def test_query_matches_its_sql(spark, tmp_path, table):
    if table == "odd":
        table = str(tmp_path)
        rng = np.random.default_rng(8)
        rows = [(i, [float(c) for c in rng.normal(size=64)], None if i % 3 == 0 else 1) for i in range(80)] + [(90, None, 1), (91, [float("nan")] * 64, 2), (92, [None] * 64, 2)]
        spark.createDataFrame(rows, VEC).write.parquet(f"{table}/embeddings.parquet")
    c = duckdb.connect()
    path = f"{table}/embeddings.parquet"
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path if table == SF else path + '/*.parquet'}'")
    want = c.sql(codes.OP12_SQL)
    got = codes.op12_vector_codes(spark, table)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
