"""Operators past the sizes at which they once stopped."""

from pyspark.sql import functions as F

from tidemark.operators import dedupe, hierarchy


def test_closure_is_not_held_to_the_row_limit_of_recursion(spark):
    nodes = spark.createDataFrame([(i, (i - 1) // 3 if i else None) for i in range(200)], "id long, parent long")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        got = sorted(map(tuple, hierarchy.closure(nodes).collect()))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    want = []
    for i in range(200):
        at, depth = i, 0
        while True:
            want.append((at, i, depth))
            if not at:
                break
            at, depth = (at - 1) // 3, depth + 1
    assert got == sorted(want)


def test_merge_targets_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r.node: r.target for r in dedupe.merge_targets(chain).collect()} == {i: 0 for i in range(31)}


def test_blocks_that_are_left_out_are_reported(spark):
    items = spark.createDataFrame([(i, f"s{i % 2}", "large" if i < 401 else "small") for i in range(801)], "id long, source string, print string")
    assert [tuple(r) for r in dedupe.oversized_blocks(items, F.array("print")).collect()] == [("large", 401)]
    assert dedupe.candidate_pairs(items, F.array("print")).count() == 200 * 200
