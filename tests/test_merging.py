"""Odd rows of merges, selections and listings."""

from pyspark.sql import functions as F

from tidemark.operators import merging as M
from tidemark.sources import listings as L

TREE = [("r", None), ("n", "r"), ("c", "n"), ("m", "r")]


def picked(spark, ids):
    nodes = spark.createDataFrame(TREE, "id string, parent string")
    picks = spark.createDataFrame([(1, i, x) for i, x in enumerate(ids)], "owner int, position int, id string")
    return sorted(r.id for r in M.normalized_selection(picks, nodes).collect())


def stepwise(ids):
    up, out = dict(TREE), []

    def above(x):
        found = set()
        while x := up.get(x):
            found.add(x)
        return found

    for x in ids:
        if x not in out:
            out = [y for y in out if y not in above(x) and x not in above(y)] + [x]
    return sorted(out)


def test_selection_is_that_of_single_steps(spark):
    for ids in ("rnc", "cnr", "cmr", "rcmr", "ncnm", "crc", "ccmn", "zrz", ""):
        assert picked(spark, list(ids)) == stepwise(list(ids))


def test_resolve_claims_each_row_once(spark):
    kind = "id int, a string, b string"
    wanted = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, "y"), (4, None, None)], kind)
    known = spark.createDataFrame([(10, "x", "y"), (11, None, "y"), (12, None, None)], kind)
    got = {r.id: (r.known_id, r.strategy) for r in M.resolve(wanted, known, ["a", "b"]).collect()}
    assert got == {1: (10, "a"), 2: (11, "b"), 3: (None, "new"), 4: (None, "new")}
    assert {r.strategy for r in M.resolve(wanted, known.limit(0), ["a", "b"]).collect()} == {"new"}


def test_merges_leave_other_links(spark):
    links = spark.createDataFrame([(1, 5, True, True, None), (2, 5, False, True, "old"), (3, 6, True, True, None), (4, None, True, True, None)], "id int, notice int, is_active boolean, is_primary boolean, reason string")
    pairs = spark.createDataFrame([(7, 5), (6, 6)], "keep int, absorb int")
    got = sorted(tuple(r) for r in M.merge_links(links, pairs, "m").collect())
    assert got == [(1, 7, True, False, "m"), (2, 5, False, True, "old"), (3, 6, True, True, None), (4, None, True, True, None)]
    assert M.merge_records(pairs, "m").count() == 1


def test_a_revert_gives_back_nulls(spark):
    rows = lambda x: spark.createDataFrame(x, "id int, value string")
    stored, wanted = rows([(1, None), (2, "a"), (3, "b")]), rows([(1, "x"), (2, None), (3, "b")])
    audit = M.changes(stored, wanted)
    assert sorted(r.id for r in audit.collect()) == [1, 2]
    assert sorted((r.id, r.value, r.reverted) for r in M.reverted(wanted, audit).collect()) == [(1, None, True), (2, "a", True), (3, "b", False)]


def test_pages_without_text_or_links(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, '<a href="?page=99999999999">x</a>'), (4, '<a href="/a">b.pdf (1.2.3KB)</a><a href="/c">b.pdf (2MB)</a>')], "id int, html string")
    got = {r.id: (r.more, [tuple(x) for x in r.files]) for r in rows.select("id", L.has_next(F.col("html"), F.lit(1)).alias("more"), L.attachments(F.col("html")).alias("files")).collect()}
    assert got == {1: (False, []), 2: (False, []), 3: (False, []), 4: (False, [("b.pdf", "pdf", None, "/a")])}


def shuffled(spark):
    """Records written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_a_selection_does_not_go_down_from_picks(spark):
    # 300 owners pick a root with 3,000 nodes below it: 900,000 pairs, were picks spread over what is below them
    nodes = spark.range(3000).selectExpr("concat('c', id) AS id", "'r' AS parent").union(spark.sql("SELECT 'r', CAST(NULL AS STRING)"))
    picks = spark.range(300).selectExpr("id AS owner", "1 AS position", "'r' AS id").union(spark.range(300).selectExpr("id", "CAST(id % 3 AS INT)", "concat('c', id)"))
    before = shuffled(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = M.normalized_selection(picks, nodes).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r.owner, r.id) for r in got) == sorted((k, x) for k in range(300) for x in {0: ["r"], 1: [f"c{k}", "r"], 2: [f"c{k}"]}[k % 3])
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 50_000
