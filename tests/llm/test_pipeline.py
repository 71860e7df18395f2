"""The pipeline's stages against plain Python on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from tidemark.llm import quality

from .test_operators import jaccard_links, reach

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, now = docs.columns, docs
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = corpus_pipeline.cut(stage(spark, now, SF), f"test-{k}")
        results.append(now.collect())
        assert k == 3 or now.columns == columns
    accepted, kept, mixed, packed = results
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert {r.doc_id for r in accepted} == {i for i, s in scores.items() if s >= quality.ACCEPT}
    rows = sorted((r.doc_id, r.text) for r in accepted)
    links = jaccard_links(rows)
    assert {r.doc_id for r in kept} == {i for k, (i, _) in enumerate(rows) if min(reach(links, k)) == k}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in kept} and max(copies.values()) <= 3
    placed = defaultdict(list)
    for r in packed:
        placed[r.sequence_id].append((r.offset, r.length))
    for items in placed.values():
        assert sum(n for _, n in items) == max(o + n for o, n in items) <= 2048
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_run_ends_with_placed_pieces(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_empty_and_odd_rows(spark):
    from pyspark.sql import functions as F

    from .test_operators import DOC, ODD

    clash = {c: F.lit(1) for c in ("row", "score", "quality_score", "mix_copies", "key", "node", "length", "part")}
    for rows in ([], ODD):
        docs = spark.createDataFrame(rows, DOC).withColumns(clash)
        now = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            assert k == 3 or now.columns == docs.columns
            if k < 3:
                now = corpus_pipeline.cut(now, f"odd-{k}")
        assert (now.count() > 0) == bool(rows)
