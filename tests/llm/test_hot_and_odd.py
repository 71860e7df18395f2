"""Extreme vectors, archives of others, tasks that run again, and keys that a third of all rows share."""

import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, embeddings, lmscore, mixing, neardup, warc

from .test_operators import brute_losses, jaccard_links, reach


@pytest.mark.parametrize("odd", [1e-200, 1e200, 5e-324, 1.7e308])
def test_vectors_of_extreme_norms_link_like_others(spark, odd):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (4, [0.0, 1.0]), (5, [odd, 0.0])]
    got = {r.id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_vectors_without_ids_and_with_repeated_ones(spark):
    rows = [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (None, None)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.id, r.n_links, r.component_id) for r in got) == Counter([(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 1, 8), (8, 1, 8), (None, 0, None)])


def record(head, block):
    return b"WARC/1.0\r\n" + head + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def response(name, body, says, more=b""):
    return record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%s>" % name + more, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % says + body)


def test_archives_of_any_name_and_payloads_of_any_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HEAD_BYTES", 1 << 10)
    (tmp_path / "w" / "deep").mkdir(parents=True)
    long = b"no empty line in here " * 200
    parts = [
        record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>", b"x"), record(b"WARC-Type: continuation\r\nWARC-Segment-Origin-ID: <urn:uuid:0>\r\nWARC-Record-ID: <urn:uuid:0b>", b"y"),
        response(b"1", b"12345", 10), response(b"2", b"12345", 3), response(b"3", b"", 0), response(b"4", b"ok", 2, b"\r\nWARC-Payload-Digest: sha256:" + hashlib.sha256(b"ok").hexdigest().encode()),
        response(b"5", b"head ", 9, b"\r\nWARC-Segment-Number: 1"), record(b"WARC-Type: continuation\r\nWARC-Segment-Origin-ID: <urn:uuid:5>\r\nWARC-Record-ID: <urn:uuid:5b>", b"tail"),
        record(b"WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:6>", b"a\r\n\r\nb"), record(b"WARC-Type: conversion\r\nWARC-Record-ID: <urn:uuid:7>", b"text"),
        record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:8>", long), response(b"9", b"cut", 30, b"\r\nWARC-Truncated: time\r\nWARC-Payload-Digest: sha256:00"),
    ]
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[:6])))
    (tmp_path / "w" / "deep" / "b.warc").write_bytes(b"".join(parts[6:]) + b"\r\n")
    (tmp_path / "w" / "_skipped").write_bytes(b"no archive")
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    got = {r.record_id.removeprefix("urn:uuid:"): r for r in warc.chunk_table(spark, f"file://{tmp_path}/w").where("last").collect()}
    body = {"1": b"12345", "2": b"12345", "3": b"", "4": b"ok", "5": b"head tail", "6": b"a\r\n\r\nb", "7": b"text", "8": long, "9": b"cut"}
    assert {k: (r.payload_bytes, r.digest) for k, r in got.items()} == {k: (len(b), hashlib.sha256(b).hexdigest()) for k, b in body.items()}
    assert {k: r.declared_bytes for k, r in got.items()} == {"1": 10, "2": 3, "3": 0, "4": 2, "5": 9, "6": None, "7": None, "8": None, "9": 30}
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 9
    for name, bad in (("x", b"".join(parts)[:-30]), ("y", response(b"1", b"12", 2, b"\r\nWARC-Payload-Digest: sha256:00")), ("z", parts[7]), ("v", b"no archive at all")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(bad)
        with pytest.raises(Exception):
            warc.read_archives(spark, f"file://{tmp_path}/{name}").collect()


def test_scores_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD", 20)
    monkeypatch.setattr(lmscore, "BUCKET", 500)
    rng = np.random.default_rng(31)
    docs = [" ".join(f"w{x}" for x in rng.zipf(1.4, 40) % 300) for _ in range(120)]
    rows = list(enumerate(docs))
    found = []
    for order in (rows, rows[::-1]):  # one partition, as one task would get it on a second run
        frame = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: (r.target_loss, r.background_loss) for r in lmscore.cross_entropy_difference(frame, spark.createDataFrame([(docs[5],)], "text string")).collect()}
        found.append(got)
    assert found[0] == found[1]
    for i, (t, b) in enumerate(brute_losses(docs, [docs[5]])):
        assert abs(found[0][i][0] - t) < 1e-6 and abs(found[0][i][1] - b) < 1e-6


def test_a_text_of_a_third_of_all_rows(spark, monkeypatch):
    """Keys over the limit are dealt out; nothing is lost by it, and no task gets a third of the rows."""
    for module in (common, neardup):
        monkeypatch.setattr(module, "HUB", 8)
    rng = np.random.default_rng(41)
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    docs = [(i, " ".join(base)) for i in range(40)] + [(40, " ".join(base))] * 30
    docs += [(100 + i, " ".join(base[:-1] + [f"x{i}"])) for i in range(25)]
    docs += [(200 + i, " ".join(f"y{x}" for x in rng.integers(0, 5000, 30))) for i in range(30)]
    docs += [(300 + i, None) for i in range(20)] + [(None, "")] * 12
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("near_row", F.lit(1)).repartition(6)
    links = jaccard_links(docs)
    got = neardup.near_duplicates(frame).collect()
    want = Counter((d, len(links[i]), min((docs[j][0] for j in reach(links, i)), default=None) if d is not None else None) for i, (d, _) in enumerate(docs))
    assert Counter((r.id, r.n_links, r.component_id) for r in got) == want
    kept = neardup.deduplicated_documents(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, *range(200, 230), *range(300, 320), *[None] * 12])


def test_runs_are_added_up_by_class_and_group(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "a" if i % 3 else "b") for i in range(600)], "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.mix_copies) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "GROUP", 3)
    assert sorted((r.doc_id, r.mix_copies) for r in mixing.mix(docs).collect()) == want
    plan = mixing._before(spark.createDataFrame([("a", 1, r, 2) for r in range(10)] + [("a", 2, 4, 5), ("b", 0, 0, 1)], "key string, cls int, run int, n long"))
    assert {(r.key, r.cls, r.run): r.before for r in plan.collect()} == {("a", 1, r): 2 * r for r in range(10)} | {("a", 2, 4): 20, ("b", 0, 0): 0}
