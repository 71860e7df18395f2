"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, embeddings, fingerprints, lmscore, mixing, neardup, packing, quality, sharding, warc
from tidemark.llm.common import components, linked_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ODD = [
    (1, None, "en", "b", 0),
    (2, "", "en", "b", 0),
    (3, " \t\n", "en", None, 0),
    (4, "one", "en", "a", 0),
    (5, "one two three four five six", "en", "a", 0),
    (5, "one two three four five six", "en", "a", 0),
    (6, "one two three four five six", "en", "c", 0),
    (7, LONG, "en", "c", 0),
    (8, LONG + " tail", "en", "c", 0),
    (None, "no id at all but some words here", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 3)
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 3), (5, 10), (6, 6)], "id long, copy_left long")
    assert Counter(r.id for r in common.copies(rows, "copy_left").collect()) == {1: 1, 4: 3, 5: 10, 6: 6}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    star = [(0, i) for i in range(1, 2000)] + [(1999, 2000), (2000, 3000)]
    assert {(r.node, r.root) for r in components(spark.createDataFrame(star, "a long, b long")).collect()} == {(i, 0) for i in [*range(2001), 3000]}
    path = [(i, i + 1) for i in range(40)]
    assert {r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_work_out_each_step_once(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc, status = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in zip(keep, ("20", "false"), strict=True):
            spark.conf.set(k, v)
        sc.setJobGroup("components-once", "")
        got = components(spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in keep.items():
            spark.conf.set(k, v)
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("components-once") for s in status.getJobInfo(j).stageIds]
    # 183 tasks, and 376 where steps were worked out wherever they were used
    assert sum(s.numCompletedTasks for s in stages if s) < 300
    assert got.count() == 60


# 1. n-gram Jaccard join


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_links(docs):
    sets = [shingle_set(t) for _, t in docs]
    links = defaultdict(set)
    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[i].add(j)
            links[j].add(i)
    return links


def reach(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return seen


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = f"x{rng.integers(0, 9)}"
            docs.append((len(docs), " ".join(w)))
    docs.append((len(docs), docs[0][1]))
    links = jaccard_links(docs)
    got = {r.id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(map(len, links.values())) > 40
    for i, _ in docs:
        assert got[i].n_links == len(links[i])
        assert got[i].component_id == min(reach(links, i))


def test_near_duplicates_of_a_large_group_over_blocks(spark, monkeypatch):
    """More classes than a block holds, linked and counted without a list of pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    base = [f"w{x}" for x in range(200)]
    docs = [(i, " ".join(base[: i % 190] + [f"y{i}"] + base[i % 190 + 1 :])) for i in range(90)]
    links = jaccard_links(docs)
    got = {r.id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: got[i].n_links for i, _ in docs} == {i: len(links[i]) for i, _ in docs}
    assert {r.component_id for r in got.values()} == {0}


def test_near_duplicates_on_odd_rows(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    assert [by[i][0].n_links for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 0, 2, 2]
    assert len(by[5]) == 2 and by[6][0].component_id == 5 and by[8][0].component_id == 7
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.deduplicated_documents(odd.withColumn("row", F.lit(1)).withColumn("near_row", F.lit(2)))
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect() if r.doc_id) == [(True, i) for i in (1, 2, 3, 4, 5, 7)]
    assert kept.columns == odd.columns + ["row", "near_row"] and kept.count() == 7
    assert neardup.deduplicated_documents(none).count() == 0


def test_components_that_share_an_id_or_have_none_stay_apart(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcd")
    docs = [(None, a), (None, a + " x"), (None, b), (None, b + " x"), (5, c), (6, c + " x"), (5, d), (7, d + " x")]
    kept = neardup.deduplicated_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(kept) == 4 and {r.text[0] for r in kept} == set("abcd")
    assert sorted(r.doc_id for r in kept if r.doc_id) == [5, 5]


def test_bayesian_bound_keeps_similar_pairs():
    """A pair at the threshold passes all rounds but with a probability of the tolerance's order."""
    rng = np.random.default_rng(3)
    least = neardup.least_matches()
    m = np.cumsum(rng.random((20_000, neardup.BANDS * neardup.ROWS)) < neardup.SIMILAR, axis=1)
    lost = np.zeros(len(m), dtype=bool)
    for n, k in least.items():
        lost |= m[:, n - 1] < k
    assert lost.mean() < 1e-3
    m = np.cumsum(rng.random((20_000, 240)) < 0.3, axis=1)
    assert (m[:, 239] < least[240]).mean() > 0.999


# 2. mixing


def test_mixing_targets_and_copies(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", ["a", "b", "c", "d"][min(3, i // (40 if i < 80 else 25))], 0) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(docs, DOC)).collect()
    size = Counter()
    for d in docs:
        size[d[3]] += len(d[1].split())
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    target, free, total = {}, dict(weights), sum(size.values())
    while free:  # water filling
        rest = total - sum(target.values())
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 3 * size[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            del free[s]
    taken = Counter()
    for r in got:
        assert abs(r.mix_target - target[r.source]) < 1e-6 * total
        assert 0 <= r.mix_copies <= 3
        taken[r.source] += r.mix_copies * r.mix_size
    assert all(abs(taken[s] - target[s]) <= 130 for s in size)
    assert mixing.mix(none).count() == 0
    rows = mixing.mix(odd.withColumn("mix_key", F.lit(1)).withColumn("Mix_Run", F.lit(1)))
    assert rows.count() == len(ODD) and rows.columns[:7] == odd.columns + ["mix_key", "Mix_Run"]
    clash = {f"mix_{n}": F.lit(7) for n in ("size", "copies", "source_size", "target", "rate", "shift", "class", "before")}
    rows = mixing.mix(odd.withColumns(clash), names=("a", "b", "c", "d"))
    assert rows.columns == odd.columns + list(clash) + ["a", "b", "c", "d"] and {r.mix_copies for r in rows.collect()} == {7}
    assert mixing.mix(odd.withColumns(clash)).columns[-1] == "mix_copies_"
    assert mixing.mixed_documents(odd.withColumns(clash)).columns == odd.columns + list(clash)
    monkeypatch.setattr(mixing, "RUN_ROWS", 1)  # finer parts of runs change nothing
    fine = mixing.mix(spark.createDataFrame(docs, DOC)).collect()
    assert {(r.doc_id, r.mix_copies) for r in fine} == {(r.doc_id, r.mix_copies) for r in got}
    a, b = (sorted(map(str, mixing.mixed_documents(odd.repartition(n)).collect())) for n in (1, 7))
    assert a == b


# 3. embeddings


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(20):
        c = rng.standard_normal(16)
        rows += [(c + rng.standard_normal(16) * s).astype(np.float32).tolist() for s in rng.choice([0.05, 0.2, 0.35], 12)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01]]
    got = {r.id: r for r in embeddings.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect()}
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = defaultdict(set)
    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if good(a) and good(b) and len(a) == len(b) and np.dot(a, b) / sqrt(np.dot(a, a)) / sqrt(np.dot(b, b)) >= 0.9:
            links[i].add(j)
            links[j].add(i)
    assert sum(map(len, links.values())) > 100
    for i in range(len(rows)):
        assert got[i].n_links == len(links[i]), i
        assert got[i].component_id == min(reach(links, i))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_doubles_are_compared_as_doubles(spark):
    x = 0.9 - 1e-10
    rows = [(1, [1.0, 0.0]), (2, [x, float(np.sqrt(1 - x * x))]), (3, [0.9 + 1e-10, -float(np.sqrt(1 - (0.9 + 1e-10) ** 2))])]
    got = {r.id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tile", F.lit(1))).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_cover_tree_is_nested_and_covers():
    x = np.random.default_rng(0).standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = embeddings.CoverTree.load(embeddings.CoverTree(x).dump())
    for k in range(len(t.lo)):
        own = t.points[t.lo[k] : t.hi[k]]
        assert np.linalg.norm(own - t.points[t.centre[k]], axis=1).max() <= t.reach[k] + 1e-12
        if t.last[k]:
            assert t.centre[t.first[k]] == t.centre[k]
            assert (t.hi[t.first[k] : t.last[k]] - t.lo[t.first[k] : t.last[k]]).sum() == t.hi[k] - t.lo[k]


# 4. chat


def test_chat_round_trip(spark):
    tricky = [r"\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\\\<", "", None, "a: b\n\n### assistant: ", "é\U0001f600"]
    rows = [(c, t, "assistant" if t % 2 else ["user", None, "sys: <x>"][c % 3], tricky[(c + t) % len(tricky)]) for c in range(9) for t in range(c)]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (None, None, "user", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(frame.withColumn("esc", F.lit(1)))
    got = {r.conv_id: r for r in chat.digest(chat.expand(turns)).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns_ in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns_).encode()).hexdigest()
        loss = "".join(x for r, x in turns_ if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns_), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in chat.examples(turns).collect():
        upto = [k for k, (r, _) in enumerate(by[e.conv_id]) if r == "assistant"][e.example]
        assert chat.unescape(e.reply) == by[e.conv_id][upto][1]
        segments = re.findall(r"### (?:[^\\:]|\\.)*: (?:[^\\#<]|\\.)*</turn>\n", e.context, re.DOTALL)
        assert [chat.read_turn(s)[1] for s in segments] == [x for _, x in by[e.conv_id][:upto]]
    assert chat.digest(chat.expand(chat.format_turns(frame.limit(0)))).count() == 0


@pytest.mark.parametrize("held", [1, chat.HELD])
def test_chat_examples_spell_out_their_contexts(spark, monkeypatch, held):
    monkeypatch.setattr(chat, "PORTION", 17)
    monkeypatch.setattr(chat, "HELD", held)
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}:{t} \r\né#\U0001f600 " * t) for c in (1, 2) for t in range(6 + c)]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got, texts = defaultdict(list), defaultdict(str)
    expanded = chat.expand(turns).cache()
    for r in expanded.where("example IS NOT NULL").orderBy("conv_id", "example", "part").collect():
        got[r.conv_id, r.example].append(r)
    whole = {}
    for r in turns.orderBy("conv_id", "pos").collect():
        if r.example is not None:
            whole[r.conv_id, r.example] = ((texts[r.conv_id] + r.segment)[: r.loss_start], (texts[r.conv_id] + r.segment)[r.loss_start : r.loss_end])
        texts[r.conv_id] += r.segment
    assert set(got) == set(whole) and len(got) == 7
    for k, parts in got.items():
        assert [r.target for r in parts] == [False] * (len(parts) - 1) + [True] and all(len(r.segment) <= 17 for r in parts[:-1])
        assert ("".join(r.segment for r in parts[:-1]), parts[-1].segment) == whole[k]
    shorter = expanded.where("NOT (conv_id = 2 AND example = 1 AND part = 0)")
    with pytest.raises(Exception, match="context is not the text"):
        chat.digest(shorter).collect()


# 5. WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 3000
    html = [big, "same " * 40, None, "", "tiny", "tiny", "same " * 40, big + "x", "same " * 40, "\r\n" * 60]
    rows = [(10 - i, f"http://h/{i}\r\nX: y" if i % 3 else None, h) for i, h in enumerate(html)] + [(10, "http://h/0", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z"))
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path, segment=700)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    low = {}
    for i, _, h in rows:
        low[h or ""] = min(i, low.get(h or "", i))
    text = {i: h or "" for i, _, h in rows}
    for r in got:
        body = text[r.page_id].encode()
        first = low[text[r.page_id]] if len(body) >= 100 else r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    assert max(len(bytes(r.data)) for r in warc.chunk_table(spark, path).collect()) <= warc.BLOCK_BYTES
    chunks = [r for r in warc.chunk_table(spark, path).collect() if r.page_id == 3 and r.record_type == "response"]
    assert b"".join(bytes(r.data) for r in sorted(chunks, key=lambda r: r.chunk)) == (big + "x").encode()
    empty = f"file://{tmp_path}/none"
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_archives_of_others(spark, tmp_path):
    import base64
    import gzip

    body = b"<p>hello</p>" * 20
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest())
    record = lambda head, block: b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    parts = [
        record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\n", b"software: x\r\n\r\n"),
        record(b"WARC-Type: request\r\nWARC-Record-ID: <urn:uuid:2>\r\n", b"GET / HTTP/1.1\r\n\r\n"),
        record(b"warc-type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:" + sha1 + b"\r\n", http + body),
        record(b"WARC-Type: metadata\r\nWARC-Record-ID:<urn:uuid:4>\r\n", b""),
        record(b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Refers-To: <urn:uuid:3>\r\n", http),
    ]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # one member per record
    got = {r.record_id: r for r in warc.chunk_table(spark, f"file://{tmp_path}/x").collect()}
    assert set(got) == {"urn:uuid:3", "urn:uuid:5"}
    assert (bytes(got["urn:uuid:3"].data), got["urn:uuid:3"].digest, got["urn:uuid:3"].page_id) == (body, hashlib.sha256(body).hexdigest(), None)
    assert got["urn:uuid:5"].record_type == "revisit"


# 6. sharding


def test_shards_fit_and_only_full_ones_split(spark):
    rng = np.random.default_rng(6)
    rows = [(str(i), int(b)) for i, b in enumerate(rng.integers(1, 400, 2000))] + [("hot", 50)] * 900 + [(None, None), ("huge", 99_999), ("huge", 99_999)]
    got, shards = sharding.assign_shards(spark.createDataFrame(rows, "key string, bytes long"), 5_000)
    got, shards = got.collect(), {r.shard: r for r in shards.collect()}
    assert Counter((r.key, r.bytes) for r in got) == Counter((k, b or 0) for k, b in rows)
    total = Counter()
    for r in got:
        total[r.shard] += r.bytes
    assert {s: r.shard_bytes for s, r in shards.items()} == dict(total)
    small = {s: r for s, r in shards.items() if r.depth >= 0}
    assert all(r.shard_bytes <= 5_000 for r in small.values()) and len(shards) - len(small) == 2
    for s, r in small.items():  # the parent of each shard was over the limit
        parent = sum(x.bytes for x in got if x.bytes <= 5_000 and x.hash >> (60 - r.depth + 1) == r.prefix >> 1)
        assert parent > 5_000
    wide = spark.createDataFrame([(k, b, f"text {i}", 7) for i, (k, b) in enumerate(rows)], "key string, bytes long, text string, shard int").repartition(5)
    carried, _ = sharding.assign_shards(wide, 5_000)
    assert carried.columns == ["key", "bytes", "text", "copy", "hash", "shard"]
    carried = carried.collect()
    assert len({r.text for r in carried}) == len(rows) and Counter((r.key, r.copy, r.shard) for r in carried) == Counter((r.key, r.copy, r.shard) for r in got)
    empty, none = sharding.assign_shards(spark.createDataFrame([], "key string, bytes long"))
    assert empty.count() == 0 and none.count() == 0


def test_shards_with_rounds_and_oracle(spark):
    import duckdb

    frame = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("key"), F.octet_length("text").alias("bytes"))
    for spare in (0, 5):
        got, _ = sharding.assign_shards(frame, 20_000, spare)
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        want = {(r[0], r[4]) for r in con.execute(sharding.op6_sql(20_000)).fetchall()}
        assert {(int(r.key), r.shard) for r in got.collect()} == want


# 7. quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert sum(r.predicted for r in rows if r.quality == 1) / sum(r.quality for r in rows) >= 0.99
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_votes_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.limit(60).collect()
    got = {r.doc_id: r.score for r in quality.scored(docs.withColumn("score", F.lit(5)), model).collect()}
    for r in rows:
        c = quality._weighted(quality.term_counts(r.text)[None, :], model.rarity)[0]
        z = [sum(x * y for x, y in zip(c - model.mean, model.basis[:, k])) for k in range(model.basis.shape[1])]
        near = []
        for v, label in zip(model.vectors, model.labels):
            near.append((sum(x * y for x, y in zip(z, v)) / max(sqrt(sum(x * x for x in z)), 1e-12), label))
        near = sorted(near, key=lambda x: -x[0])[: quality.NEIGHBOURS]
        weights = [max(x, 0.0) ** quality.POWER + 1e-9 for x, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)
        assert abs(got[r.doc_id] - want) < 1e-6


def test_words_count_beside_shapes():
    """Texts of one shape whose words differ are apart."""
    good = [f"the river{i % 7} runs past an old house{i % 5}" for i in range(40)]
    bad = [f"zqx ploop{i % 7} vrnt wexx mu gla smurf{i % 5}" for i in range(40)]
    assert quality.term_counts("old house").sum() == quality.term_counts("gla smurf").sum()
    model = quality.Model(np.stack([quality.term_counts(t) for t in good + bad]), np.array([1] * 40 + [0] * 40))
    s = model.score(np.stack([quality.term_counts(t) for t in ("the river9 runs past an old house9", "zqx ploop9 vrnt wexx mu gla smurf9")]))
    assert s[0] > 0.9 > 0.1 > s[1]


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 0), (7, 1, 0), (8, None, 1), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    got = quality.scored(odd.withColumn("quality", F.lit(9)), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(none, model).count() == 0
    assert quality.accepted_documents(odd.withColumn("quality_score", F.lit(1)), labels.limit(0)).count() == len(ODD)


# 8. packing


def test_pieces_are_the_tokenizers_ids(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = [d[1] or "" for d in ODD] + ["x <|endoftext|> y", " \n \n\n  a  b\t", "é€\U0001f600 it's 12 34!!", "a" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pieces(docs, packing.default_tokenizer(), 128).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        rows = sorted(got[i], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == ids
        assert all(r.length == 128 for r in rows[1:]) and rows[0].length <= 128
        at = 0
        for k, r in enumerate(rows):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length


def test_long_texts_are_encoded_in_stretches(monkeypatch):
    encoder = packing._encoder(packing.default_tokenizer())
    text = "Some words, numb3rs  and   gaps\n\nit's fine. " * 300
    whole = encoder.encode(text)
    monkeypatch.setattr(packing, "STRETCH", 100)
    assert packing.encode(encoder, text).tolist() == whole


def check_placed(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_packing_places_everything_tightly(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed_documents(docs).collect()
    n = check_placed(rows, 2048)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1
    rows = packing.packed_documents(odd.withColumn("run", F.lit(1))).collect()
    check_placed(rows, 2048)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d[0] for d in ODD)
    assert packing.packed_documents(none).count() == 0
    full = packing.pack(docs.limit(30), packing.default_tokenizer(), with_ids=True)
    assert all(len(r.ids) == 4 * r.n_ids <= 8192 for r in packing.sequences(full).collect())


@pytest.mark.parametrize("hist", [{}, {5: 3}, {10: 4}, {6: 100, 4: 100}, {7: 9, 2: 5, 1: 3}, {n: n % 5 + 1 for n in range(1, 11)}])
def test_patterns_cover_the_histogram(hist):
    got, bound = packing.solve(hist, 10)
    used = Counter()
    for pattern, times in got:
        assert sum(n * a for n, a in pattern) <= 10
        for n, a in pattern:
            used[n] += a * times
    assert used == Counter(hist)
    total = sum(t for _, t in got)
    assert bound <= total + 1e-9 and total <= sum(packing._best_fit(hist, 10).values())
    if hist == {6: 100, 4: 100}:
        assert total == 100


def least_sequences(lens, room):
    """The least number of sequences, by trying everything."""
    best = len(lens)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lens):
            best = len(rooms)
            return
        for r in sorted(set(r for r in rooms if r >= lens[k])):
            i = rooms.index(r)
            put(k + 1, rooms[:i] + [r - lens[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, room - lens[k]])

    put(0, [])
    return best


def test_packing_of_few_pieces_is_near_the_least():
    rng = np.random.default_rng(8)
    over = 0
    for _ in range(25):
        lens = sorted(map(int, rng.integers(1, 21, 9)), reverse=True)
        got, bound = packing.solve(dict(Counter(lens)), 20)
        least = least_sequences(lens, 20)
        assert bound <= least + 1e-9 and sum(t for _, t in got) <= least + 1
        over += sum(t for _, t in got) - least
    assert over <= 2


def test_best_fit_by_counts_is_best_fit_by_pieces():
    rng = np.random.default_rng(18)
    for _ in range(20):
        lens = sorted(map(int, rng.integers(1, 50, 120)), reverse=True)
        rooms = []
        for n in lens:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 50) - n)
        got = packing._best_fit(dict(Counter(lens)), 50)
        assert sum(got.values()) == len(rooms)
        assert sum((Counter({n: a * c for n, a in p}) for p, c in got.items()), Counter()) == Counter(lens)


def test_other_kinds_of_tokenizers_go_by_their_own_rules(tmp_path):
    import json

    path = packing.default_tokenizer()
    spec = json.loads(open(path, encoding="utf-8").read())
    assert packing._is_plain(spec)
    spec["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    encoder = packing._encoder(str(other))
    assert packing.encode(encoder, "Some WORDS").tolist() == packing.encode(packing._encoder(path), "some words").tolist()


# 9. language models


def brute_losses(docs, target, d=lmscore.DISCOUNT):
    """Per text of docs: target and background loss under back-off."""
    split = lambda t: (t or "").split()
    words = {w for t in docs + target for w in split(t)}
    models = []
    for texts in (target, docs):
        uni, bi, seen, after = Counter(), Counter(), Counter(), defaultdict(set)
        for t in texts:
            uni.update(split(t))
            bi.update(zip(["<s>"] + split(t), split(t)))
        for (v, w), c in bi.items():
            seen[v] += c
            after[v].add(w)
        n = sum(uni.values()) + 0.5 * (len(words) + 1)
        one = lambda w, uni=uni, n=n: (uni[w] + 0.5) / n
        rest = {v: d * len(ws) / seen[v] / (1 - sum(map(one, ws))) for v, ws in after.items()}
        models.append(lambda v, w, bi=bi, seen=seen, rest=rest, one=one, d=d: (bi[v, w] - d) / seen[v] if bi[v, w] else rest.get(v, 1.0) * one(w))
        for v in [*list(after)[:3], "no such word"]:  # chances add up to one
            assert abs(sum(models[-1](v, w) for w in words) + rest.get(v, 1.0) * 0.5 / n - 1) < 1e-9
    return [tuple(sum(-log(m(v, w)) for v, w in zip(["<s>"] + split(t), split(t))) / len(split(t)) if split(t) else None for m in models) for t in docs]


@pytest.mark.parametrize("discount", [lmscore.DISCOUNT, 0.4])
@pytest.mark.parametrize("head", [1, 30, 100_000])
def test_scores_match_brute_force(spark, odd, none, monkeypatch, head, discount):
    monkeypatch.setattr(lmscore, "HEAD", head)
    monkeypatch.setattr(lmscore, "CHUNK", 100)
    monkeypatch.setattr(lmscore, "BUCKET", 50)
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, int(rng.integers(0, 40))) % 50)) for i in range(80)] + [(3, "w1 w2 w1 w2"), (3, "w1 w2 w1 w2"), (None, None), (None, "w1 x")]
    target = [("w1 w2 w3 w1 w2 w3 w4",), ("w1 w2 w9",), (None,), ("only here",)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = lmscore.cross_entropy_difference(frame, spark.createDataFrame(target, "text string"), discount).collect()
    want = Counter()
    for (i, t), (a, b) in zip(docs, brute_losses([d[1] for d in docs], [t[0] for t in target], discount)):
        want[i, len((t or "").split()), *(None if x is None else round(x, 6) for x in (b, a))] += 1
    assert Counter((r.doc_id, r.n_tokens, *(None if x is None else round(x, 6) for x in (r.background_loss, r.target_loss))) for r in got) == want
    if head == 30:
        assert lmscore.cross_entropy_difference(none, odd.select("text")).count() == 0
        assert lmscore.cross_entropy_difference(odd, none.select("text")).count() == len(ODD)


def test_words_that_are_all_alike_in_number(spark, monkeypatch):
    """40,000 words of three occurrences each, and more bigrams of one count than go to all tasks."""
    monkeypatch.setattr(lmscore, "HEAD", 1000)
    docs = [" ".join(f"w{i}" for i in range(k, k + 400)) for k in range(0, 40_000, 400)] * 3
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for target in (["nothing of it"], ["w1 w2 w1"]):
        got = {r.doc_id: r for r in lmscore.cross_entropy_difference(rows, spark.createDataFrame([(t,) for t in target], "text string")).collect()}
        for i, (t, b) in enumerate(brute_losses(docs, target)):
            assert abs(got[i].target_loss - t) < 1e-6 and abs(got[i].background_loss - b) < 1e-6


def test_word_order_of_bigrams_seen_once_counts(spark):
    """Each bigram of the target occurs once: a document in its order is likelier than its words in another order."""
    target = " ".join(f"t{i}" for i in range(30))
    rng = np.random.default_rng(19)
    docs = [target, " ".join(reversed(target.split())), *(" ".join(f"w{x}" for x in rng.zipf(1.5, 30) % 50) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(rows, spark.createDataFrame([(target,)], "text string")).collect()}
    assert got[0].target_loss < got[1].target_loss - 0.5
    for i, (t, b) in enumerate(brute_losses(docs, [target])):
        assert abs(got[i].target_loss - t) < 1e-6 and abs(got[i].background_loss - b) < 1e-6


def test_every_word_keeps_its_own_count(spark, monkeypatch):
    """More distinct words than the 32,766 that once had ids, and more than go to all tasks."""
    monkeypatch.setattr(lmscore, "HEAD", 10)
    rng = np.random.default_rng(29)
    docs = [" ".join([f"w{x}" for x in rng.zipf(1.5, 60) % 500] + [f"r{x}" for x in rng.integers(0, 90_000, 240)]) for _ in range(250)]
    target = [" ".join(docs[3].split()[100:140]), docs[5]]
    assert len({w for t in docs for w in t.split()}) > 33_000
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(rows, spark.createDataFrame([(t,) for t in target], "text string")).collect()}
    for i, (t, b) in enumerate(brute_losses(docs, target)):
        assert abs(got[i].target_loss - t) < 1e-6 and abs(got[i].background_loss - b) < 1e-6


def test_cutoff_holds_its_bound_where_all_counts_are_alike(spark):
    rows = spark.createDataFrame([(100,)] * 50, "c long")
    assert rows.where(rows.c >= lmscore._cutoff(rows, 10)).count() == 0
    assert rows.where(rows.c >= lmscore._cutoff(rows, 50)).count() == 50


# 10. fingerprints


def test_prefix_hashes_answer_spans_and_extensions():
    rng = np.random.default_rng(10)
    a = "".join(rng.choice(list("ab"), 300))
    b = a[:120] + "c" + a[60:200]
    x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    for i, j in rng.integers(0, 200, (60, 2)):
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.common_extension(int(i), y, int(j)) == n
        assert x.same(int(i), y, int(j), n)
    assert fingerprints.PrefixHashes("").fingerprint() == fingerprints.PrefixHashes("").fingerprint()


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_follow_the_next_document(spark, parts):
    docs = [(d[0], d[1]) for d in ODD if d[0] is not None and d[0] != 6]
    docs += [(100 + i, f"é\U0001f600 text number {i} " * (i + 1)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("part", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.fingerprint_documents(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = sorted(docs, key=lambda d: d[0])
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = defaultdict(set)
    for r in got:
        prints[dict(docs)[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    assert abs(next(r for r in got if r.doc_id == 7).near_edited - 1) < 1e-9  # the next text starts alike


def brute_print(text):
    """Length, two polynomial hashes and the sketch, with Python's own numbers."""
    n, mixed = len(text), set()
    hashes = [sum((ord(c) + 1) * pow(base, i, p) for i, c in enumerate(text)) % p for p, base in fingerprints.PRIMES]
    (p, base), w = fingerprints.PRIMES[0], min(fingerprints.SPAN, n)
    for i in range(n - w + 1 if n else 0):
        h = sum((ord(c) + 1) * pow(base, k, p) for k, c in enumerate(text[i : i + w])) % p
        mixed.add((h + w) * 0x9E3779B97F4A7C15 % 2**64 >> 32)
    return n, hashes, sorted(mixed)[: fingerprints.KEEP]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (set(brute_print(t)[2]) for t in (a, b))
    if not x or not y:
        return 0.0
    few = len(x) < fingerprints.KEEP and len(y) < fingerprints.KEEP
    both = set(sorted(x | y)[: None if few else max(fingerprints.KEEP, min(len(x), len(y)))])
    j = len(both & x & y) / len(both)
    return 2 * j / (1 + j)


def test_fingerprints_match_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("abcé\U0001f600 "), int(n))) for n in (0, 1, 5, 11, 12, 13, 40, 90, 150, 150)]
    texts += [texts[8], texts[8][:100] + "tail", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.fingerprint_documents(rows).collect():
        own, nxt = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        for text, got in ((own, r.fingerprint), (edited, r.edited_fingerprint)):
            n, hashes, sketch = brute_print(text)
            assert got == f"{n:x}." + "".join(f"{h:08x}" for h in hashes) + "." + "".join(f"{h:08x}" for h in sketch)
        assert abs(r.near_edited - brute_likeness(own, edited)) < 1e-12 and abs(r.near_next - brute_likeness(own, nxt)) < 1e-12
        shared = next((i for i, (a, b) in enumerate(zip(own, edited)) if a != b), min(len(own), len(edited)))
        assert r.shared_prefix == shared


def test_fingerprints_of_few_rows(spark, none):
    assert fingerprints.fingerprint_documents(none).count() == 0
    one = fingerprints.fingerprint_documents(none.sparkSession.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(6, hashlib.sha256(b"abcabc").hexdigest())]
    same = fingerprints.likeness(fingerprints.PrefixHashes("x" * 50).fingerprint(), fingerprints.PrefixHashes("").fingerprint())
    assert same == 0.0
    rng = np.random.default_rng(0)
    a, b = ("".join(rng.choice(list("abcdefgh "), 4000)) for _ in range(2))
    half = fingerprints.likeness(*(fingerprints.PrefixHashes(t).fingerprint() for t in (a, a[:2000] + b[:2000])))
    assert 0.3 < half < 0.7


def test_linked_rows_without_links(spark):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 7)], "id long, node long")
    got = {r.id: r for r in linked_rows(rows, spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "a long, b long")).collect()}
    assert (got[3].class_id, got[3].n_links, got[3].component_id) == (1, 1, 1) and (got[2].n_links, got[2].component_id) == (0, 2)
