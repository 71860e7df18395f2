"""Scores by cross-entropy difference between a target and a background n-gram model (Moore and Lewis 2010)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: words and bigrams at most whose values are sent to all tasks; those of the rest are joined
HEAD = 262_144
#: a bigram may be sent to all tasks only if it comes so often among CHUNK words somewhere (its count is then taken over all)
OFTEN = 4
#: added to each word's count; taken from each bigram's
ADD, DISCOUNT = 0.5, 0.75
#: words that are worked on at once
CHUNK = 1 << 18


def _cutoff(counts: DataFrame, most: int) -> int:
    """The least count of which no more than ``most`` rows are reached, to an eighth of a doubling; where the
    topmost eighth alone has more, a count that no row reaches. The driver sees one row per eighth."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    found = {r["k"]: (r["n"], r["low"]) for r in counts.where("c > 0").groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()}
    total, low = 0, 2**62
    for k in sorted(found, reverse=True):
        total += found[k][0]
        if total > most:
            return low
        low = found[k][1]
    return 1


class _Hash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _start() -> np.uint64:
    """Stands before each document: the hash of what is no word."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(b" "))


def _keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of a bigram; ``KEY`` is the same in Spark."""
    return (v << np.uint64(21) | v >> np.uint64(43)) ^ w


KEY = "(shiftleft(v, 21) | shiftrightunsigned(v, 43)) ^ w"


def _chunks(texts: pa.Array, hashes: _Hash, start: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in portions of about CHUNK words: the first text's number, each text's number of words, and for
    each word the hash of the word before it and its own."""
    held, size, first = [], 0, 0
    every = texts.cast(pa.binary())
    for i in range(len(every)):
        held.append((every[i].as_py() or b"").split())
        size += len(held[-1])
        if size >= CHUNK or i == len(every) - 1:
            n = np.array([len(x) for x in held])
            w = np.fromiter(map(hashes.__getitem__, chain.from_iterable(held)), dtype=np.uint64, count=size)
            v = np.empty_like(w)
            v[1:] = w[:-1]
            v[(np.cumsum(n) - n)[n > 0]] = start
            yield first, n, v, w
            held, size, first = [], 0, i + 1


COUNTS = "key long, word boolean, c long"
#: what a portion of documents (``chunk``: a hash of its rows' keys in order) asks one bucket of keys: the places of the documents that ask
#: there (``docs``), how many asks each has (``sizes``), and the asks; or, without keys, the documents themselves (``rows``, ``ids``, and words in
#: ``sizes``), what they have without asking, and how many buckets are asked (``asked``). Numbers stand one after another in a binary.
ASKS = "chunk long, bucket int, rows binary, docs binary, sizes binary, keys binary, n binary, kind binary, ids binary, t binary, b binary, asked int"
#: the same with what a bucket answers: for each document that asked its sums
ANSWERS = "chunk long, rows binary, docs binary, sizes binary, kind binary, ids binary, t binary, b binary, asked int"
FOUND = "row long, doc_id long, tokens long, t double, b double"
#: asks in one bucket, about
BUCKET = 1 << 21
#: kinds of an ask: for a bigram, a word, a word that also ends the text
BIGRAM, WORD, LAST = 0, 1, 2


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and where there."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    may = np.zeros(1 << 20, dtype=bool)
    may[sorted_keys >> np.uint64(44)] = True
    at = np.flatnonzero(may[keys >> np.uint64(44)])
    place = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
    hit = sorted_keys[place] == keys[at]
    return at[hit], place[hit]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _target_values(target: DataFrame, known: DataFrame, discount: float) -> tuple[DataFrame, float]:
    """``(key, x, u)`` of all words and bigrams of ``target``: what a word or bigram adds to a logarithm each
    time it stands (a word: as context), and what a word adds each time it stands as word; and the logarithm of the
    chance of a word that the target lacks. ``known(key)``: the words of the background."""
    start = _start()

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hash()
        for batch in batches:
            for _, _, v, w in _chunks(batch.column(0), hashes, start):
                yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(w.view(np.int64))], names=["v", "w"])

    pairs = cut(target.select("text").mapInArrow(bigrams, "v long, w long").groupBy("v", "w").agg(F.count("*").alias("t")), "lm-target")
    words = pairs.groupBy(F.col("w").alias("key")).agg(F.sum("t").alias("t"))
    kinds = known.count() + words.join(known, "key", "left_anti").count()
    d = F.lit(discount)
    mass = (pairs.agg(F.sum("t")).first()[0] or 0) + ADD * (kinds + 1)
    chance = ((F.col("t") + ADD) / mass).alias("p")
    both = pairs.join(words.select(F.col("key").alias("w"), chance), "w")
    contexts = both.groupBy("v").agg(F.sum("t").alias("c"), F.count("*").alias("kinds"), F.sum("p").alias("seen"))
    contexts = contexts.select("v", "c", F.log(d * F.col("kinds") / F.col("c") / (1 - F.col("seen"))).alias("a"))
    rest = float(np.log(ADD / mass))
    stands = both.join(contexts, "v").select(F.expr(KEY).alias("key"), (F.log((F.col("t") - d) / F.col("c")) - F.col("a") - F.log("p")).alias("x"), F.lit(0.0).alias("u"))
    as_context = contexts.select(F.col("v").alias("key"), F.col("a").alias("x"), F.lit(0.0).alias("u"))
    as_word = words.select("key", F.lit(0.0).alias("x"), (F.log(chance) - rest).alias("u"))
    return cut(stands.union(as_context.union(as_word).groupBy("key").agg(F.sum("x").alias("x"), F.sum("u").alias("u"))), "lm-target-values"), rest


def cross_entropy_difference(docs: DataFrame, target: DataFrame, discount: float = DISCOUNT, from_files: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` and ``target(text)`` to ``doc_id, n_tokens, target_loss, background_loss,
    score``, one row per row of ``docs``.

    Two bigram models over the words of both, of ``target`` and of all of ``docs``, by absolute discounting with
    back-off (Katz): ``P(w|v) = (c(v,w) - discount) / c(v)`` for a bigram that the model has, else ``a(v) P(w)``
    with the ``a(v)`` that makes the chances after v add up to one (1 after a context that the model lacks).
    Losses are nats per token; ``score`` is the target's less the background's: lower is more like the target.

    Words are runs of anything but ASCII white space; every word of both tables has its own count, and
    ``P(w)`` is ``c(w)`` and ADD over their sum, with one more word for all that never occur. Words and bigrams are told
    apart by 64-bit hashes.

    A logarithm under back-off is a sum of what bigram, context and word each add, so each is looked up by
    itself and only sums come back:

    1. Words are counted, and with them the bigrams that come often somewhere; of both the most frequent,
       at most HEAD, are counted over all documents and sent to all tasks.
    2. Every document asks for its other words and bigrams, in buckets of keys whose number grows with the
       corpus. In a bucket all asks for a key meet, which is its count over all documents, and meet
       what the target has of it. Asks of many documents for one bucket travel in one row, 8 bytes each; answers are two sums for
       each document that asked there.
    3. What came of them is added up per portion of documents, and to what each had from the frequent ones. A portion's rows are
       in order of their keys, so a task that runs again asks the same; only where ``from_files`` says that ``docs`` are read as they lie in
       files, whose order is fixed, they need no sort. A portion whose answers are not all there is an error.

    doc_id is read as a long. Null texts and texts without words have 0 tokens and null losses and score. Repeated rows are scored each.
    Without target text the target model is uniform over the words. Extra columns are left aside.
    """
    spark = docs.sparkSession
    start = _start()
    start_key = int(start.view(np.int64))
    counted = _schema(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hash()
        for batch in batches:
            for _, _, v, w in _chunks(batch.column(0), hashes, start):
                u, n = np.unique(_keys(v, w), return_counts=True)
                words, context = np.unique(v, return_counts=True)
                ends = np.setdiff1d(w, words)  # words that are no context here
                keys = np.concatenate([u[n >= OFTEN], words, ends])
                n = np.concatenate([n[n >= OFTEN], context, np.zeros(len(ends), dtype=np.int64)])
                word = np.arange(len(keys)) >= len(keys) - len(words) - len(ends)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(word), pa.array(n)], schema=counted)

    counts = cut(docs.select("text").mapInArrow(count, COUNTS).groupBy("key", "word").agg(F.sum("c").alias("c")), "lm-words")
    begins = F.col("key") == F.lit(start_key)
    values, rest = _target_values(target, counts.where(F.col("word") & ~begins).select("key"), discount)
    frequent = counts.where((F.col("c") >= _cutoff(counts, HEAD)) | begins).toPandas()  # at most HEAD rows and one
    as_keys = lambda frame: np.sort(frame.key.to_numpy(dtype=np.int64).view(np.uint64))
    often = spark.sparkContext.broadcast(as_keys(frequent[~frequent.word.astype(bool)]))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys = _Hash(), often.value
        for batch in batches:
            for _, _, v, w in _chunks(batch.column(0), hashes, start):
                n = np.bincount(_places(keys, _keys(v, w))[1], minlength=len(keys))
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array(keys[at].view(np.int64)), pa.array(np.zeros(len(at), dtype=bool)), pa.array(n[at])], schema=counted)

    bigrams = docs.select("text").mapInArrow(recount, COUNTS).groupBy("key").agg(F.sum("c").alias("c")).toPandas()  # at most HEAD rows
    words = frequent[frequent.word.astype(bool) & (frequent.c > 0)]
    head = {int(k): [-np.log(c), 0.0, 0.0] for k, c in zip(words.key, words.c, strict=True)}
    head |= {int(k): [np.log((c - discount) / (1 - discount)), 0.0, 0.0] for k, c in zip(bigrams.key, bigrams.c, strict=True)}
    head.setdefault(start_key, [0.0, 0.0, 0.0])
    keys = F.broadcast(spark.createDataFrame([(k,) for k in head], "key long"))
    for r in values.join(keys, "key", "left_semi").toLocalIterator():
        head[r.key][1:] = r.x, r.u
    top = np.array(list(head), dtype=np.int64).view(np.uint64)
    order = np.argsort(top)
    shared = spark.sparkContext.broadcast((top[order], *np.array(list(head.values()))[order].T.copy()))

    buckets = 1 + (counts.where("word").agg(F.sum("c")).first()[0] or 0) // BUCKET

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, schema = _Hash(), _schema(ASKS)
        top, b, x, u = shared.value

        def one(**parts) -> pa.RecordBatch:
            return pa.record_batch([pa.array([parts.get(f.name)], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            ids, row_of = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for first, n, v, w in _chunks(batch.column(1), hashes, start):
                own, pairs, row = np.repeat(np.arange(len(n)), n), _keys(v, w), row_of[first : first + len(n)]
                in_pairs, in_v, in_w = (_places(top, k) for k in (pairs, v, w))
                add = lambda what, found: np.bincount(own[found[0]], what[found[1]], len(n))
                doc_id = ids.slice(first, len(n))
                known = doc_id.is_valid().to_numpy(zero_copy_only=False)
                target = n * rest + add(x, in_pairs) + add(x, in_v) + add(u, in_w)
                background = n * np.log(1 - discount) + add(b, in_pairs) + add(b, in_v)
                chunk = int(np.uint64(xxhash.xxh64_intdigest(row.tobytes())).view(np.int64))
                last = np.zeros(len(n), dtype=np.uint64)
                last[n > 0] = w[(np.cumsum(n) - 1)[n > 0]]
                asks = []
                # every context but the start is a word of the same text
                for keys, found, is_word in ((pairs, in_pairs, False), (w, in_w, True)):
                    far = np.ones(len(keys), dtype=bool)
                    far[found[0]] = False
                    k, o = keys[far], own[far]
                    _, at, times = np.unique(k * np.uint64(0x9E3779B97F4A7C15) ^ o.astype(np.uint64), return_index=True, return_counts=True)
                    ends = (last[o[at]] == k[at]) & is_word
                    asks.append((k[at], o[at], times - ends, np.where(ends, LAST, WORD if is_word else BIGRAM)))
                k, o, times, kind = map(np.concatenate, zip(*asks, strict=True))
                to = (k % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to * len(n) + o, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(buckets + 1))
                asked = np.flatnonzero(np.diff(bounds))
                yield one(chunk=chunk, bucket=chunk % buckets, rows=row.tobytes(), sizes=n.astype("<i8").tobytes(), kind=known.astype("u1").tobytes(), ids=doc_id.fill_null(0).to_numpy().astype("<i8").tobytes(), t=target.tobytes(), b=background.tobytes(), asked=len(asked))
                for j in asked:
                    mine = order[bounds[j] : bounds[j + 1]]
                    who, times_each = np.unique(o[mine], return_counts=True)
                    yield one(chunk=chunk, bucket=int(j), docs=who.astype("<i4").tobytes(), sizes=times_each.astype("<i4").tobytes(), keys=k[mine].tobytes(), n=times[mine].astype("<i4").tobytes(), kind=kind[mine].astype("u1").tobytes())

    joined = lambda part, kind: np.frombuffer(b"".join(part), dtype=kind)

    def answer(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        base, asks = asks[asks["keys"].isna()], asks[asks["keys"].notna()]
        out = [base[names]]
        if len(asks):
            sizes, keys, n, kind = (joined(asks[c], k) for c, k in (("sizes", "<i4"), ("keys", "<u8"), ("n", "<i4"), ("kind", "u1")))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            distinct, at = np.unique(keys, return_inverse=True)
            c = np.bincount(at, n)
            with np.errstate(divide="ignore", invalid="ignore"):  # a word that is never a context has no count and is not asked for as one
                back = np.where(n > 0, n * np.where(kind == BIGRAM, np.log((c - discount) / (1 - discount))[at], -np.log(c)[at]), 0.0)
            x, u = np.zeros(len(distinct)), np.zeros(len(distinct))
            own_keys = own.key.to_numpy(dtype=np.int64).view(np.uint64)
            order = np.argsort(own_keys)
            here, place = _places(own_keys[order], distinct)
            x[here], u[here] = own.x.to_numpy()[order][place], own.u.to_numpy()[order][place]
            toward = x[at] * n + u[at] * (n + (kind == LAST))
            ends = np.cumsum([len(s) // 4 for s in asks.sizes])[:-1]
            t, b = (np.split(np.bincount(doc, part, len(sizes)), ends) for part in (toward, back))
            out.append(pd.DataFrame({"chunk": asks.chunk.to_numpy(), "rows": None, "docs": asks.docs.to_numpy(), **dict.fromkeys(names[3:6]), "asked": 0, "t": [x.tobytes() for x in t], "b": [x.tobytes() for x in b]}))
        return pd.concat(out) if len(base) else out[-1]

    names = [c.split(" ")[0] for c in ANSWERS.split(", ")]

    def add_up(answers: pd.DataFrame) -> pd.DataFrame:
        base, parts = answers[answers["rows"].notna()], answers[answers["rows"].isna()]
        copies_of = len(base)  # portions with the same rows in the same order
        if not copies_of or len(parts) != base["asked"].sum():
            raise ValueError("answers of a portion are missing: its documents came in another order when a task ran again")
        one = base.iloc[0]
        row, ids, tokens, known = (np.frombuffer(one[c], k) for c, k in (("rows", "<i8"), ("ids", "<i8"), ("sizes", "<i8"), ("kind", "u1")))
        doc_id = pd.array(ids.copy(), dtype="Int64")
        doc_id[known == 0] = pd.NA
        t, b = (np.frombuffer(one[c], "<f8").copy() for c in "tb")
        who = joined(parts["docs"], "<i4")
        for sums, c in ((t, "t"), (b, "b")):
            np.add.at(sums, who, joined(parts[c], "<f8") / copies_of)
        return pd.concat([pd.DataFrame({"row": row, "doc_id": doc_id, "tokens": tokens, "t": t, "b": b})] * copies_of)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    # in order of the rows' keys, so that a task that runs again makes the same portions in whatever order its rows come
    rows = rows if from_files else rows.sortWithinPartitions("row")
    asked = rows.mapInArrow(ask, ASKS)
    # the bucket of a key as an unsigned number
    unsigned = F.when(F.col("key") >= 0, F.pmod("key", F.lit(buckets))).otherwise(F.pmod(F.pmod("key", F.lit(buckets)) + F.lit(2**64 % buckets), F.lit(buckets)))
    tail = values.join(keys, "key", "left_anti").withColumn("bucket", unsigned.cast("int"))
    got = asked.groupBy("bucket").cogroup(tail.groupBy("bucket")).applyInPandas(answer, ANSWERS)
    got = got.groupBy("chunk").applyInPandas(add_up, FOUND)
    n, loss = F.col("tokens"), lambda c: F.when(F.col("tokens") > 0, -F.col(c) / F.col("tokens"))
    return got.select("doc_id", n.alias("n_tokens"), loss("t").alias("target_loss"), loss("b").alias("background_loss"), (loss("t") - loss("b")).alias("score"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Documents scored against the benchmark's texts as target."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), from_files=True)
