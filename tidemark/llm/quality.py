"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: labelled rows that are used of each class, in order of a hash of doc_id
PER_CLASS = 1500
#: dimensions of the latent space; neighbours that vote; power of the similarity that weighs a vote
DIMS, NEIGHBOURS, POWER = 32, 15, 4
ACCEPT = 0.7
#: hashed shape terms, and hashed words; how much words weigh beside shapes
TERMS, WORDS = 4096, 4096
WORD_WEIGHT = 0.25
#: documents for which products are computed at once
BLOCK = 256

_SHAPES: list[np.ndarray] = []


def _shapes() -> np.ndarray:
    """Code point to its shape: letters by case, digits, kinds of space, and each other sign by itself."""
    if not _SHAPES:
        kind = lambda c: 2 if c.isupper() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 1 if c.isalnum() else 6 + ord(c) % 58
        _SHAPES.append(np.array([kind(chr(i)) for i in range(0x3000)], dtype=np.uint8))
    return _SHAPES[0]


class _Bins(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = k = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        return k


_BINS = _Bins()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of a whole text's terms: three-letter shapes (hashed to TERMS), words that repeat the word before them and words
    that do not, and words in lower case (hashed to WORDS)."""
    text = text or ""
    out = np.zeros(TERMS + 2 + WORDS)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = _shapes()[np.minimum(chars, 0x2FFF)].astype(np.uint32)
    k[chars >= 0x3000] = 1
    if len(k) >= 3:
        terms = (k[:-2] << np.uint32(12)) + (k[1:-1] << np.uint32(6)) + k[2:]
        out[:TERMS] = np.bincount((terms * np.uint32(2654435761)) >> np.uint32(20), minlength=TERMS)
    words = text.split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[TERMS : TERMS + 2] = again, len(words) - again
    if words:
        at = np.fromiter(map(_BINS.__getitem__, words), dtype=np.int64, count=len(words))
        out[TERMS + 2 :] = np.bincount(at, minlength=WORDS)
    return out


def _weighted(counts: np.ndarray, rarity: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Square roots of counts, those of words by their rarity; shapes and repeats with length 1 each, words with WORD_WEIGHT.
    Written to ``out``, if given."""
    a = np.sqrt(counts, out=out)
    a[:, TERMS + 2 :] *= rarity.astype(a.dtype)
    for part, weight in ((slice(0, TERMS), 1.0), (slice(TERMS, TERMS + 2), 1.0), (slice(TERMS + 2, None), WORD_WEIGHT)):
        a[:, part] *= (weight / np.maximum(np.linalg.norm(a[:, part], axis=1, keepdims=True), 1e-12)).astype(a.dtype)
    return a


class Model:
    """The latent space and the labelled vectors in it: at most ``2 * PER_CLASS`` rows of DIMS numbers. ``counts``
    (a matrix of floats) is used up."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.rarity = np.log((1 + len(counts)) / (1 + (counts[:, TERMS + 2 :] > 0).sum(axis=0)))
        a = counts  # weighted in place, for the driver's memory
        for i in range(0, len(a), BLOCK):
            _weighted(a[i : i + BLOCK], self.rarity, out=a[i : i + BLOCK])
        self.labels, self.mean = labels.astype(float), a.mean(axis=0, dtype=float)
        a -= self.mean.astype(a.dtype)
        dims = min(DIMS, *a.shape)
        # randomized truncated singular value decomposition (Halko et al. 2011)
        q = np.random.default_rng(0).standard_normal((a.shape[1], min(2 * dims, a.shape[1]))).astype(a.dtype)
        for _ in range(5):
            q = np.linalg.qr(a.T @ (a @ q))[0]
        small = np.linalg.svd((a @ q).astype(float), full_matrices=False)[2]
        self.basis = q.astype(float) @ small[:dims].T
        self.vectors = self._unit(np.concatenate([a[i : i + BLOCK].astype(float) @ self.basis for i in range(0, len(a), BLOCK)]))

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self._unit((_weighted(counts, self.rarity) - self.mean) @ self.basis)
        cos = np.round(z @ self.vectors.T, 12)
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argsort(-cos, axis=1, kind="stable")[:, :k] if k == len(self.labels) else np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0.0) ** POWER + 1e-9
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Learns from at most ``per_class`` labelled, not held-out rows of each class. None if there are none."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = F.broadcast(pick[0].union(pick[1]))  # at most 2 * per_class rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, quality, text in zip(batch.doc_id, batch.quality, batch.text, strict=True):
                v = term_counts(text)
                at = np.flatnonzero(v)
                out.append((doc_id, quality, at.astype("<u2").tobytes(), v[at].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "at", "v"])

    got = docs.select("doc_id", "text").join(sample, "doc_id").mapInPandas(run, "doc_id long, quality int, at binary, v binary")
    # of rows that share a doc_id, one is used
    rows = got.groupBy("doc_id").agg(F.min(F.struct("quality", "at", "v")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    if not rows:
        return None
    counts = np.zeros((len(rows), TERMS + 2 + WORDS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["v"], "<f4")
    return Model(counts, np.array([r["quality"] for r in rows]))


def scored(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; higher: label 1 likelier.

    Null texts count as empty, and empty texts are scored like others. Without any labelled row
    every score is 1. Only the text decides; rows are scored where they lie, without a shuffle. A column of the
    name ``column`` is replaced.
    """
    if model is None:
        return docs.withColumn(column, F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            parts = [m.score(np.stack([term_counts(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(column, score("text"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns, whatever their names; repeated rows are judged alike.

    Null and empty texts are scored as empty texts. Without any labelled row all stay; empty documents give none.
    """
    from .common import fresh

    name = fresh(docs, "quality_score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= ACCEPT).select(docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
