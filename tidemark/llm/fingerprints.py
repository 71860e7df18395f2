"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table

#: two primes below 2^31, so that products stay within 64 bits, and their bases
PRIMES = ((2147483647, 1000003), (2147483629, 998244353))
#: code points of the spans that a sketch is made of, and hashes it keeps
SPAN, KEEP = 12, 64


class _Powers:
    """Powers of a base and of its inverse, grown by doubling as texts need them."""

    def __init__(self, p: int, base: int):
        self.p = np.uint64(p)
        self.up = self._start(base)
        self.down = self._start(pow(base, -1, p))

    def _start(self, base: int) -> np.ndarray:
        return np.array([1, base % int(self.p)], dtype=np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            for name in ("up", "down"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, a * (a[-1] * a[1] % self.p) % self.p]))


_POWERS = [_Powers(*x) for x in PRIMES]


class PrefixHashes:
    """``h[i]`` is the polynomial hash of the first i code points, modulo each prime.

    Any two spans of any two texts can be compared in constant time, and the longest
    common extension of two places is found by binary search.
    """

    def __init__(self, text: str):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(chars)
        self.h = []
        for pw in _POWERS:
            pw.reach(self.n + 1)
            h = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(chars * pw.up[: self.n] % pw.p, out=h[1:])
            h %= pw.p
            self.h.append(h)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        return tuple((int(h[j]) - int(h[i])) * int(pw.down[i]) % int(pw.p) for h, pw in zip(self.h, _POWERS, strict=True))

    def same(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """The number of code points for which the texts agree from places i and j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self) -> np.ndarray:
        """The KEEP smallest distinct hashes of all spans of SPAN code points (of the text, if it is shorter)."""
        if not self.n:
            return np.zeros(0, dtype=np.uint32)
        pw, h, w = _POWERS[0], self.h[0], min(SPAN, self.n)
        spans = (h[w:] + pw.p - h[:-w]) * pw.down[: self.n - w + 1] % pw.p
        mixed = ((spans + np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
        most = 4 * KEEP
        if len(mixed) > 2 * most:  # most of the hashes are too large to matter
            few = np.unique(mixed[mixed < int(2**32 * most / len(mixed))])
            if len(few) >= KEEP:
                return few[:KEEP]
        return np.unique(mixed)[:KEEP]

    def fingerprint(self) -> str:
        a, b = self.span(0, self.n)
        return f"{self.n:x}.{a:08x}{b:08x}." + self.sketch().astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of spans that two texts have in common (Dice), as their fingerprints tell:
    1 for equal fingerprints, 0 if one of two texts is empty."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rpartition(".")[2]), dtype=">u4").astype(np.uint32) for s in (a, b))
    both = np.union1d(x, y)[: max(KEEP, min(len(x), len(y)))]
    if not len(x) or not len(y):
        return 0.0
    if len(x) < KEEP and len(y) < KEEP:
        both = np.union1d(x, y)
    j = np.isin(both, np.intersect1d(x, y), assume_unique=True).mean()
    return float(2 * j / (1 + j))


ROWS = "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long, text string"
NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]


def _compare(doc_id, text: str, own: PrefixHashes, print_: str, nxt: str, next_print: str) -> list:
    half = len(text) // 2
    edited = text[: len(text) - half] + nxt[:half]
    other = PrefixHashes(edited)
    other_print = other.fingerprint()
    return [doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_, other_print, likeness(print_, other_print), likeness(print_, next_print), own.common_extension(0, other, 0)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    shared_prefix`` for every row of ``docs``.

    The next document is the next row in order of doc_id (nulls first, ties by a hash of the
    text); the first follows the last. Texts move once: rows are range-partitioned and sorted by
    doc_id, and a task meets each text and the next one in turn. A task hands on its
    first text and its last, one row each, and these are joined with those of the next
    task. Null texts are empty; an empty text has an empty sketch. A single document follows
    itself. ``shared_prefix`` is how many code points text and edited text share from the start.
    Memory: one batch and the prefix arrays of two texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for doc_id, text, part in zip(batch.doc_id, batch.text, batch.part, strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                own = PrefixHashes(text)
                now = (doc_id, text, own, own.fingerprint())
                if last is None:
                    out.append(["first", part, doc_id, *[None] * 3, None, None, None, None, text])
                else:
                    out.append(["row", part, *_compare(*last, text, now[3]), None])
                last = now
            yield frame(out)
        if last is not None:
            yield frame([["last", part, last[0], *[None] * 7, last[1]]])

    def frame(out) -> pd.DataFrame:
        return pd.DataFrame([x if len(x) == len(NAMES) else x[:3] + [None] * 7 + [x[-1]] for x in out], columns=NAMES).astype({"doc_id": "Int64", "n_chars": "Int64", "shared_prefix": "Int64"})

    done = cut(rows.mapInPandas(run, ROWS), "fingerprints")
    # one row per task from here on
    order = Window.orderBy("part")
    ends = done.where("kind = 'first'").select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    lasts = done.where("kind = 'last'").select("part", "doc_id", F.col("text").alias("own")).join(ends, "part")
    firsts = done.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    pairs = lasts.join(firsts, "next").select("part", "doc_id", "own", "following")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, doc_id, own, following in zip(batch.part, batch.doc_id, batch.own, batch.following, strict=True):
                a, b = PrefixHashes(own), PrefixHashes(following)
                out.append(["row", part, *_compare(None if pd.isna(doc_id) else int(doc_id), own, a, a.fingerprint(), following, b.fingerprint()), None])
            yield frame(out)

    return done.where("kind = 'row'").union(pairs.mapInPandas(join, ROWS)).select(NAMES[2:-1])


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
