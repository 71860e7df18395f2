"""N-gram Jaccard join with Bayesian candidate pruning (after BayesLSH, Satuluri and Parthasarathy 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HUB, MOST_HUBS, components, cut, fresh, labels_of, linked_rows, partitions, spread_join, table

WORDS = 5
SIMILAR = 0.8
#: a text with such a character has words
WORD = r"[^\x20\x09-\x0D]"
#: MinHash values come in BANDS bands of ROWS; a pair at 0.8 shares no band with probability 5e-6, at 0.85 with 6e-9
BANDS, ROWS = 40, 6
#: values that are compared at a time, and the posterior probability below which a pair is dropped
STEP, TOLERANCE = 40, 1e-7
#: classes and shingles in one block of a candidate group
BLOCK, BLOCK_SHINGLES = 512, 2_000_000

_A = np.random.default_rng(11).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_BAND = np.random.default_rng(12).integers(0, 2**63, (ROWS, BANDS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Word to hash; starts afresh when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, hashes: dict, n: int = WORDS) -> np.ndarray:
    """The set of hashes of all runs of n words (of all words, if there are fewer; none without
    words), sorted. A word is a run of anything but ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * _A).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).T.astype(np.uint64)
    return _mix((rows * _BAND).sum(axis=0, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_matches(similar: float = SIMILAR, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Per number of values compared, the matches below which a pair is dropped.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1); its tail from ``similar`` up is that of a binomial, P(Bin(n + 1, similar) <= m).
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


_LEAST = least_matches()


def surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that are not dropped, comparing STEP values at a time."""
    m = np.concatenate([(a[i : i + 64, None, :STEP] == b[None, :, :STEP]).sum(axis=2, dtype=np.int16) for i in range(0, len(a), 64)])
    i, j = np.nonzero(m >= _LEAST[STEP])
    m = m[i, j]
    for n in range(2 * STEP, a.shape[1] + 1, STEP):
        for at in range(0, len(i), 50_000):
            s = slice(at, at + 50_000)
            m[s] += (a[i[s], n - STEP : n] == b[j[s], n - STEP : n]).sum(axis=1, dtype=np.int16)
        keep = m >= _LEAST[n]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def _shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles each pair (a[i], b[j]) has in common."""
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    sets = [*a, *b]
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, count = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # what one set alone has can't be shared
    many = count[at] > 1
    owner, at = owner[many], column[at[many]]
    out, width = np.zeros(len(i), dtype=np.int64), 1 << 15
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(at, [start, start + width])
        bits = np.zeros((len(sets), width), dtype=bool)
        bits[owner[lo:hi], at[lo:hi] - start] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for s in range(0, len(i), 4096):
            x, y = packed[i[s : s + 4096]], packed[len(a) + j[s : s + 4096]]
            out[s : s + 4096] += np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
    return out


def _links(a: tuple, b: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between two blocks of (signatures, shingle sets): not dropped, then verified exactly."""
    i, j = surviving(a[0], b[0])
    if same:
        i, j = i[i < j], j[i < j]
    sizes_a, sizes_b = np.array([len(s) for s in a[1]]), np.array([len(s) for s in b[1]])
    both = _shared(a[1], b[1], i, j)
    union = sizes_a[i] + sizes_b[j] - both
    ok = both >= SIMILAR * union - 1e-9
    return i[ok], j[ok]


SIGNED = "id long, row long, node long, size long, bands array<long>"
FOUND = "kind string, a long, b long"


def signed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its id, a key of the row, the hash of its shingle set as
    node (null without words), the set's size and its bands' keys."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = _Hashes()
        for batch in batches:
            out = []
            for doc_id, text, row in zip(batch.doc_id, batch.text, batch.row, strict=True):
                s = shingles(text, hashes)
                node = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None
                out.append((doc_id, row, node, len(s), band_keys(minhash(s)) if len(s) else None))
            yield pd.DataFrame(out, columns=["id", "row", "node", "size", "bands"]).astype({"id": "Int64", "node": "Int64"})

    return rows.mapInPandas(run, SIGNED)


def repeated(rows: DataFrame) -> DataFrame | None:
    """Keys of rows that come more than HUB times (or more often than MOST_HUBS keys at most can), to be sent to all tasks: at most
    MOST_HUBS. None where there are none."""
    many = max(HUB, -(-rows.count() // MOST_HUBS))
    found = cut(rows.groupBy("row").count().where(F.col("count") > many).select("row"), "near-repeated")
    return None if found.isEmpty() else F.broadcast(found)


def _few(rows: DataFrame, many: DataFrame | None, key: str = "row") -> DataFrame:
    """``rows`` with one row for each key of ``many``, chosen within each task before any is sent."""
    if many is None:
        return rows
    many = many.withColumnRenamed("row", key)
    one = rows.join(many, key, "left_semi").groupBy(key).agg(F.first(F.struct(rows.columns)).alias("r"))
    return rows.join(many, key, "left_anti").select(rows.columns).union(one.select("r.*"))


def near_duplicates(docs: DataFrame, roots: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id, row, node, class_id, n_links, component_id``, and with ``roots`` the
    component's own key ``root``.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles is
    SIMILAR or more. Documents with the same set are one class (``class_id``: its smallest
    doc_id); ``n_links`` counts the other documents linked with this one, copies included, and
    ``component_id`` is the smallest doc_id that links lead to.

    1. Each text is read once: the hash of its shingle set, and MinHash bands.
    2. Classes that share a band with the band's smallest class are joined with it, and connected: all
       links lie within such candidate groups (but for the probability given at BANDS).
    3. A group is cut into blocks of at most about BLOCK classes, each pair of blocks is one unit of work.
       There MinHash values are compared STEP at a time, pairs whose posterior probability of
       reaching SIMILAR falls below TOLERANCE are dropped, and the rest are verified exactly.
       A unit gives one count per class and a spanning forest: no list of pairs, however
       large a group of near copies is.

    Null texts, empty ones and those of white space have no shingles and link with nothing, not
    even each other. Texts of fewer words are one shingle. Repeated rows are documents of
    their own. doc_id is read as a long; nulls are allowed. Shingles and sets are told apart by 64-bit hashes.
    """
    rows = cut(signed(docs), "near-rows")
    # one row stands for its class: a text that a third of all rows share is one class before anything else is asked of it
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    classes = cut(classes, "near-classes")
    each = classes.select("node", F.explode("bands").alias("band"))
    shared = cut(each.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1"), "near-shared")
    stars = spread_join(each, "band", "node", shared).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = cut(components(stars, "near-candidates"), "near-groups")
    stand = classes.select("node", "row", "n", "size").join(groups, "node")
    stand = cut(stand, "near-stand")
    large = stand.groupBy("root").agg(F.count("*").alias("classes"), F.sum("size").alias("total")).select("root", F.ceil(F.greatest(F.col("classes") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    stand = stand.join(cut(large, "near-large"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    stand = stand.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    full = stand.join(_few(texts, repeated(rows)), "row")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t, hashes) for t in batch.text]
            yield batch.drop(columns="text").assign(sig=[minhash(s).tobytes() for s in sets], sh=[s.tobytes() for s in sets])

    full = full.select("root", "node", "n", "blocks", "block", "text").mapInPandas(features, "root long, node long, n long, blocks int, block int, sig binary, sh binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = full.select("root", "node", "n", "block", "sig", "sh", other)
    units = units.select("root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "n", "sig", "sh")
    units = units.repartition(partitions(docs.sparkSession), "root", "p", "q").sortWithinPartitions("root", "p", "q", "node")

    def one(rows: list) -> pd.DataFrame | None:
        # a row comes twice where the text's row came twice
        p, q = rows[0].p, rows[0].q
        sides = []
        for side in (p, q):
            own = list({r.node: r for r in rows if r.block == side}.values())
            sides.append((own, np.array([np.frombuffer(r.sig, np.uint32) for r in own]).reshape(-1, BANDS * ROWS), [np.frombuffer(r.sh, np.uint64) for r in own]))
        if p == q:
            sides[1] = sides[0]
        if not sides[0][0] or not sides[1][0]:
            return None
        i, j = _links(sides[0][1:], sides[1][1:], p == q)
        if not len(i):
            return None
        shift = 0 if p == q else len(sides[0][0])
        every = sides[0][0] if p == q else sides[0][0] + sides[1][0]
        nodes, n = np.array([r.node for r in every]), np.array([r.n for r in every])
        j = j + shift
        count = np.bincount(i, n[j], len(every)) + np.bincount(j, n[i], len(every))
        label = labels_of(len(every), i, j)
        has, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(every)))
        return pd.concat([pd.DataFrame({"kind": "links", "a": nodes[has], "b": count[has].astype(np.int64)}), pd.DataFrame({"kind": "edge", "a": nodes[moved], "b": nodes[label[moved]]})])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.root, r.p, r.q) != key:
                    if held and len(held) > 1 and (got := one(held)) is not None:
                        out.append(got)
                    key, held = (r.root, r.p, r.q), []
                held.append(r)
            if out:
                yield pd.concat(out)
                out = []
        if len(held) > 1 and (got := one(held)) is not None:
            yield got

    found = cut(units.mapInPandas(join, FOUND), "near-found")
    links = found.where("kind = 'links'").select(F.col("a").alias("node"), F.col("b").alias("n"))
    return linked_rows(rows.select("id", "row", "node"), links, found.where("kind = 'edge'").select("a", "b"), roots)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the rows with the smallest doc_id the first by hash.
    Rows without words all stay, those of null or empty text too.

    Needs ``doc_id`` (read as a long; null counts as the largest) and ``text``; other columns are kept, whatever their names. Rows that repeat
    doc_id and text leave one, whichever. No rows: no rows.
    """
    found = cut(near_duplicates(docs, roots=True), "near")
    grouped = found.where("node IS NOT NULL")
    # components of one row need no choice
    linked = grouped.where("n_links > 0").groupBy("root").agg(F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)), "row")).alias("r")).select(F.col("r.row").alias("row"))
    row, nth = fresh(docs, "near_row"), fresh(docs, "near_nth")
    kept = linked.union(grouped.where("n_links = 0").select("row")).select(F.col("row").alias(row))
    words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    got = docs.where(words).withColumn(row, F.xxhash64("doc_id", "text"))
    got = _few(got, repeated(grouped), row).join(kept, row, "left_semi")
    got = got.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(row))).where(F.col(nth) == 1)
    return got.select(docs.columns).union(docs.where(~words))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < {WORDS} THEN w ELSE w[i:i + {WORDS - 1}] END, ' ') AS s
  FROM w, generate_series(1, greatest(len(w) - {WORDS - 1}, 1)) AS g(i) WHERE len(w) > 0 AND i <= greatest(len(w) - {WORDS - 1}, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, c / (na.n + nb.n - c) AS j FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= {SIMILAR} * (na.n + nb.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE a = d.doc_id AND j = 1), d.doc_id)) AS class_id,
  (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links, (SELECT min(b) FROM r WHERE a = d.doc_id) AS component_id,
  d.doc_id = (SELECT min(b) FROM r WHERE a = d.doc_id) AS kept
FROM documents d
"""
