"""Vector code compression: product codes whose codebooks come from Hamerly's form of Lloyd's iteration, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, spread_join, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: entries become floor(SCALE * x)
SCALE = 256
#: entries from here on (as scaled) are not told apart by doubles
LARGEST = 2.0**52
#: components up to here: squared distances of parts fit in longs, else Python's own numbers are used
SMALL = 1 << 20


def integers(vectors: DataFrame, embedding: str = "embedding", name: str = "x") -> DataFrame:
    """``vectors`` with ``name``, the embedding's entries as longs floor(256 x). Rows go whose vector is null, empty, holds null or
    non-finite entries, or entries beyond 2^52 / 256, for which there is no such number in double precision."""
    e = F.col(embedding).cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    return vectors.where(F.coalesce(good, F.lit(False))).withColumn(name, F.transform(e, lambda c: F.floor(c * SCALE)))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exactly: longs, or Python's own numbers where those would not do."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) > SMALL:
        x, y = x.astype(object), y.astype(object)
    return ((x - y) ** 2).sum(axis=-1)


def above(d: np.ndarray) -> np.ndarray:
    """The root of whole numbers, rounded up to a float of 32 bits."""
    return np.nextafter(np.sqrt(d.astype(float)).astype(np.float32), np.float32(np.inf))


def below(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(d.astype(float)).astype(np.float32), np.float32(-np.inf)), 0)


class Codebook:
    """The entries of one part position (entries by width), and what bounds need: how far each entry has come from ``before``, and half the
    distance to its nearest other entry."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        moved = above(squared(entries, before)) if before is not None else np.zeros(len(entries), dtype=np.float32)
        moved = np.where((entries == before).all(axis=1), 0, moved).astype(np.float32) if before is not None else moved
        self.moved = moved
        # the farthest move of an entry other than each
        order = np.argsort(-moved, kind="stable")
        self.others = np.where(np.arange(len(moved)) == order[0], moved[order[1]] if len(moved) > 1 else 0, moved[order[0]])
        apart = squared(entries[:, None], entries[None, :]).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = below(apart.min(axis=1) / 4)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower index), an upper bound of its distance, a lower bound of the second-nearest's."""
        d = squared(x[:, None], self.entries[None, :])
        code = d.argmin(axis=1) if d.dtype != object else np.array([int(np.argmin(r)) for r in d], dtype=np.int64)
        rows = np.arange(len(x))
        nearest = d[rows, code].copy()
        if d.shape[1] == 1:
            return code, above(nearest), np.full(len(x), np.float32(np.inf))
        d = d.astype(float)
        d[rows, code] = np.inf
        return code, above(nearest), below(d.min(axis=1))

    def update(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes and bounds after the entries have moved, and how many parts were scanned: only those whose upper bound,
        made exact first, is not strictly below both the second-nearest's and half the way to the next entry. A tie fails
        that, so that the lower index wins it by the scan."""
        code, up = code.copy(), np.float32(np.inf)
        upper = np.nextafter(upper + self.moved[code], up)
        lower = np.maximum(np.nextafter(lower - self.others[code], -up), 0)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[code]))
        upper[open_] = above(squared(x[open_], self.entries[code[open_]]))
        open_ = open_[upper[open_] >= np.maximum(lower[open_], self.half[code[open_]])]
        if len(open_):
            code[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return code, upper, lower, len(open_)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length each and their parts, few enough that their distances to all entries take some MB."""
    sizes = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = batch.take(pa.array(np.flatnonzero(sizes == d)))
        for s in range(0, len(rows), 1024):
            part = rows.slice(s, 1024)
            yield part, part.column("x").flatten().to_numpy().reshape(len(part), PARTS, -1)


def _packed(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], type=pa.binary())


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), PARTS)


def _assigned(rows: DataFrame, books: dict[int, list[Codebook]], last: bool = False) -> DataFrame:
    """``rows`` (``x`` and, after the first round, the state) with the state; at the end with ``code`` and ``far``, the exact squared
    distance. ``scans`` counts the parts that were compared with all entries, in the first row of each block."""
    kept = [f for f in rows.schema if f.name not in ("code", "upper", "lower", "scans") and not (last and f.name == "x")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code binary, " + ("far long" if last else "upper binary, lower binary, scans int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch):
                book, scans = books[x.shape[1] * x.shape[2]], 0
                started = "code" in part.schema.names
                if started:
                    code, upper, lower = _unpacked(part.column("code"), np.uint8).astype(np.int64), _unpacked(part.column("upper"), np.float32).copy(), _unpacked(part.column("lower"), np.float32).copy()
                else:
                    code, upper, lower = np.empty((len(x), PARTS), np.int64), np.empty((len(x), PARTS), np.float32), np.empty((len(x), PARTS), np.float32)
                for p in range(PARTS):
                    if started:
                        code[:, p], upper[:, p], lower[:, p], k = book[p].update(x[:, p], code[:, p], upper[:, p], lower[:, p])
                    else:
                        code[:, p], upper[:, p], lower[:, p] = book[p].scan(x[:, p])
                        k = len(x)
                    scans += k
                out = [part.column(f.name) for f in kept] + [_packed(code.astype(np.uint8))]
                if last:
                    far = sum(squared(x[:, p], book[p].entries[code[:, p]]).astype(object) for p in range(PARTS))
                    more = {"far": pa.array([int(v) if v < 1 << 63 else None for v in far], type=pa.int64())}
                else:
                    more = {"upper": _packed(upper), "lower": _packed(lower), "scans": pa.array(np.where(np.arange(len(x)) == 0, scans, 0).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([*out, *more.values()], names=[*(f.name for f in kept), "code", *more])

    return rows.mapInArrow(run, schema)


def _totals(state: DataFrame) -> DataFrame:
    """Per length, part, entry and place within it, how many parts are assigned and their sum: summed within each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for part, x in _blocks(batch):
                d, w = x.shape[1] * x.shape[2], x.shape[2]
                # whole numbers in two halves, so that sums are exact
                n, high, low = found.setdefault(d, [np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, w), np.int64), np.zeros((PARTS, ENTRIES, w), np.int64)])
                at = (np.broadcast_to(np.arange(PARTS), (len(x), PARTS)), _unpacked(part.column("code"), np.uint8).astype(np.int64))
                np.add.at(n, at, 1)
                np.add.at(high, at, x >> 26)
                np.add.at(low, at, x & (1 << 26) - 1)
        for d, (n, high, low) in found.items():
            p, e = np.nonzero(n)
            w = high.shape[2]
            places = {"part": np.repeat(p, w), "entry": np.repeat(e, w), "at": np.tile(np.arange(w), len(p))}
            yield pa.RecordBatch.from_pydict({"dims": pa.array(np.full(len(p) * w, d, np.int32)), **{k: pa.array(v.astype(np.int32)) for k, v in places.items()}, "n": np.repeat(n[p, e], w), "high": high[p, e].ravel(), "low": low[p, e].ravel()})

    found = state.select("x", "code").mapInArrow(add, "dims int, part int, entry int, at int, n long, high long, low long")
    whole = f"sum(CAST(high AS DECIMAL(38,0)) * {1 << 26}BD + low)"
    return found.groupBy("dims", "part", "entry", "at").agg(F.sum("n").alias("n"), F.expr(whole).cast("decimal(38,0)").alias("s"))


class Codes:
    """What ``compress`` gives: ``rows`` (all columns of the vectors but the embedding, the code as ``code_column`` and its error as ``error_column``), ``books`` by length of
    vector, and ``scans``, how many parts each round scanned in full after the first."""

    def __init__(self, rows: DataFrame, books: dict[int, list[Codebook]], code: str, error: str, states: list[DataFrame]):
        self.rows, self.books, self.code_column, self.error_column, self.states = rows, books, code, error, states

    def sha256(self) -> str:
        """Hex digest of all entries' components as decimal numbers joined by ``,``: by length of vector, part, entry and place."""
        every = (str(int(c)) for d in sorted(self.books) for b in self.books[d] for c in b.entries.ravel())
        return hashlib.sha256(",".join(every).encode()).hexdigest()

    def scans(self) -> list[int]:
        return [s.agg(F.sum("scans")).first()[0] or 0 for s in self.states]


def compress(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", rounds: int = ROUNDS) -> Codes:
    """Product codes of ``vectors``: 16 equal parts, each by its nearest of at most 64 entries of its position's codebook.

    Codebooks start as the parts of the 64 vectors of smallest ``key`` (nulls last, then by the vector itself; fewer vectors: fewer
    entries). A round assigns every part to its nearest entry (exact squared distance, ties to the lower index) and moves each
    entry to the floor of its parts' mean; entries without parts stay. Then parts are assigned once more. Each round's
    codes and bounds are written beside the vectors, so a part is compared with all entries again only where its bounds fail;
    of each task the driver's aggregation gets a sum per entry, of all tasks the driver a codebook.

    Rows that are null, not finite or too large go (see ``integers``), as do vectors whose length is no multiple of 16: they have no equal parts.
    Vectors of each length have codebooks of their own. Repeated rows count each. Errors that are no long are null.
    No vectors: no rows.
    """
    code, error = fresh(vectors, "code"), fresh(vectors, "error")
    # columns travel by number, so that their names cannot clash with the state's
    own = {c: f"c{i}" for i, c in enumerate(vectors.columns) if c != embedding}
    rows = integers(vectors, embedding, "\u0001x").select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col("\u0001x").alias("x"))
    key = own[key]
    rows = rows.where(F.size("x") % PARTS == 0)
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().collect()]
    books: dict[int, list[Codebook]] = {}
    for d in lengths:
        first = rows.where(F.size("x") == d).select(key, "x").orderBy(F.col(key).asc_nulls_last(), "x").limit(ENTRIES).collect()
        start = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), PARTS, -1)
        books[d] = [Codebook(start[:, p]) for p in range(PARTS)]
    state, states = rows, []
    for k in range(rounds):
        state = cut(_assigned(state, books), f"codes-{k}")
        states.append(state)
        sums: dict[int, dict] = {}
        for r in _totals(state).collect():  # at most as many as the codebooks' components
            sums.setdefault(r.dims, {})[r.part, r.entry, r["at"]] = int(r.s) // r.n
        for d, found in sums.items():
            new = []
            for p, book in enumerate(books[d]):
                entries = book.entries.copy()
                for (q, e, at), v in found.items():
                    if q == p:
                        entries[e, at] = v
                new.append(Codebook(entries, book.entries))
            books[d] = new
    done = _assigned(state, books, last=True)
    return Codes(done.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("code").alias(code), F.col("far").alias(error)), books, code, error, states)


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Errors are summed per label (nulls are one label), and the sums are sent back to rows dealt by a salt where a label has many."""
    got = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = got.rows.select("vec_id", F.lower(F.hex(got.code_column)).alias("code"), F.col(got.error_column).alias("error"), F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("of"))
    rows = cut(rows, "codes")
    by_label = rows.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return spread_join(rows, "of", "vec_id", by_label).select("vec_id", "code", "error", "label_error", F.lit(got.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd's rounds in plain SQL, every part against every entry."""
    assign = """a{k} AS (SELECT id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT p.id, p.part, c.entry, CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM p JOIN c{k} c ON p.part = c.part) GROUP BY id, part)"""
    update = """m{k} AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (SELECT a.part, a.best.entry AS entry, pos, CAST(floor(sum(p.x[pos + 1]) / count(*)) AS BIGINT) AS m FROM a{k} a JOIN p ON a.id = p.id AND a.part = p.part, (SELECT unnest(range({w})) AS pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{n} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)"""
    w = 4  # the table's vectors have 64 entries
    steps = [assign.format(k=0), update.format(k=0, n=1, w=w), assign.format(k=1), update.format(k=1, n=2, w=w), assign.format(k=2)]
    return f"""
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT id, part, x[part * {w} + 1 : part * {w} + {w}] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, entry, x FROM p JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM v) USING (id) WHERE entry < {ENTRIES}),
{(","+chr(10)).join(steps)},
r AS (SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY id)
SELECT r.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM r JOIN v ON r.id = v.id
"""


OP12_SQL = _sql()
