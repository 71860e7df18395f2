"""Embedding near-dedup: cover trees and their dual traversal."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labels_of, linked_rows, table

SIMILAR = 0.9
#: classes in one block, and the pivots that blocks are formed around at most
BLOCK, PIVOTS = 4096, 64
#: radius of the nets below the root, halved at each level, and the number of levels. Wider nets prune nothing
#: among many dimensions, where points that have nothing in common lie about 1.4 apart.
TOP, LEVELS = 0.5, 4
#: blocks of one tile; two tiles' blocks meet in one task
TILE = 4
#: pairs of nodes or points whose distances are taken at once
PAIRS = 100_000


def _near(similar: float) -> float:
    """The distance of unit vectors at that cosine."""
    return float(np.sqrt(2 - 2 * similar))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Vectors as given, whatever their width, to unit length in double precision. Each is scaled by its largest entry first, so that
    no norm of a finite vector vanishes or overflows."""
    x = raw.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class CoverTree:
    """Nested nets of points on the unit sphere.

    The children of a node are a greedy net of its points: no two closer than the level's
    radius, every point within it of its child's centre, and the node's own centre first
    (nesting). A tree travels with its vectors as they were given and makes them unit length again. Points are reordered so that each node is a range ``lo..hi``; ``reach`` is the
    true covering radius. A node of one point, or of the last level, is a leaf.
    """

    FIELDS = ("raw", "order", "centre", "reach", "lo", "hi", "first", "last")

    def __init__(self, raw: np.ndarray):
        points = _unit(raw)
        order, nodes = np.arange(len(points)), []
        # breadth first: (centre, lo, hi) of each node, children follow one another
        nodes.append([0, 0, len(points), 0, 0])
        at, level_end, level = 0, 1, 0
        while at < len(nodes):
            if at == level_end:
                level_end, level = len(nodes), level + 1
            centre, lo, hi, _, _ = nodes[at]
            if hi - lo > 1 and level < LEVELS:
                radius = TOP / 2**level
                ids = order[lo:hi]
                own, free = points[ids], np.ones(hi - lo, dtype=bool)
                # the node's centre leads its own range, so it is the first centre chosen
                k, chosen = 0, []
                while free[k]:
                    close = free & (own @ own[k] >= 1 - radius * radius / 2)
                    close[k] = True
                    # a centre comes before its members
                    chosen.append(np.concatenate([ids[k : k + 1], ids[k + 1 :][close[k + 1 :]]]))
                    free &= ~close
                    k += int(free[k:].argmax())
                order[lo:hi] = np.concatenate(chosen)
                nodes[at][3] = len(nodes)
                for members in chosen:
                    nodes.append([int(members[0]), lo, lo + len(members), 0, 0])
                    lo += len(members)
                nodes[at][4] = len(nodes)
            at += 1
        place = np.empty(len(points), dtype=np.int64)
        place[order] = np.arange(len(points))
        n = np.array(nodes, dtype=np.int64)
        self.raw, self.points, self.order = raw[order], points[order], order
        self.centre, self.lo, self.hi, self.first, self.last = place[n[:, 0]], n[:, 1], n[:, 2], n[:, 3], n[:, 4]
        self.reach = np.zeros(len(n))
        for k in np.flatnonzero(self.hi - self.lo > 1):
            self.reach[k] = np.sqrt(((self.points[self.lo[k] : self.hi[k]] - self.points[self.centre[k]]) ** 2).sum(axis=1).max())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as found:
            for f in cls.FIELDS:
                setattr(self, f, found[f])
        self.points = _unit(self.raw)
        return self


def _spread(lo: np.ndarray, hi: np.ndarray, *along: np.ndarray) -> tuple[np.ndarray, ...]:
    """All integers of the ranges ``lo..hi``, and the values that go along with each range."""
    size = hi - lo
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else lo
    return (np.arange(size.sum()) + start, *(np.repeat(x, size) for x in along))


def dual(a: CoverTree, b: CoverTree, similar: float = SIMILAR) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Pairs at ``similar`` or more between two trees' points, exactly: ``("nodes", i, j)`` for nodes all of whose
    points are linked, ``("points", i, j)`` for places in ``points``.

    A pair of nodes farther apart than the threshold and both covering radii is dropped; one that lies
    within the threshold with both radii is linked whole; else both are opened. Bounds keep
    a margin, and what they leave is decided by the cosine alone.
    """
    near, margin = _near(similar), 1e-9
    pairs = [(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while pairs:
        i, j = pairs.pop()
        d = np.sqrt(np.maximum(((a.points[a.centre[i]] - b.points[b.centre[j]]) ** 2).sum(axis=1), 0))
        keep = d <= near + a.reach[i] + b.reach[j] + margin
        i, j, d = i[keep], j[keep], d[keep]
        many = (a.hi[i] - a.lo[i] > 1) | (b.hi[j] - b.lo[j] > 1)
        whole = many & (d + a.reach[i] + b.reach[j] <= near - margin)
        if whole.any():
            yield "nodes", i[whole], j[whole]
        i, j = i[~whole], j[~whole]
        open_a, open_b = a.last[i] > 0, b.last[j] > 0
        done = ~open_a & ~open_b
        if done.any():
            x, hi, lo = _spread(a.lo[i[done]], a.hi[i[done]], b.hi[j[done]], b.lo[j[done]])
            y, x = _spread(lo, hi, x)
            for s in range(0, len(x), PAIRS):
                p, q = x[s : s + PAIRS], y[s : s + PAIRS]
                ok = np.einsum("ij,ij->i", a.points[p], b.points[q]) >= similar
                if ok.any():
                    yield "points", p[ok], q[ok]
        i, j, open_a, open_b = i[~done], j[~done], open_a[~done], open_b[~done]
        # children of the opened nodes; an unopened node stands for itself
        first_a, last_a = np.where(open_a, a.first[i], i), np.where(open_a, a.last[i], i + 1)
        first_b, last_b = np.where(open_b, b.first[j], j), np.where(open_b, b.last[j], j + 1)
        for fa, la, fb, lb in _portions(first_a, last_a, first_b, last_b):
            got = _children(a, b, fa, la, fb, lb, near + margin)
            for s in range(0, len(got[0]), PAIRS):
                pairs.append((got[0][s : s + PAIRS], got[1][s : s + PAIRS]))


def _portions(fa, la, fb, lb):
    """Few pairs at a time, wide ones by themselves."""
    size = (la - fa) * (lb - fb)
    start = 0
    while start < len(size):
        end = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), PAIRS)))
        yield fa[start:end], la[start:end], fb[start:end], lb[start:end]
        start = end


def _children(a, b, fa, la, fb, lb, near):
    """Pairs of children that are not too far apart."""
    if len(fa) == 1:  # many by many: cosines as products of matrices
        x, y = np.arange(fa[0], la[0]), np.arange(fb[0], lb[0])
        # nodes of like radius together, so that one bound cuts off almost all of a part
        x, y = x[np.argsort(a.reach[x], kind="stable")], y[np.argsort(b.reach[y], kind="stable")]
        left, right = [], []
        for s in range(0, len(x), 512):
            i = x[s : s + 512]
            for t in range(0, len(y), 512):
                j = y[t : t + 512]
                cos = a.points[a.centre[i]] @ b.points[b.centre[j]].T
                k, m = np.nonzero(cos >= 1 - (near + a.reach[i].max() + b.reach[j].max()) ** 2 / 2 - 1e-9)
                ok = 2 - 2 * cos[k, m] <= (near + a.reach[i[k]] + b.reach[j[m]]) ** 2 + 1e-9
                left.append(i[k[ok]])
                right.append(j[m[ok]])
        return np.concatenate(left), np.concatenate(right)
    x, lo, hi = _spread(fa, la, fb, lb)
    y, x = _spread(lo, hi, x)
    return x, y


def links_between(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, same: bool):
    """How many rows of the other block each point links with (both sides), and a spanning forest of the links as pairs of
    points, those of b numbered on from those of a (the same numbers, if the blocks are one)."""
    na, nb = len(a.points), len(b.points)
    count_a, count_b = np.zeros(na + 1, dtype=np.int64), np.zeros(nb + 1, dtype=np.int64)
    sum_a, sum_b = np.concatenate([[0], np.cumsum(weight_a)]), np.concatenate([[0], np.cumsum(weight_b)])
    one_a, one_b = np.zeros(na, dtype=np.int64), np.zeros(nb, dtype=np.int64)
    label, shift = np.arange(na if same else na + nb), 0 if same else na

    def join(x, y):
        nonlocal label
        if len(x):
            part = labels_of(len(label), label[x], label[y + shift])
            label = part[label]

    for kind, i, j in dual(a, b):
        if kind == "points":
            if same:
                i, j = i[i != j], j[i != j]
            np.add.at(one_a, i, weight_b[j])
            np.add.at(one_b, j, weight_a[i])
            join(i, j)
        else:
            got_a, got_b = sum_b[b.hi[j]] - sum_b[b.lo[j]], sum_a[a.hi[i]] - sum_a[a.lo[i]]
            np.add.at(count_a, a.lo[i], got_a)
            np.add.at(count_a, a.hi[i], -got_a)
            np.add.at(count_b, b.lo[j], got_b)
            np.add.at(count_b, b.hi[j], -got_b)
            if same and (own := i[i == j]).size:
                x, = _spread(a.lo[own], a.hi[own])
                one_a[x] -= weight_a[x]
            x, y = _spread(a.lo[i], a.hi[i], b.lo[j])
            join(x, y)
            y, x = _spread(b.lo[j], b.hi[j], a.lo[i])
            join(x, y)
    return one_a + np.cumsum(count_a)[:-1], one_b + np.cumsum(count_b)[:-1], label


FOUND = "kind string, a long, b long"


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` to one row per row: ``id, node, class_id, n_links, component_id``.

    Vectors are linked when their cosine, in double precision, is SIMILAR or more. Equal vectors are one
    class, which counts as many links as it has rows. Classes are dealt to blocks of about
    BLOCK around pivots (the first few by hash; a pivot with many classes gets several blocks), each
    block is made a cover tree once, and each pair of blocks that the blocks' own covering radii
    allow is traversed once. Blocks travel in tiles of TILE, two tiles' blocks to a task. A traversal
    gives a count per class and a spanning forest, not pairs. Vectors of floats stay floats until they are compared.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different lengths with each other. Repeated rows are rows of their own, linked
    with each other; ids may be null. In the worst case, data without any near neighbours, all pairs of blocks
    remain, and work and shuffle grow with the square of their number.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    good = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").alias("id"), F.when(good, e).alias("embedding")).withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    rows = cut(rows, "vectors")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("embedding").alias("v"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("dims", F.size("v")), "vector-classes")
    total = classes.count()
    first = classes.orderBy(F.hash("node"), "node").limit(max(1, min(PIVOTS, -(-total // BLOCK)))).collect()
    pivots: dict[int, np.ndarray] = {}
    for r in first:
        pivots.setdefault(len(r["v"]), []).append(_unit(np.array([r["v"]]))[0])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pivot = np.zeros(len(batch), dtype=np.int32)
            for dims in batch.dims.unique():
                if dims in pivots:
                    at = np.flatnonzero(batch.dims == dims)
                    x = _unit(np.stack(batch.v.iloc[at].to_numpy()))
                    pivot[at] = (x @ np.array(pivots[dims]).T).argmax(axis=1)
            yield batch.assign(pivot=pivot)

    dealt = cut(classes.mapInPandas(deal, f"node long, v array<{kind}>, n long, dims int, pivot int"), "vector-dealt")
    # one row per pivot and length of vector
    sizes = dealt.groupBy("dims", "pivot").count().withColumn("salts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    dealt = dealt.join(sizes, ["dims", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).drop("salts")

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node")
        t = CoverTree(np.stack(batch.v.to_numpy()))
        head = batch.iloc[0]
        return pd.DataFrame({"dims": [head.dims], "block": [f"{head.pivot:06d}/{head.salt:09d}"], "nodes": [batch.node.to_numpy()[t.order].tobytes()], "n": [batch.n.to_numpy()[t.order].tobytes()], "tree": [t.dump()], "centre": [t.points[t.centre[0]]], "reach": [t.reach[0]]})

    blocks = dealt.groupBy("dims", "pivot", "salt").applyInPandas(build, "dims int, block string, nodes binary, n binary, tree binary, centre array<double>, reach double")
    blocks = cut(blocks, "vector-blocks")
    # pairs of blocks that their bounds leave, by salts, so that no key has all of them; then tiles of blocks, which
    # are what travels: a block goes to a task once for all the blocks of a tile
    many = blocks.count()
    salts, tiles = 1 + many // 16, 1 + (many - 1) // TILE
    blocks = blocks.withColumn("tile", F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int"))
    bounds = blocks.select("dims", "block", "centre", "reach", "tile")
    l = bounds.withColumn("salt", F.pmod(F.xxhash64("block", F.lit(1)), F.lit(salts)).cast("int")).alias("l")
    r = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("r")
    apart = F.aggregate(F.zip_with("l.centre", "r.centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = l.join(r, (F.col("l.dims") == F.col("r.dims")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.block") <= F.col("r.block"))).where(F.sqrt(apart) <= F.lit(_near(SIMILAR) + 1e-9) + F.col("l.reach") + F.col("r.reach"))
    meet = pairs.select("l.dims", F.least("l.tile", "r.tile").alias("p"), F.greatest("l.tile", "r.tile").alias("q"), F.explode(F.array_distinct(F.array("l.block", "r.block"))).alias("block")).distinct()
    units = meet.join(blocks, ["dims", "block"])

    def traverse(unit: pd.DataFrame) -> pd.DataFrame:
        p, q = unit.p.iloc[0], unit.q.iloc[0]
        sides = [(r.tile, np.array(r.centre), r.reach, CoverTree.load(r.tree), np.frombuffer(r.nodes, np.int64), np.frombuffer(r.n, np.int64)) for r in unit.sort_values("block").itertuples()]
        out = [pd.DataFrame({"kind": pd.Series(dtype=str), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        for k, (tile_a, centre_a, reach_a, a, nodes_a, n_a) in enumerate(sides):
            for m, (tile_b, centre_b, reach_b, b, nodes_b, n_b) in enumerate(sides[k:], k):
                if {tile_a, tile_b} != {p, q} or np.linalg.norm(centre_a - centre_b) > _near(SIMILAR) + 1e-9 + reach_a + reach_b:
                    continue
                same = k == m
                count_a, count_b, label = links_between(a, b, n_a, n_b, same)
                nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
                count = count_a if same else np.concatenate([count_a, count_b])
                has, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
                out += [pd.DataFrame({"kind": "links", "a": nodes[has], "b": count[has]}), pd.DataFrame({"kind": "edge", "a": nodes[moved], "b": nodes[label[moved]]})]
        return pd.concat(out)

    found = cut(units.groupBy("dims", "p", "q").applyInPandas(traverse, FOUND), "vector-links")
    links = found.where("kind = 'links'").select(F.col("a").alias("node"), F.col("b").alias("n"))
    return linked_rows(rows.select("id", "node"), links, found.where("kind = 'edge'").select("a", "b"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    got = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {SIMILAR}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE a = vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM r WHERE a = vec_id) AS kept FROM embeddings
"""
