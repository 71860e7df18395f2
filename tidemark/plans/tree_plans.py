"""Organization trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drawn_tree as D
from tidemark.operators import hierarchy as H
from tidemark.operators.spread import settled

from .binding import NODES_SQL, nodes, query, read

CLOSURE = NODES_SQL + """, c AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM nodes
  UNION ALL SELECT c.ancestor, n.id, c.depth + 1 FROM c JOIN nodes n ON n.parent = c.descendant WHERE c.depth < 12)"""


@query("tree_closure", f"WITH RECURSIVE {CLOSURE} SELECT ancestor, descendant, depth FROM c")
def tree_closure(spark, d):
    return H.closure(nodes(spark, d).select("id", "parent"))


@query("tree_scope", f"WITH RECURSIVE {CLOSURE} SELECT descendant AS id FROM c WHERE ancestor IN ('n3', 'c7') UNION SELECT ancestor FROM c WHERE descendant IN ('n3', 'c7')")
def tree_scope(spark, d):
    return H.scope(nodes(spark, d).select("id", "parent"), spark.createDataFrame([("n3",), ("c7",)], "id string"))


@query("tree_paths", f"WITH RECURSIVE {CLOSURE} SELECT descendant AS id, string_agg(name, ' / ' ORDER BY depth DESC) AS path FROM c JOIN nodes ON id = ancestor GROUP BY descendant")
def tree_paths(spark, d):
    return H.paths(nodes(spark, d).select("id", "parent", "name"))


@query("tree_aliases", f"WITH RECURSIVE {CLOSURE}, r AS (SELECT descendant, min_by(ancestor, depth) AS drawn FROM c JOIN nodes ON id = ancestor WHERE NOT is_alias GROUP BY descendant) SELECT id, coalesce(drawn, id) AS drawn_id FROM nodes LEFT JOIN r ON descendant = id")
def tree_aliases(spark, d):
    return H.drawn(nodes(spark, d))


@query("tree_cycles", "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 23 = 8")
def tree_cycles(spark, d):
    """The node table with a ring among the customers: one in 23 has the next such one as its parent, the last the first."""
    k = F.col("_k")
    n = nodes(spark, d).select("id", "parent").withColumn("_k", F.expr("CASE WHEN id LIKE 'c%' THEN CAST(substring(id, 2) AS BIGINT) END"))
    most = n.agg(F.max(F.when(k % 23 == 8, k))).first()[0]
    up = F.concat(F.lit("c"), F.when(k == most, F.lit(8).cast("long")).otherwise(k + 23).cast("string"))
    return H.cyclic(n.select("id", F.when(k % 23 == 8, up).otherwise(F.col("parent")).alias("parent")))


@query("tree_counts", f"WITH RECURSIVE {CLOSURE} SELECT ancestor AS node, count(DISTINCT o_orderkey) AS notices FROM c JOIN orders ON descendant = 'c' || o_custkey GROUP BY ancestor")
def tree_counts(spark, d):
    """Notices per node, each once however many of its audiences lie below. Orders are counted per leaf first."""
    leaf = read(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("descendant")).agg(F.count_distinct("o_orderkey").alias("n"))
    c = H.closure(nodes(spark, d).select("id", "parent"))
    return c.join(leaf, "descendant").groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("notices"))


@query("tree_children", "SELECT n_regionkey AS parent, count(*) AS children, count(*) FILTER (n_nationkey % 5 <> 0) AS own, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def tree_children(spark, d):
    return read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.count("*").alias("children"), F.count_if(F.col("n_nationkey") % 5 != 0).alias("own"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("name_or_alias", """SELECT word, min_by(id, rank) AS id FROM (SELECT n_name AS word, n_nationkey AS id, 0 AS rank FROM nation UNION ALL SELECT substr(n_name, 1, 4), n_nationkey, 1 + n_nationkey FROM nation) GROUP BY word""")
def name_or_alias(spark, d):
    """Names and short names to ids; an exact name comes before any short one."""
    n = read(spark, d, "nation")
    every = n.select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("id"), F.lit(0).alias("rank")).union(n.select(F.substring("n_name", 1, 4), "n_nationkey", 1 + F.col("n_nationkey")))
    return every.groupBy("word").agg(F.min_by("id", "rank").alias("id"))


#: selections: picked ids, the campus one is at, a keyword, whether empty organizations are shown
VIEWS = [(["c8", "n7"], "A", "", False), ([], "B", "", True), ([], None, "customer#00000000", False), (["r2"], None, "", False)]


def organizations(spark, d: str):
    """The node table as organizations: regions belong to one, both or none of two campuses, some nations are colleges, customers with a balance
    have a board."""
    k = F.expr("CAST(substring(id, 2) AS BIGINT)")
    n = nodes(spark, d).withColumn("k", k).withColumn("t", F.substring("id", 1, 1))
    active = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_acctbal") > 8000).cast("long").alias("active"))
    kind = F.when((F.col("t") == "n") & (F.col("k") % 4 == 0), "college").when(F.col("t") == "c", "department").otherwise("office")
    own = F.filter(F.array(F.when(F.col("k") % 2 == 0, "A"), F.when(F.col("k") % 3 == 0, "B")), lambda c: c.isNotNull())
    n = n.join(active, "id", "left").select("id", "parent", "name", "is_alias", kind.alias("kind"), F.when(F.col("t") == "r", own).alias("campuses"), F.coalesce("active", F.lit(0)).alias("active"))
    return n


def _view_sql(i: int, view: tuple) -> str:
    picked, campus, word, empty = view
    chosen = f"list_contains([{', '.join(map(repr, picked))}]::VARCHAR[], id)"
    own = f"contains(lower(name), {word!r})" if word else f"({chosen} OR kind = 'college' OR {str(empty).lower()} OR active > 0)"
    return f"""k{i} AS (SELECT *, id IS NOT NULL AND {chosen} AS chosen FROM tree t WHERE kind = 'root' OR EXISTS (SELECT 1 FROM tree b WHERE list_contains(b.path, t.key) AND b.id IS NOT NULL AND ({own.replace("name", "b.name").replace("kind", "b.kind").replace("active", "b.active").replace(" id)", " b.id)")}))),
w{i} AS (SELECT DISTINCT unnest(path) AS key FROM tree WHERE id IS NOT NULL AND {chosen}),
o{i} AS (SELECT *, {str(bool(word)).lower()} OR kind = 'root' OR key = 'campus:{campus}' OR key IN (SELECT key FROM w{i}) AS is_open, EXISTS (SELECT 1 FROM k{i} c WHERE c.path[-2] = k.key) AS has_children,
  EXISTS (SELECT 1 FROM k{i} c WHERE c.path[-2] = k.key AND c.grp = 'college') AND EXISTS (SELECT 1 FROM k{i} c WHERE c.path[-2] = k.key AND c.grp = 'other') AS both_ FROM k{i} k),
s{i} AS (SELECT *, EXISTS (SELECT 1 FROM o{i} a WHERE a.key <> o.key AND list_contains(o.path, a.key) AND a.chosen) AS covered FROM o{i} o WHERE NOT EXISTS (SELECT 1 FROM o{i} a WHERE a.key <> o.key AND list_contains(o.path, a.key) AND NOT a.is_open)),
v{i} AS (SELECT 'node' AS type, key, place, depth, name, has_children, is_open AND has_children AS open, covered FROM s{i} UNION ALL SELECT 'caption', key || '#' || g, place || chr(1) || CASE g WHEN 'college' THEN '0|' ELSE '1|' END, depth + 1, g, false, false, false FROM s{i}, (SELECT unnest(['college', 'other']) AS g) WHERE kind IN ('campus', 'other') AND is_open AND both_)"""


@query("tree_visible", f"""WITH RECURSIVE {NODES_SQL}, n AS (SELECT nodes.*, CAST(substr(id, 2) AS BIGINT) AS k, substr(id, 1, 1) AS t FROM nodes),
a AS (SELECT n.id, n.parent, n.name, n.is_alias, CASE WHEN t = 'n' AND k % 4 = 0 THEN 'college' WHEN t = 'c' THEN 'department' ELSE 'office' END AS kind, CASE WHEN t = 'r' THEN list_filter([CASE WHEN k % 2 = 0 THEN 'A' END, CASE WHEN k % 3 = 0 THEN 'B' END], lambda c: c IS NOT NULL) END AS campuses, CASE WHEN c_acctbal > 8000 THEN 1 ELSE 0 END AS active FROM n LEFT JOIN customer ON t = 'c' AND c_custkey = k),
dr AS (SELECT x.id, CASE WHEN NOT x.is_alias THEN x.id WHEN NOT p.is_alias THEN p.id ELSE coalesce(q.id, p.id) END AS d FROM a x LEFT JOIN a p ON x.parent = p.id LEFT JOIN a q ON p.parent = q.id),
b AS (SELECT d AS id, CAST(sum(active) AS BIGINT) AS active FROM dr JOIN a USING (id) GROUP BY 1),
z AS (SELECT a.id, up.d AS up, name, kind, campuses, b.active, CASE WHEN kind = 'college' THEN 0 ELSE 1 END || '|' || name || '|' || a.id AS part FROM a JOIN dr ON dr.id = a.id AND dr.d = a.id JOIN b ON b.id = a.id LEFT JOIN dr up ON up.id = a.parent),
bucket AS (SELECT * FROM (VALUES ('campus:A', 'A', 'root' || chr(1) || '0000', 'campus'), ('campus:B', 'B', 'root' || chr(1) || '0001', 'campus'), ('other', 'other', 'root' || chr(1) || '0002', 'other')) AS v(key, name, place, kind)),
base AS (SELECT 'root' AS key, ['root'] AS path, 'root' AS place, 0 AS depth, 'root' AS kind, CAST(NULL AS VARCHAR) AS id, 'root' AS name, CAST(NULL AS VARCHAR) AS grp, 0::BIGINT AS active
  UNION ALL SELECT key, ['root', key], place, 1, kind, NULL, name, NULL, 0::BIGINT FROM bucket UNION ALL SELECT bucket.key || '/' || id, ['root', bucket.key, bucket.key || '/' || id], bucket.place || chr(1) || part, 2, z.kind, id, z.name, CASE WHEN z.kind = 'college' THEN 'college' ELSE 'other' END, z.active
    FROM z JOIN bucket ON list_contains(campuses, bucket.name) OR (bucket.name = 'other' AND len(coalesce(campuses, [])) = 0) WHERE up IS NULL),
tree AS (SELECT * FROM base
  UNION ALL SELECT t.key || '/' || z.id, list_append(t.path, t.key || '/' || z.id), t.place || chr(1) || z.part, t.depth + 1, z.kind, z.id, z.name, NULL, z.active FROM tree t JOIN z ON z.up = t.id),
{(","+chr(10)).join(_view_sql(i, v) for i, v in enumerate(VIEWS))}
{" UNION ALL ".join(f"SELECT {i} AS view, row_number() OVER (ORDER BY place) - 1 AS position, type, key, depth, name, has_children, open, covered FROM v{i}" for i in range(len(VIEWS)))}""")
def tree_visible(spark, d):
    """The rows of the picker for several selections, in order."""
    rows, out = settled(D.tree(organizations(spark, d), ["A", "B"])), None
    for i, (picked, campus, word, empty) in enumerate(VIEWS):
        seen = D.visible(rows, spark.createDataFrame([(x,) for x in picked], "id string"), campus, word, empty)
        seen = seen.select(F.lit(i).alias("view"), "*")
        out = seen if out is None else out.union(seen)
    return out
