"""Search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import search as S
from tidemark.operators import search_index as X
from tidemark.sources.revisions import shared_path

from .binding import ITEMS_SQL, items, query, read


def _field_sql(field: str, words: str, full: int) -> str:
    return f"CASE WHEN NOT contains(g_{field}, '{words.replace(' ', '')}') THEN 0 WHEN contains(f_{field}, '{words}') THEN {full} ELSE {int(full * S.COMPACT_SHARE + 0.5)} END"


def search_sql(q: str, fields: dict[str, str]) -> str:
    """The oracle's form of ``operators.search.score`` for a query and field expressions."""
    words = q.lower().split()
    norm = lambda e: f"trim(regexp_replace(lower({e}), '[^0-9a-z가-힣]+', ' ', 'g'))"
    best = lambda w, k: "greatest(" + ", ".join(_field_sql(f, w, S.WEIGHTS[f][k]) for f in fields) + ")"
    per = [best(w, 1) for w in words]
    hits = " + ".join(f"(CASE WHEN {p} > 0 THEN 1 ELSE 0 END)" for p in per)
    total = " + ".join(per + ([best(" ".join(words), 0)] if len(words) > 1 else []))
    f = ", ".join(f"{norm(e)} AS f_{k}, replace({norm(e)}, ' ', '') AS g_{k}" for k, e in fields.items())
    return f"WITH {ITEMS_SQL}, f AS (SELECT *, {f} FROM items), s AS (SELECT id, lang, CASE WHEN {hits} > 0 THEN {total} + CASE WHEN {hits} = {len(words)} THEN {S.ALL_WORDS * len(words)} ELSE 0 END ELSE 0 END AS score FROM f)"


FIELDS = {"title": "title", "category": "lang", "source": "source"}


def found(spark, d, q):
    rows = items(spark, d).select("id", "title", F.col("lang").alias("category"), "source", "lang")
    # the texts are in composed form already, so folding would change nothing
    return S.score(rows, q, compatible=False)


@query("search_scores", search_sql("the en src1", FIELDS) + " SELECT id, CAST(score AS BIGINT) AS score FROM s")
def search_scores(spark, d):
    return found(spark, d, "the en src1").select("id", F.col("score").cast("long").alias("score"))


@query("search_ranked", search_sql("the de", FIELDS) + " SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 51")
def search_ranked(spark, d):
    """One ranked page: score, top-k, and of those what scored at all (what did not ranks last)."""
    scored = found(spark, d, "the de").select("id", F.col("score").cast("long").alias("score"))
    return S.page(scored, [F.col("score").desc(), F.col("id").desc()], 0, 50).where("score > 0")


@query("search_folded")
def search_folded(spark, d):
    """As ``search_scores`` with compatibility folding of Unicode, in Arrow batches."""
    rows = items(spark, d).select("id", "title", F.col("lang").alias("category"), "source")
    return S.score(rows, "ｔｈｅ EN").where("score > 0").select("id", "score")


@query("feed", f"WITH {ITEMS_SQL} SELECT id FROM items WHERE lang = 'en' AND (source IN ('src1', 'src5') OR id % 10 = 3) ORDER BY id DESC LIMIT 100")
def feed(spark, d):
    """A personal feed: subscribed sources or organizations in scope, within filters, newest first."""
    return items(spark, d).where((F.col("lang") == "en") & (F.col("source").isin("src1", "src5") | (F.col("id") % 10 == 3))).select("id").orderBy(F.col("id").desc()).limit(100)


#: the five fields: title, organizations (nations that own the item), the language's label, the source, and alias rules
LABELS = {"en": "English notices", "de": "Deutsche Hinweise", "fr": "Avis (français)", "es": "Avisos"}
ALIASES = [("src1", ["main board", "central"]), ("algeria", ["north office"]), ("erth", ["earth desk"]), ("hinweise", ["german desk"])]
#: queries: text, place of the page, filters
ASKED = [
    ("the en src1", 0, {}), ("erthat north office", 0, {}), ("notices", 20, {}), ("and of", 0, {"organization": ["KENYA", "PERU"]}), ("earth desk", 0, {}), ("s", 0, {"source": ["src2"]}),
]
LIMIT = 20


def entries(spark, d):
    """Items as the index has them."""
    names = F.broadcast(read(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("names")))  # 25 nations
    own = lambda k: F.element_at("names", F.pmod(k, F.lit(25)).cast(names.schema["names"].dataType.keyType))
    i = items(spark, d).crossJoin(names)
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("lang")]
    more = F.when(F.col("id") % 3 == 0, F.array(own(F.col("id")), own(F.col("id") * 7))).otherwise(F.array(own(F.col("id"))))
    return i.select("id", (-F.col("id")).alias("key"), "title", more.alias("organization"), label.alias("category"), "source")


def _served_sql() -> str:
    norm = lambda e: f"trim(regexp_replace(lower({e}), '[^0-9a-z가-힣]+', ' ', 'g'))"
    label = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
    part = lambda f, w, full: f"CASE WHEN NOT contains(replace({f}, ' ', ''), '{w.replace(' ', '')}') THEN 0 WHEN contains({f}, '{w}') THEN {full} ELSE {int(full * S.COMPACT_SHARE + 0.5)} END"
    rules = [("".join(S.prepare_query(m)), " ".join(S.prepare_query(" ".join(n)))) for m, n in ALIASES]

    def best(w: str, k: int) -> str:
        full = {f: x[k] for f, x in S.WEIGHTS.items()}
        alias = [f"CASE WHEN list_contains(rules, {i}) THEN {part(repr(n), w, full['alias'])} ELSE 0 END" for i, (_, n) in enumerate(rules)]
        return f"greatest({part('title', w, full['title'])}, list_max(list_transform(orgs, lambda o: {part('o', w, full['organization'])})), {part('category', w, full['category'])}, {part('source', w, full['source'])}, {', '.join(alias)})"

    called = ", ".join(f"CASE WHEN contains(replace(title, ' ', ''), '{m}') OR contains(replace(category, ' ', ''), '{m}') OR contains(replace(source, ' ', ''), '{m}') OR len(list_filter(orgs, lambda o: contains(replace(o, ' ', ''), '{m}'))) > 0 THEN {i} END" for i, (m, _) in enumerate(rules))
    out = []
    for n, (q, start, only) in enumerate(ASKED):
        words = S.prepare_query(q)
        if not words:
            continue
        per = [best(w, 1) for w in words]
        total = " + ".join(per + ([best(" ".join(words), 0)] if len(words) > 1 else []))
        hits = " + ".join(f"(CASE WHEN {p} > 0 THEN 1 ELSE 0 END)" for p in per)
        names = {"category": "raw_category IN ({})", "source": "raw_source IN ({})", "organization": "list_has_any(raw_orgs, [{}])"}
        where = " AND ".join(names[f].format(", ".join(map(repr, ok))) for f, ok in only.items()) or "true"
        score = f"CASE WHEN {hits} > 0 THEN {total} + CASE WHEN {hits} = {len(words)} THEN {S.ALL_WORDS * len(words)} ELSE 0 END ELSE 0 END"
        out.append(f"SELECT {n} AS query, position, id, score FROM (SELECT id, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, id DESC) - 1 AS position FROM (SELECT id, {score} AS score FROM f WHERE {where}) WHERE score > 0) WHERE position >= {start} AND position < {start + LIMIT}")
    return f"""WITH {ITEMS_SQL}, o AS (SELECT id, title, source, {label} AS category, CASE WHEN id % 3 = 0 THEN [id % 25, id * 7 % 25] ELSE [id % 25] END AS own FROM items),
m AS (SELECT o.id, list(n_name) AS raw_orgs FROM o, (SELECT id, unnest(own) AS k FROM o) u JOIN nation ON n_nationkey = k WHERE u.id = o.id GROUP BY o.id),
e AS (SELECT o.id, {norm("coalesce(title, '')")} AS title, {norm("coalesce(category, '')")} AS category, {norm("coalesce(source, '')")} AS source, list_transform(raw_orgs, lambda x: {norm("x")}) AS orgs, category AS raw_category, source AS raw_source, raw_orgs FROM o JOIN m ON o.id = m.id),
f AS (SELECT *, list_filter([{called}], lambda x: x IS NOT NULL) AS rules FROM e)
""" + "\nUNION ALL ".join(out)


@query("search_served", _served_sql())
def search_served(spark, d):
    """Pages of a set of queries from the trigram index; a later page by its cursor."""
    index = X.build(entries(spark, d), ALIASES, shared_path(spark, "search"), "r1", compatible=False)
    out = None
    for n, (q, start, only) in enumerate(ASKED):
        rows = X.search(index, q, LIMIT, X.cursor(start, "r1") if start else None, **only).rows
        rows = rows.select(F.lit(n).alias("query"), "position", "id", "score")
        out = rows if out is None else out.union(rows)
    return out
