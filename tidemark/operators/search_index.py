"""Search as served: an inverted index of character trigrams, and a ranked page that opens only the postings that can still matter."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

from .search import ALL_WORDS, COMPACT_SHARE, WEIGHTS, prepare_query

#: folders of postings, by a gram's first character
BUCKETS = 64
NAMED = ("organization", "category", "source")


class StaleCursor(ValueError):
    """The list has another revision than the one that the cursor was made on."""


def cursor(offset: int, revision: str) -> str:
    return base64.b64encode(f"{revision}:i{offset}".encode()).decode()


def offset_of(at: str | None, revision: str) -> int:
    """The place that a cursor names; 0 without one. A cursor of another revision is an error, as places have moved."""
    if not at:
        return 0
    seen, _, raw = base64.b64decode(at).decode().rpartition(":")
    if seen != revision:
        raise StaleCursor(at)
    return int(raw.lstrip("i") or 0)


def grams(c: Column) -> Column:
    """The set of three-character runs of a text without blanks; two blanks end it, so that each character begins a run."""
    chars = F.split(F.concat(c, F.lit("  ")), "")
    runs = F.transform(F.array(chars), lambda t: F.when(F.size(t) > 2, F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.concat(t[i], t[i + 1], t[i + 2]))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(runs[0])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.ascii(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """Where an index lies and what revision it is of: ``entries(id, key, text, tight, cell)`` in files by cell, ``postings(gram, id)`` of titles in
    folders by first character, ``values(vid, field, name, text, tight)`` of names and alias rules, ``cells(cell, vids, n)``: which
    of those a group of entries carries."""

    spark: SparkSession
    path: str
    revision: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build(rows: DataFrame, aliases: list[tuple[str, list[str]]], path: str, revision: str, compatible: bool = True) -> Index:
    """Indexes ``rows(id, key, title, organization array, category, source)``; ``key`` orders entries of equal score, smallest first, and is unique.

    ``aliases``: where a field of an entry has ``match``, it is also found by the rule's names. Titles are indexed by entry, everything else by
    its few distinct names: an entry refers to them, and entries with the same ones form a cell. Null texts and names are empty.
    """
    spark, norm = rows.sparkSession, lambda c: T.search_text(F.coalesce(c, F.lit("")), compatible)
    names = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in NAMED[1:]), F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("name")))).alias("v")).select("v.*")
    names = names.unionByName(rows.select(F.lit(NAMED[0]).alias("field"), F.explode("organization").alias("name"))).where("name IS NOT NULL").distinct()
    rules = spark.createDataFrame([(prepare_query(m), " ".join(n)) for m, n in aliases], "parts array<string>, name string").select(F.lit("alias").alias("field"), "name", F.array_join("parts", "").alias("match")).where("match <> ''")
    values = names.withColumn("match", F.lit(None).cast("string")).unionByName(rules).withColumn("text", norm(F.col("name")))
    values = values.withColumns({"tight": T.compact(F.col("text")), "vid": F.xxhash64("field", "name", "match")})
    values.write.parquet(f"{path}/values")
    found = spark.read.parquet(f"{path}/values")
    matches = [(r.vid, r.match) for r in found.where("field = 'alias'").collect()]  # the rules, which were given as a list
    # rules that a name calls for by itself
    called = found.where("field <> 'alias'").select("vid", F.filter(F.array(*(F.when(F.contains("tight", F.lit(m)), F.lit(v)) for v, m in matches)).cast("array<long>"), lambda x: x.isNotNull()).alias("rules"))
    called = {r.vid: r.rules for r in called.where(F.size("rules") > 0).collect()} if matches else {}
    by_name = F.create_map(*(x for v, rs in called.items() for x in (F.lit(v), F.array(*map(F.lit, rs))))) if called else None
    e = rows.withColumn("text", norm(F.col("title"))).withColumn("tight", T.compact(F.col("text")))
    own = F.concat(F.transform(F.coalesce("organization", F.array().cast("array<string>")), lambda o: F.xxhash64(F.lit(NAMED[0]), o, F.lit(None).cast("string"))), F.array(*(F.xxhash64(F.lit(f), F.col(f), F.lit(None).cast("string")) for f in NAMED[1:])))
    e = e.withColumn("own", own)
    by_title = F.filter(F.array(*(F.when(F.contains("tight", F.lit(m)), F.lit(v)) for v, m in matches)).cast("array<long>"), lambda x: x.isNotNull())
    more = F.flatten(F.transform("own", lambda v: F.coalesce(F.element_at(by_name, v), F.array().cast("array<long>")))) if by_name is not None else F.array().cast("array<long>")
    e = e.withColumn("vids", F.array_sort(F.array_distinct(F.concat("own", by_title, more))))
    e = e.withColumn("cell", F.xxhash64("vids"))
    e.select("id", "key", "text", "tight", "cell", "vids").sortWithinPartitions("cell").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    entries.groupBy("cell").agg(F.first("vids").alias("vids"), F.count("*").alias("n")).write.parquet(f"{path}/cells")
    postings = entries.select("id", F.explode(grams(F.col("tight"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    entries.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/sizes")
    return Index(spark, path, revision)


def _worth(weight: int, text: Column, tight: Column, words: str) -> Column:
    return F.when(~F.contains(tight, F.lit(words.replace(" ", ""))), 0).when(F.contains(text, F.lit(words)), weight).otherwise(int(weight * COMPACT_SHARE + 0.5))


@dataclass
class Page:
    """A page of hits ``(position, id, score)``, the cursor of the next page or None, and what was read for it."""

    rows: DataFrame
    next_cursor: str | None
    read: dict[str, int] = field(default_factory=dict)


def _runs(word: str) -> list[str]:
    return sorted({word[i : i + 3] for i in range(len(word) - 2)})


def _posting_filter(word: str) -> Column:
    """Postings that a word needs: its runs, or, for a word of one or two characters, the runs that begin with it."""
    return F.col("gram").isin(_runs(word)) if _runs(word) else F.col("gram").startswith(word)


def search(index: Index, q: str, limit: int = 20, at: str | None = None, category: list[str] | None = None, source: list[str] | None = None, organization: list[str] | None = None) -> Page:
    """The page of ``limit`` hits from the cursor ``at`` on, by score and then by key, equal to scoring every entry.

    A word counts by its best field; names are scored once each, then cells by their names. Filters on names leave out whole cells; a campus that
    is set is no filter here, as a query goes beyond it. Titles' postings are opened word by word, rarest first, until what an
    entry could reach through words not yet opened is less than what the page's last hit has: the best title for each, the best
    name for the others, the phrase, and the bonus. Entries are read if a posting named them, or if their cell alone is among the best.
    """
    words, spark = prepare_query(q), index.spark
    start = offset_of(at, index.revision)
    need = start + limit + 1
    empty = spark.createDataFrame([], "position long, id long, score long")
    if not words:
        return Page(empty, None)
    several, phrase = len(words) > 1, " ".join(words)
    values = index.table("values")
    per_value = [F.greatest(*(F.when(F.col("field") == f, _worth(w[1], F.col("text"), F.col("tight"), x)).otherwise(0) for f, w in WEIGHTS.items() if f != "title")).alias(f"w{i}") for i, x in enumerate(words)]
    whole = F.greatest(*(F.when(F.col("field") == f, _worth(w[0], F.col("text"), F.col("tight"), phrase)).otherwise(0) for f, w in WEIGHTS.items() if f != "title")) if several else F.lit(0)
    named = values.select("vid", "field", "name", *per_value, whole.alias("p"))
    columns = [*(f"w{i}" for i in range(len(words))), "p"]
    cells = index.table("cells").select("cell", "n", F.explode("vids").alias("vid")).join(named, "vid", "left")
    allowed = {"category": category, "source": source, "organization": organization}
    passes = [F.max(F.when((F.col("field") == f) & F.col("name").isin(ok), True).otherwise(False)).alias(f"ok_{f}") for f, ok in allowed.items() if ok]
    cells = cells.groupBy("cell", "n").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns), *passes)
    for f, ok in allowed.items():
        cells = cells.where(f"ok_{f}") if ok else cells
    hit_all = lambda best: sum((F.when(b > 0, 1).otherwise(0) for b in best), F.lit(0))

    def total(best: list[Column], p: Column) -> Column:
        n = hit_all(best)
        return F.when(n > 0, sum(best, F.lit(0)) + p + F.when(n == len(words), ALL_WORDS * len(words)).otherwise(0)).otherwise(0).cast("long")

    cells = cells.select("cell", "n", *columns, total([F.col(c) for c in columns[:-1]], F.col("p")).alias("base")).cache()
    entries, postings = index.table("entries"), index.table("postings")
    best_of = lambda i: F.greatest(_worth(WEIGHTS["title"][1], F.col("text"), F.col("tight"), words[i]), F.col(f"w{i}"))
    whole_of = F.greatest(_worth(WEIGHTS["title"][0], F.col("text"), F.col("tight"), phrase), F.col("p")) if several else F.lit(0)

    def first_of(some: DataFrame) -> list[tuple]:
        """The best ``need`` of some entries, exactly scored: what the page and those before it can take of them."""
        scores = some.join(cells, "cell").select("id", "key", total([best_of(i) for i in range(len(words))], whole_of).alias("score")).where("score > 0")
        return [(r.score, r.key, r.id) for r in scores.orderBy(F.col("score").desc(), "key").limit(need).collect()]

    try:
        # cells by what they give: as many rows as scores
        by_base = cells.groupBy("base").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in columns)).collect()
        cell_best = [max((r[c] for r in by_base), default=0) for c in columns]
        seen, least = 0, None
        for r in sorted((r for r in by_base if r.base > 0), key=lambda r: -r.base):
            least, seen = r.base, seen + r.n
            if seen >= need:
                break
        distinct = list(dict.fromkeys(words))
        # a word's entries are no more than its rarest run's, and none where a run is nowhere
        asked = [x for w in distinct for x in (F.count_if(_posting_filter(w)), F.sum(F.when(_posting_filter(w), F.col("n"))), (F.min if _runs(w) else F.sum)(F.when(_posting_filter(w), F.col("n"))))]
        got = list(index.table("sizes").agg(*(x.alias(f"x{i}") for i, x in enumerate(asked))).first())
        lengths = {w: (got[3 * i + 2] or 0, got[3 * i + 1] or 0) for i, w in enumerate(distinct) if got[3 * i] >= max(1, len(_runs(w)))}
        best = first_of(entries.join(cells.where(F.col("base") >= least).select("cell"), "cell", "left_semi")) if least is not None else []
        opened, read = [], 0
        for word in sorted(lengths, key=lambda w: lengths[w]):
            floor = best[need - 1][0] if len(best) >= need else 0
            free = [w in lengths and w not in opened for w in words]
            reach = sum(max(WEIGHTS["title"][1], b) if f else b for f, b in zip(free, cell_best))
            reach += max(cell_best[-1], WEIGHTS["title"][0] if several and all(free) else 0)
            reach += ALL_WORDS * len(words) if all(f or b for f, b in zip(free, cell_best)) else 0
            if reach < floor:
                break
            opened.append(word)
            read += lengths[word][1]
            firsts = {ord(word[i]) % BUCKETS for i in range(max(1, len(word) - 2))}
            ids = postings.where(_posting_filter(word) & F.col("bucket").isin(sorted(firsts))).groupBy("id").agg(F.count_distinct("gram").alias("c")).where(F.col("c") >= max(1, len(_runs(word)))).select("id")
            found = {x[2]: x for x in [*best, *first_of(entries.join(ids, "id", "left_semi"))]}
            best = sorted(found.values(), key=lambda x: (-x[0], x[1]))[:need]
    finally:
        cells.unpersist()
    hits = [(k, x[2], x[0]) for k, x in enumerate(best)][start:]  # one page and one more
    rows = spark.createDataFrame(hits[:limit], empty.schema) if hits else empty
    return Page(rows, cursor(start + limit, index.revision) if len(hits) > limit else None, {"postings": read, "opened": len(opened), "words": len(lengths)})
