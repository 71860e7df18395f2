"""The engine's entities as the driver's tables give them, in Spark and as SQL views for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, days: tuple[str, ...] = ()):
    """Registers a query, and the SQL that gives the same rows. ``days``: dates, which are given as text,
    so that every client reads them alike."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            got = f(spark, d)
            return got.withColumns({c: F.col(c).cast("string") for c in days}) if days else got

        QUERIES[name] = run
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({sql})" if days else sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: the moment at which queries are asked, and the first day that is published
NOW, START = "1999-06-01 03:00:00", "1997-01-01"

NOTICES_SQL = """notices AS (
  SELECT o_orderkey AS id, o_custkey AS org, CASE o_orderstatus WHEN 'O' THEN 'visible' WHEN 'F' THEN 'hidden' ELSE 'removed' END AS status,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 6 HOUR END AS "at",
    o_orderdate + INTERVAL 1 DAY AS first_seen, o_orderkey % 7 = 0 AS pinned, o_orderkey % 13 = 0 AS curated,
    lower(substr(o_orderpriority, 3)) AS category, CAST(floor(o_totalprice) AS BIGINT) AS weight FROM orders)"""


def notices(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("org"),
        F.when(F.col("o_orderstatus") == "O", "visible").when(F.col("o_orderstatus") == "F", "hidden").otherwise("removed").alias("status"),
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("date"),
        F.when((k % 5 == 0) & (k % 11 != 0), ts + F.expr("INTERVAL 6 HOURS")).alias("at"),
        (ts + F.expr("INTERVAL 1 DAY")).alias("first_seen"),
        (k % 7 == 0).alias("pinned"),
        (k % 13 == 0).alias("curated"),
        F.lower(F.expr("substring(o_orderpriority, 3)")).alias("category"),
        F.col("o_totalprice").cast("long").alias("weight"),
    )


ITEMS_SQL = """items AS (
  SELECT doc_id AS id, source, lang, split_part(text, chr(10), 1) AS title, text AS body FROM documents)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items: the title is the first line, the body the whole text."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))


NODES_SQL = """nodes AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name, false AS is_alias FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey % 5 = 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey % 9 = 0 FROM customer)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a tree of organizations; some are aliases of their parents."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = read(spark, d, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(False).alias("is_alias"))
    n = read(spark, d, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"), "n_name", F.col("n_nationkey") % 5 == 0)
    c = read(spark, d, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey"), "c_name", F.col("c_custkey") % 9 == 0)
    return r.union(n).union(c)


RUNS_SQL = """runs AS (SELECT event_id AS id, user_id AS source, ts, event_type = 'error' AS failed, event_type = 'signup' AS partial, value FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as collection runs of sources."""
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "signup").alias("partial"), "value")


def planted(spark: SparkSession, d: str, table: str, key: str, cases: list[tuple], ddl: str) -> DataFrame:
    """A table's rows, each with the wording of one of the cases (numbered from 1 in their first column ``id``): what the driver's texts do not
    hold is planted in all of them. ``id`` is the row's key, ``own`` the row itself."""
    few = F.broadcast(spark.createDataFrame(cases, ddl).withColumnRenamed("id", "_case"))  # the cases
    rows = read(spark, d, table).select(F.col(key).alias("id"), F.struct("*").alias("own"))
    return rows.join(few, F.pmod("id", F.lit(len(cases))) + 1 == F.col("_case")).drop("_case")


def planted_sql(table: str, key: str, cases: str, n: int) -> str:
    """The oracle's form: ``cases`` are rows (id, what is expected ...)."""
    return f"SELECT t.{key} AS id, c.* EXCLUDE (id) FROM {table} t JOIN ({cases}) c ON c.id = t.{key} % {n} + 1"
