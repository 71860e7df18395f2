"""Weighted multi-field search with a deterministic rank."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# What a hit of the whole query and of one word is worth in each field.
WEIGHTS = {"alias": (200, 120), "title": (120, 100), "organization": (60, 55), "category": (45, 40), "source": (30, 25)}
#: share of the weight for a hit that only shows with blanks left out; added per word when all words hit
COMPACT_SHARE, ALL_WORDS = 0.6, 25


def prepare_query(q: str) -> list[str]:
    """The query's words as search sees them. A query is one short string, prepared by its caller."""
    return re.sub("[^0-9a-z가-힣]+", " ", unicodedata.normalize("NFKC", q).lower()).split()


def with_fields(rows: DataFrame, compatible: bool = True) -> DataFrame:
    """Adds ``f_<field>`` (search form) and ``g_<field>`` (without blanks) for each field that rows have."""
    found = [f for f in WEIGHTS if f in rows.columns]
    rows = rows.withColumns({f"f_{f}": T.search_text(F.coalesce(f, F.lit("")), compatible) for f in found})
    return rows.withColumns({f"g_{f}": T.compact(F.col(f"f_{f}")) for f in found})


def _best(rows: DataFrame, words: str, whole: bool) -> Column:
    """The best field's score for a word, or for the whole query."""
    tight = words.replace(" ", "")
    scores = []
    for f, w in WEIGHTS.items():
        if f"f_{f}" in rows.columns:
            full = w[0 if whole else 1]
            scores.append(F.when(~F.col(f"g_{f}").contains(tight), 0).when(F.col(f"f_{f}").contains(words), full).otherwise(int(full * COMPACT_SHARE + 0.5)))
    return F.greatest(*scores, F.lit(0))


def score(rows: DataFrame, q: str, compatible: bool = True) -> DataFrame:
    """``rows`` with ``score``: the sum of each word's best field, of the phrase's best field if there are
    several words, and a bonus when all words hit; 0 when none does."""
    words = prepare_query(q)
    rows_ = with_fields(rows, compatible)
    if not words:
        return rows.withColumn("score", F.lit(0))
    per = [_best(rows_, w, False) for w in words]
    hits = sum((F.when(p > 0, 1).otherwise(0) for p in per), F.lit(0))
    total = sum(per, F.lit(0))
    if len(words) > 1:
        total = total + _best(rows_, " ".join(words), True)
    total = total + F.when(hits == len(words), ALL_WORDS * len(words)).otherwise(0)
    return rows_.withColumn("score", F.when(hits > 0, total).otherwise(0)).select(*rows.columns, "score")


def newest_first(date: str = "date", at: str = "at", seen: str = "first_seen", ident: str = "id", tie: str = "desc") -> list[Column]:
    """The list's order: date, time, first seen, id, all descending, unknown last; ``tie="asc"`` for ids ascending."""
    return [F.col(c).desc_nulls_last() for c in (date, at, seen)] + [F.col(ident).asc() if tie == "asc" else F.col(ident).desc()]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and one row more, by which the caller knows whether there is another. A top-k, not a sort of all."""
    return rows.orderBy(*order).offset(offset).limit(limit + 1)


def campus_passes(audiences: Column, campus: str, orgs_here: Column) -> Column:
    """University-wide and undetermined notices always pass; others by campus, or by an organization that is here."""
    return F.exists(audiences, lambda k: k.isin("university", "undetermined", f"campus:{campus}") | (k.startswith("org:") & F.array_contains(orgs_here, F.substring_index(k, ":", -1))))
