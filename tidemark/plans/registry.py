"""All of the library's own queries."""

from __future__ import annotations

from . import board_plans, collection_plans, contact_plans, dedupe_plans, directory_plans, function_plans, merge_plans, notice_plans, ops_plans, projection_plans, publication_plans, report_plans, revision_plans, search_plans, served_plans, serving_plans, state_plans, tree_plans  # noqa: F401
from .binding import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
