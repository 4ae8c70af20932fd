"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import asset_queries, base, evaluation_queries, graph_queries, search_queries, store_queries, stored_queries, stream_queries, text_queries  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
