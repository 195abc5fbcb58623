"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from . import registry
from .plans import catalog_queries, change_queries, chunk_queries, crawl_queries, evaluation_queries, pdf_queries, retrieval_queries, text_queries  # noqa: F401
from .streaming import ingest, jobs  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
