"""All registered queries of the page engine and their SQL."""

from __future__ import annotations

from .plans import layout_queries, page_queries, raster_queries, region_queries, stream_queries, text_queries  # noqa: F401  they register
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
