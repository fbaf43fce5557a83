"""All queries of the library and their SQL twins."""

from __future__ import annotations

from geoloom.plans import box_queries, capture_queries, geodesy, raster_queries

FLAGSHIP = "flagship_path_boxes"
MODULES = (geodesy, box_queries, raster_queries, capture_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
