"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fellpath.plans.projection import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, views: bool = True) -> Callable[[Query], Query]:
    """Register a function as query ``name``; ``sql`` goes on from the projected
    views, or stands alone where ``views`` is false."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql) if views else sql
        return function

    return add


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The great-circle distance as DuckDB SQL."""
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"(12742017.6::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def sql_segment(lat: str, lon: str, part: str) -> str:
    """Distance (``part`` d) or position (``t``) of a point against a leg, in DuckDB SQL."""
    r = "6371008.8::DOUBLE"
    px, py = f"(radians({lon} - a_lon) * cos(radians(a_lat)) * {r})", f"(radians({lat} - a_lat) * {r})"
    bx, by = f"(radians(b_lon - a_lon) * cos(radians(a_lat)) * {r})", f"(radians(b_lat - a_lat) * {r})"
    t = f"least(greatest(({px} * {bx} + {py} * {by}) / ({bx} * {bx} + {by} * {by}), 0::DOUBLE), 1::DOUBLE)"
    return t if part == "t" else f"sqrt(pow({px} - {bx} * {t}, 2) + pow({py} - {by} * {t}, 2))"
