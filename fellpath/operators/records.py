"""Records of routes: carried rides, generations of searches, rules of fields, agreement.

Checks are never null: a rule that cannot be told is broken. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.operators import sequence
from fellpath.operators.network import top_of


def carried(ridden: DataFrame, until: Column, route: DataFrame) -> DataFrame:
    """Legs (feature_ord, leg_ord, meters) ridden of an earlier route up to ``until``, and those of the route that follows it."""
    return sequence.slice_traversal(ridden, F.lit(0.0), until, []).unionByName(route)


def adopted(searches: DataFrame, ride: str, order: list[Column], drift: Column, most: float = 100.0) -> DataFrame:
    """Searches with ``outcome``: only the newest of a ride is adopted, and only
    where the rider has not moved more than ``most`` metres since it began."""
    newest = F.row_number().over(Window.partitionBy(ride).orderBy(*order)) == 1
    return searches.withColumn("outcome", F.when(~newest, "superseded").when(F.coalesce(drift <= most, F.lit(False)), "adopted").otherwise("stale"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, field) for every rule that a row breaks."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*broken))).alias("field"))


def geometry_agreement(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, n, agrees) of paths (points: array of lat, lon): as many points on both
    sides, none further apart than ``tolerance`` degrees."""
    both = left.select(key, "points").join(right.select(key, F.col("points").alias("_other")), key)
    # A rounding of half a unit must not count as a difference.
    near = F.forall(F.arrays_zip("points", "_other"), lambda p: (F.abs(p["points"]["lat"] - p["_other"]["lat"]) <= tolerance) & (F.abs(p["points"]["lon"] - p["_other"]["lon"]) <= tolerance))
    return both.select(key, F.size("points").cast("long").alias("n"), F.coalesce((F.size("points") == F.size("_other")) & near, F.lit(False)).alias("agrees"))


def enveloped(rows: DataFrame, error: Column, most: int = 400) -> DataFrame:
    """Rows with ``ok`` and ``message``, the error cut to ``most`` characters."""
    return rows.withColumns({"ok": error.isNull(), "message": F.substring(error, 1, most)})


def best_pairs(starts: DataFrame, goals: DataFrame, request: str, score: Column, ties: list[Column], *, start_order: list[str], goal_order: list[str], limit: int = 8) -> DataFrame:
    """Of all pairs of a request's ``limit`` first starts and goals the one with the least
    ``score``, an expression of both sides' columns: all columns and ``score``. Ties (1e-6) go to
    ``ties``; pairs without a score are left out. A request has at most ``limit`` squared pairs."""
    few = [top_of(rows, [request], [F.col(c) for c in order], limit) for rows, order in ((starts, start_order), (goals, goal_order))]
    pairs = few[0].join(few[1], request).withColumn("score", score).where("score is not null")
    return top_of(pairs, [request], [F.round("score", 6), *ties], 1)
