"""Closures of features: cutting paths where they are closed, and the closed parts.

Closures are a catalogue (closure_id, feature_ord, from_lat, from_lon, to_lat,
to_lon, active_ms, projected, crossing); it is joined by feature. A closure is
in force from ``active_ms`` on, whatever its estimated end; crossings cut
nothing. Paths that a closure does not fit stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import geo

VERTEX_METERS, PROJECTED_METERS = 1.0, 2.0
BOUNDS = ["from_lat", "from_lon", "to_lat", "to_lon"]


def active(closures: DataFrame, now_ms: int) -> DataFrame:
    return closures.where(F.col("active_ms") <= now_ms)


def _located(points: DataFrame, closures: DataFrame) -> DataFrame:
    """Per feature and closure where both bounds lie: leg (its first vertex) and position
    (leg and share) of the nearest leg, and the first vertex within a metre of each."""
    w = Window.partitionBy("feature_ord").orderBy("vertex_ord")
    legs = points.select("feature_ord", "vertex_ord", "lat", "lon", F.lead("lat").over(w).alias("n_lat"), F.lead("lon").over(w).alias("n_lon"))
    joined = legs.join(closures.select("feature_ord", "closure_id", *BOUNDS), "feature_ord")
    out = []
    for side in ("from", "to"):
        p = geo.project_to_segment(f"{side}_lat", f"{side}_lon", "lat", "lon", "n_lat", "n_lon")
        at = geo.haversine("lat", "lon", f"{side}_lat", f"{side}_lon")
        near = F.when(F.col("n_lat").isNotNull(), F.struct(p["distance"].alias("d"), F.col("vertex_ord").alias("leg"), p["t"].alias("t")))
        out += [F.min(near).alias(f"{side}_near"), F.min(F.when(at <= VERTEX_METERS, F.col("vertex_ord"))).alias(f"{side}_vertex")]
    return joined.groupBy("feature_ord", "closure_id").agg(*out)


def _ordered(located: DataFrame) -> DataFrame:
    """Bounds within reach as first and last along the path; others are left out."""
    good = located.where((F.col("from_near.d") <= PROJECTED_METERS) & (F.col("to_near.d") <= PROJECTED_METERS))
    place = {s: F.struct((F.col(f"{s}_near.leg") + F.col(f"{s}_near.t")).alias("position"), F.col(f"{s}_near.leg").alias("leg"), F.lit(s).alias("side")) for s in ("from", "to")}
    return good.withColumns({"first": F.least(*place.values()), "last": F.greatest(*place.values())}).where("last.position > first.position")


def _united(spans: DataFrame, low: str, high: str) -> DataFrame:
    """Per feature its spans (struct columns that sort along the path) as one ordered array
    ``_closed``, those that overlap made one; spans that only touch stay apart."""
    w = Window.partitionBy("feature_ord").orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (reach.isNull() | (F.col(low) >= reach)).cast("int"))
    numbered = marked.withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("feature_ord", "_span").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    return whole.groupBy("feature_ord").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_closed"))


def cut_at_vertices(points: DataFrame, closures: DataFrame) -> DataFrame:
    """Vertices with ``piece``: features are cut where both bounds of a closure are vertices.

    What lies between is gone, pieces of one vertex too. A feature may have any number
    of closures; those that overlap close together what either of them closes."""
    bounds = _located(points, closures.where("not crossing and not projected")).where("from_vertex is not null and to_vertex is not null and from_vertex <> to_vertex")
    spans = _united(bounds.select("feature_ord", F.least("from_vertex", "to_vertex").alias("_a"), F.greatest("from_vertex", "to_vertex").alias("_b")), "_a", "_b")
    at = F.col("vertex_ord")
    gone = F.exists("_closed", lambda x: (x["low"] < at) & (at < x["high"]))
    piece = F.size(F.filter("_closed", lambda x: x["high"] <= at))
    joined = points.join(spans, "feature_ord", "left").where(F.col("_closed").isNull() | ~gone)
    cut = joined.withColumn("piece", F.when(F.col("_closed").isNull(), 0).otherwise(piece)).drop("_closed")
    return cut.withColumn("_n", F.count("*").over(Window.partitionBy("feature_ord", "piece"))).where("_n >= 2").drop("_n")


def _point(side: Column, closures: DataFrame) -> tuple[Column, Column]:
    return tuple(F.when(side == "from", F.col(f"from_{c}")).otherwise(F.col(f"to_{c}")) for c in ("lat", "lon"))


def _without_repeats(rows: DataFrame, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy("place")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return rows.withColumn("_step", step).where(F.col("_step").isNull() | (F.col("_step") > 0.01)).drop("_step")


def cut_at_bounds(points: DataFrame, closures: DataFrame) -> DataFrame:
    """(feature_ord, piece, place, lat, lon) of features that projected closures cut: up to the
    first bound of each and on from its last, bounds as vertices of their own; closures that
    overlap are one."""
    found = _ordered(_located(points, closures.where("not crossing and projected"))).join(closures.select("feature_ord", "closure_id", *BOUNDS), ["feature_ord", "closure_id"])
    bound = {}
    for end in ("first", "last"):
        lat, lon = _point(F.col(f"{end}.side"), closures)
        bound[end] = F.struct(F.col(f"{end}.position").alias("place"), lat.alias("lat"), lon.alias("lon"))
    spans = _united(found.select("feature_ord", bound["first"].alias("_a"), bound["last"].alias("_b")), "_a", "_b")
    at = F.col("vertex_ord").cast("double")
    kept = points.join(spans, "feature_ord").where(~F.exists("_closed", lambda x: (x["low"]["place"] < at) & (at < x["high"]["place"])))
    own = kept.select("feature_ord", F.size(F.filter("_closed", lambda x: x["high"]["place"] <= at)).alias("piece"), at.alias("place"), "lat", "lon")
    ends = spans.select("feature_ord", F.posexplode("_closed").alias("k", "x"))
    before = ends.select("feature_ord", F.col("k").alias("piece"), "x.low.place", "x.low.lat", "x.low.lon")
    after = ends.select("feature_ord", (F.col("k") + 1).alias("piece"), "x.high.place", "x.high.lat", "x.high.lon")
    whole = _without_repeats(own.unionByName(before).unionByName(after), ["feature_ord", "piece"])
    return whole.withColumn("_n", F.count("*").over(Window.partitionBy("feature_ord", "piece"))).where("_n >= 2").drop("_n")


def closed_section(points: DataFrame, closures: DataFrame) -> DataFrame:
    """(feature_ord, closure_id, place, lat, lon): the bounds of a closure and the vertices between."""
    found = _ordered(_located(points, closures)).join(closures.select("feature_ord", "closure_id", *BOUNDS), ["feature_ord", "closure_id"])
    ends = []
    for end in ("first", "last"):
        lat, lon = _point(F.col(f"{end}.side"), closures)
        ends.append(found.select("feature_ord", "closure_id", F.col(f"{end}.position").alias("place"), lat.alias("lat"), lon.alias("lon")))
    inner = points.join(found.select("feature_ord", "closure_id", F.col("first.leg").alias("_a"), F.col("last.leg").alias("_b")), "feature_ord").where("vertex_ord > _a and vertex_ord <= _b")
    inner = inner.select("feature_ord", "closure_id", F.col("vertex_ord").cast("double").alias("place"), "lat", "lon")
    return _without_repeats(ends[0].unionByName(inner).unionByName(ends[1]), ["feature_ord", "closure_id"])
