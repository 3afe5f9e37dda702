"""Ordered sequences of vertices, legs and instructions as window queries.

Every operator works within one route (``group``) in the order of a column; a
window holds the rows of one route only, however many routes there are. Rows
with a null group form a route of their own, null coordinates give null
distances, empty tables give empty results, and rows that tie in the order
column are taken in an unspecified order, so the order column should be a key.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fellpath.functions import geo

GROUP = "feature_ord"


def along(group: str | list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(order)


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _until(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(value: Column, window: WindowSpec) -> Column:
    """Sum of all rows up to and with this one."""
    return F.coalesce(F.sum(value).over(_until(window)), F.lit(0.0))


def whole(value: Column, window: WindowSpec) -> Column:
    """Sum of all rows, added up in the window's order like the sums of its parts, so that ends compare."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))


def sum_before(value: Column, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(_before(window)), F.lit(0.0))


def cumulative_legs(legs: DataFrame, group: str = GROUP, order: str = "leg_ord", least: float = 0.1) -> DataFrame:
    """Legs of at least ``least`` metres with the distance at which each begins and ends."""
    kept = legs.where(F.col("meters") >= least)
    start = sum_before(F.col("meters"), along(group, order))
    return kept.withColumn("starts_at", start).withColumn("ends_at", F.col("starts_at") + F.col("meters"))


def without_repeats(points: DataFrame, columns: list[str], group: str = GROUP, order: str = "vertex_ord") -> DataFrame:
    """Rows whose ``columns`` differ from those of the row before."""
    w = along(group, order)
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    return points.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def islands(rows: DataFrame, begins: Column, group: str = GROUP, order: str = "leg_ord", name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; a run begins where ``begins`` holds (null counts as false)."""
    w = along(group, order)
    flagged = rows.withColumn("_begins", F.when(F.row_number().over(w) == 1, 0).when(begins, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_begins").over(_until(w))).drop("_begins")


def polyline_runs(points: DataFrame, node: str, group: str = GROUP, order: str = "vertex_ord") -> DataFrame:
    """Runs of a polyline between changes of node: group, run, from_node, to_node, n_points, meters.

    Vertices within 0.01 m of the one before are skipped; what follows the last
    change of node is no run.
    """
    w = along(group, order)
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    kept = points.withColumn("_step", step).where(F.col("_step").isNull() | (F.col("_step") > 0.01))
    legs = kept.withColumns({"_from": F.lag(node).over(w), "meters": geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")}).where("meters is not null")
    changed = F.col(node) != F.col("_from")
    numbered = legs.withColumn("run", F.coalesce(F.sum(F.when(changed, 1).otherwise(0)).over(_before(w)), F.lit(0)))
    runs = numbered.groupBy(group, "run").agg(F.first("_from").alias("from_node"), F.max(F.when(changed, F.col(node))).alias("to_node"), (F.count("*") + 1).alias("n_points"), F.sum("meters").alias("meters"))
    return runs.where(F.col("to_node").isNotNull())


def merge_segments(segments: DataFrame, same: list[str], group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """Segments with ``island``: neighbours with equal ``same`` columns whose ends meet exactly."""
    w = along(group, order)
    joined = (F.col("a_id") == F.lag("b_id").over(w))
    for c in same:
        joined &= F.col(c).eqNullSafe(F.lag(c).over(w))
    return islands(segments, ~F.coalesce(joined, F.lit(False)), group, order)


def merge_drawable(segments: DataFrame, same: list[str], gap: float = 35.0, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """Segments with ``island`` and ``bridged``: neighbours that end within ``gap``
    metres and do not turn back onto each other; ``bridged`` is the gap closed."""
    w = along(group, order)
    apart = geo.haversine(F.lag("b_lat").over(w), F.lag("b_lon").over(w), "a_lat", "a_lon")
    joined = (apart <= gap) & ~turns_back(w)
    for c in same:
        joined &= F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = segments.withColumns({"_joined": F.coalesce(joined, F.lit(False)), "_apart": apart})
    out = islands(marked, ~F.col("_joined"), group, order)
    return out.withColumn("bridged", F.when(F.col("_joined") & (F.col("_apart") > 0), F.col("_apart"))).drop("_joined", "_apart")


def turns_back(window: WindowSpec) -> Column:
    """The leg is the exact reverse of the one before it; false for the first."""
    return F.coalesce((F.lag("a_id").over(window) == F.col("b_id")) & (F.lag("b_id").over(window) == F.col("a_id")), F.lit(False))


def traversal_shape(legs: DataFrame, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """Legs with ``u_turn``, ``leg_index`` (turns so far) and ``repeats`` (ridden before in either direction)."""
    w = along(group, order)
    pair = Window.partitionBy(group, F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).orderBy(order)
    out = legs.withColumns({"u_turn": turns_back(w), "repeats": F.row_number().over(pair) > 1})
    return out.withColumn("leg_index", F.sum(F.col("u_turn").cast("int")).over(_until(w)))


def traversal_pieces(legs: DataFrame, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """Pieces of equal ``leg_index`` and ``repeats`` in a row: group, piece, both, n_legs, starts_at, ends_at."""
    w = along(group, order)
    shaped = traversal_shape(cumulative_legs(legs, group, order), group, order)
    begins = (F.col("leg_index") != F.lag("leg_index").over(w)) | (F.col("repeats") != F.lag("repeats").over(w))
    cut = islands(shaped, begins, group, order, "piece")
    return cut.groupBy(group, "piece", "leg_index", "repeats").agg(F.count("*").alias("n_legs"), F.min("starts_at").alias("starts_at"), F.max("ends_at").alias("ends_at"))


def split_at_reversals(points: DataFrame, group: str = GROUP, order: str = "vertex_ord", least: float = 0.1) -> DataFrame:
    """Vertices with ``piece``; a vertex with equal neighbours ends one piece and begins the
    next, and is listed in both. Vertices within ``least`` metres of the one before are
    left out first: they are no step."""
    w = along(group, order)
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    kept = points.withColumn("_step", step).where(F.col("_step").isNull() | (F.col("_step") >= least)).drop("_step")
    turns = kept.withColumn("_turn", F.coalesce(F.lag("node_id").over(w) == F.lead("node_id").over(w), F.lit(False)))
    numbered = turns.withColumn("piece", F.sum(F.col("_turn").cast("int")).over(_until(w)))
    both = F.when(F.col("_turn"), F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece"))
    return numbered.withColumn("piece", F.explode(both)).drop("_turn")


def excursions(distances: DataFrame, distance: str, target: Column, group: str = GROUP, order: str = "vertex_ord") -> DataFrame:
    """Per group, how often it goes out to the outer radius after being back within the inner one."""
    inner = F.least(F.lit(400.0), F.greatest(F.lit(75.0), target * 0.05))
    outer = F.greatest(inner * 1.5, target * 0.12)
    w = along(group, order)
    event = F.when(F.col(distance) >= outer, 1).when(F.col(distance) <= inner, 0)
    marked = distances.withColumn("_event", event).withColumn("_was", F.last("_event", ignorenulls=True).over(_before(w)))
    begins = (F.col("_event") == 1) & (F.coalesce("_was", F.lit(0)) == 0)
    return marked.groupBy(group).agg(F.sum(F.when(begins, 1).otherwise(0)).alias("excursions"), F.max(distance).alias("reach"))


def without_stems(edges: DataFrame, group: str = GROUP, order: str = "leg_ord", meters: str = "meters") -> DataFrame:
    """Edges with ``meters`` less the stem at either end: up to 150 m or 2.5 % of the whole, head first."""
    w = along(group, order)
    whole = F.sum(meters).over(Window.partitionBy(group))
    stem = F.least(F.lit(150.0), whole * 0.025)
    head = edges.withColumn("_stem", stem).withColumn("_head", F.greatest(F.lit(0.0), F.least(F.col(meters), F.col("_stem") - sum_before(F.col(meters), w))))
    left = head.withColumn("_left", F.col(meters) - F.col("_head"))
    back = Window.partitionBy(group).orderBy(F.desc(order))
    tail = F.greatest(F.lit(0.0), F.least(F.col("_left"), F.col("_stem") - sum_before(F.col("_left"), back)))
    out = left.withColumn("_tail", tail).withColumn(meters, F.col("_left") - F.col("_tail"))
    return out.where(F.col(meters) > 0).drop("_stem", "_head", "_left", "_tail")


def slice_traversal(edges: DataFrame, start: Column, end: Column, shared: list[str], group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """The part of each route between two distances; ``meters`` and ``shared`` are cut in proportion."""
    w = along(group, order)
    out = edges.withColumns({"_from": sum_before(F.col("meters"), w), "_lo": start, "_hi": end})
    inside = F.least(F.col("_from") + F.col("meters"), F.col("_hi")) - F.greatest(F.col("_from"), F.col("_lo"))
    out = out.withColumn("_inside", inside).where(F.col("_inside") > 1e-6)
    whole = F.col("_inside") >= F.col("meters") - 1e-6
    share = F.when(whole, F.lit(1.0)).otherwise(F.col("_inside") / F.col("meters"))
    cut = {c: F.col(c) * share for c in shared} | {"meters": F.when(whole, F.col("meters")).otherwise(F.col("_inside"))}
    return out.withColumns(cut).drop("_from", "_lo", "_hi", "_inside")


def convert_distance(edges: DataFrame, asked: DataFrame, source: str, target: str, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """``asked`` (group, at) with ``converted``: the distance ``at`` along measure
    ``source`` told along measure ``target``, in proportion within an edge; past
    the end it is the end."""
    w = along(group, order)
    ends = edges.withColumns({"_s0": sum_before(F.col(source), w), "_t0": sum_before(F.col(target), w), "_last": F.lead(order).over(w).isNull()})
    found = asked.join(ends, group).where((F.col("at") >= F.col("_s0")) & ((F.col("at") < F.col("_s0") + F.col(source)) | F.col("_last")))
    share = F.when(F.col(source) > 0, F.least(F.lit(1.0), (F.col("at") - F.col("_s0")) / F.col(source))).otherwise(1.0)
    return found.select(*asked.columns, (F.col("_t0") + F.col(target) * share).alias("converted"))


def leg_at(legs: DataFrame, asked: DataFrame, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """``asked`` (group, at) with the first leg that ends at or after ``at``, else the last, and the point there."""
    measured = cumulative_legs(legs, group, order).withColumn("_last", F.lead(order).over(along(group, order)).isNull())
    hit = asked.join(measured, group).where(((F.col("at") <= F.col("ends_at")) & ((F.col("at") > F.col("starts_at")) | (F.col("starts_at") == 0))) | (F.col("_last") & (F.col("at") > F.col("ends_at"))))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") - F.col("starts_at")) / F.col("meters")))
    return hit.select(*asked.columns, order, geo.interpolate("a_lat", "a_lon", "b_lat", "b_lon", share).alias("point"))


def ridden(legs: DataFrame, progress: Column, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """Legs up to ``progress`` metres, the last one cut where it is reached."""
    measured = cumulative_legs(legs, group, order).withColumn("_p", progress).where(F.col("starts_at") < F.col("_p"))
    share = F.least(F.lit(1.0), (F.col("_p") - F.col("starts_at")) / F.col("meters"))
    end = geo.interpolate("a_lat", "a_lon", "b_lat", "b_lon", share)
    return measured.withColumns({"_end": end, "meters": F.col("meters") * share}).withColumns({"b_lat": F.col("_end.lat"), "b_lon": F.col("_end.lon")}).drop("_end", "_p")


def _length(a_lat: pd.Series, a_lon: pd.Series, b_lat: pd.Series, b_lon: pd.Series) -> pd.Series:
    """``geo.haversine`` by the C library, null where a place is."""
    def meters(*ends: float) -> float | None:
        if any(math.isnan(x) for x in ends):
            return None
        lat1, lon1, lat2, lon2 = map(math.radians, ends)
        h = math.pow(math.sin((lat2 - lat1) / 2), 2) + math.cos(lat1) * math.cos(lat2) * math.pow(math.sin((lon2 - lon1) / 2), 2)
        return 2 * geo.EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h)) if h <= 1 else None

    return pd.Series([meters(*ends) for ends in zip(a_lat, a_lon, b_lat, b_lon, strict=True)], dtype="float64")


def ridden_share(legs: DataFrame, share: float, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """``ridden`` up to a share of the metres of each route, ``meters`` being the lengths of the legs.

    A leg that begins where the share ends is not ridden. Of routes in which one begins there
    but for the last bits of a double the lengths are taken from the C library, as in SQL
    engines that use it: those of the JVM may differ in these bits and so put the leg on the
    other side. All others keep their lengths."""
    w = along(group, order)
    at = whole(F.col("meters"), w) * share
    begins = F.abs(sum_before(F.col("meters"), w) - at) <= at * 1e-9
    marked = legs.withColumn("_begins", begins)
    marked = marked.withColumn("_tied", F.max("_begins").over(Window.partitionBy(group)))
    again = F.pandas_udf(_length, "double")(*(F.when(F.col("_tied"), F.col(c)) for c in ("a_lat", "a_lon", "b_lat", "b_lon")))
    settled = marked.withColumn("meters", F.coalesce(again, F.col("meters"))).drop("_begins", "_tied")
    settled = settled.withColumn("_whole", whole(F.col("meters"), w))
    return ridden(settled, F.col("_whole") * share, group, order).drop("_whole")


def sideways(points: DataFrame, meters: float = 8.0, group: str = GROUP, order: str = "vertex_ord") -> DataFrame:
    """Vertices moved ``meters`` to the right of the direction from the one before to the one after."""
    w = along(group, order)
    lat0, lon0 = (F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("lat", "lon"))
    lat1, lon1 = (F.coalesce(F.lead(c).over(w), F.col(c)) for c in ("lat", "lon"))
    k = F.lit(geo.FRAME_METERS_PER_DEGREE)
    out = points.withColumns({"_dx": (lon1 - lon0) * k * F.cos(F.radians("lat")), "_dy": (lat1 - lat0) * k})
    length = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    moved = {"off_lat": F.when(length > 0, F.col("lat") - F.col("_dx") / length * meters / k).otherwise(F.col("lat")), "off_lon": F.when(length > 0, F.col("lon") + F.col("_dy") / length * meters / (k * F.cos(F.radians("lat")))).otherwise(F.col("lon"))}
    return out.withColumns(moved).drop("_dx", "_dy")


def vertices_between(points: DataFrame, start: float, end: float, group: str = GROUP, order: str = "vertex_ord") -> DataFrame:
    """Vertices strictly between two shares of the length (by 0.01 m), ranked from the first share to the second."""
    w = along(group, order)
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), F.lit(0.0))
    out = points.withColumn("_step", step).withColumns({"at": running(F.col("_step"), w), "_whole": F.sum("_step").over(Window.partitionBy(group))})
    inside = (F.col("at") > min(start, end) * F.col("_whole") + 0.01) & (F.col("at") < max(start, end) * F.col("_whole") - 0.01) & (F.col("_whole") > 0)
    rank = Window.partitionBy(group).orderBy(F.asc(order) if start <= end else F.desc(order))
    return out.where(inside).withColumn("rank", F.row_number().over(rank)).drop("_step", "_whole")


def itinerary(steps: DataFrame, distance: str, group: str, order: str) -> DataFrame:
    """Steps with ``from_start`` (null from the first bad distance on), ``to_next`` and ``last``."""
    w = along(group, order)
    good = F.coalesce((F.col(distance) >= 0) & (F.col(distance) < float("inf")), F.lit(False))
    poisoned = F.sum(F.when(good, 0).otherwise(1)).over(_until(w)) > 0
    onward = F.lead(F.when(good, F.col(distance))).over(w)
    return steps.withColumns({"from_start": F.when(~poisoned, running(F.col(distance), w)), "to_next": onward, "last": F.lead(F.lit(1)).over(w).isNull()})


def phases(steps: DataFrame, kind: str, group: str, order: str) -> DataFrame:
    """Runs of one kind: group, phase, kind, n, first, last."""
    w = along(group, order)
    cut = islands(steps, ~F.col(kind).eqNullSafe(F.lag(kind).over(w)), group, order, "phase")
    return cut.groupBy(group, "phase", kind).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def marks_along(legs: DataFrame, spacing: float, group: str = GROUP, order: str = "leg_ord") -> DataFrame:
    """A mark at half the spacing and then every ``spacing`` metres: mark number, point, bearing.

    Legs make their own marks, so long routes are spread over their legs."""
    measured = cumulative_legs(legs, group, order, least=1e-9)
    first = F.greatest(F.lit(0), F.floor((F.col("starts_at") - spacing / 2) / spacing) + F.when(F.col("starts_at") < spacing / 2, 0).otherwise(1))
    last = F.floor((F.col("ends_at") - spacing / 2) / spacing)
    marked = measured.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_last >= _first").withColumn("mark", F.explode(F.sequence("_first", "_last")))
    share = (F.col("mark") * spacing + spacing / 2 - F.col("starts_at")) / F.col("meters")
    return marked.select(group, "mark", order, geo.interpolate("a_lat", "a_lon", "b_lat", "b_lon", share).alias("point"), geo.bearing("a_lat", "a_lon", "b_lat", "b_lon").alias("bearing"))


def densify(legs: DataFrame, spacing: float) -> DataFrame:
    """Legs cut into equal pieces of at most ``spacing`` metres: piece number, its middle and its metres."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("meters") / spacing)).cast("int")
    cut = legs.where("meters >= 0.01").withColumn("_n", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    middle = geo.interpolate("a_lat", "a_lon", "b_lat", "b_lon", (F.col("piece") + 0.5) / F.col("_n"))
    return cut.withColumns({"point": middle, "piece_m": F.col("meters") / F.col("_n")}).drop("_n")


def deltas(rows: DataFrame, value: str, group: str, order: str) -> DataFrame:
    """``delta``: the value less that of the row before (the first less 0)."""
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(along(group, order)), F.lit(0)))


def undelta(rows: DataFrame, delta: str, group: str, order: str) -> DataFrame:
    return rows.withColumn("value", F.sum(delta).over(_until(along(group, order))))


def diverse(snaps: DataFrame, query: str, feature: str, order: list[str], limit: int, per_feature: int = 4) -> DataFrame:
    """The first ``limit`` rows of each query, at most ``per_feature`` of one
    feature while others remain, then the rest in order; with ``pick``."""
    ranked = snaps.withColumn("_own", F.row_number().over(Window.partitionBy(query, feature).orderBy(*order)))
    pick = F.row_number().over(Window.partitionBy(query).orderBy(F.col("_own") > per_feature, *order))
    return ranked.withColumn("pick", pick).where(F.col("pick") <= limit).drop("_own")


def with_alternatives(snaps: DataFrame, query: str, component: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each query and the first of each component among
    the others that these do not hold, at most ``k`` of those."""
    ranked = snaps.withColumns({"rank": F.row_number().over(Window.partitionBy(query).orderBy(*order)), "_of": F.row_number().over(Window.partitionBy(query, component).orderBy(*order))})
    extra = ranked.where((F.col("rank") > k) & (F.col("_of") == 1)).withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).where(F.col("_n") <= k)
    return ranked.where(F.col("rank") <= k).drop("_of").withColumn("extra", F.lit(False)).unionByName(extra.drop("_of", "_n").withColumn("extra", F.lit(True)))


def rank_in_slots(rows: DataFrame, name: str, slot: str, distance: str, group: str) -> DataFrame:
    """Rows dealt anew to the slots that rows of the same name hold, nearest first; unknown distances last."""
    slots = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group, name).orderBy(slot))).select(group, name, "_k", F.col(slot).alias("new_slot"))
    near = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group, name).orderBy(F.asc_nulls_last(distance), slot)))
    return near.join(slots, [group, name, "_k"]).drop("_k")


def offsets(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, n, start): how many rows each key has, and how many rows all smaller keys have.

    Counts are summed per bucket of keys (their first two characters); only the
    totals of the buckets meet in one task."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("_part", F.substring(F.col(key).cast("string"), 1, 2))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return counts.withColumn("_in", inside).join(before, "_part").select(key, "n", (F.col("_before") + F.col("_in")).alias("start"))


def stride(rows: DataFrame, most: int, group: str, order: str) -> DataFrame:
    """Every k-th row of a group, k the smallest that leaves at most ``most``."""
    w = along(group, order)
    numbered = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(group))})
    return numbered.where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")
