"""Predicates, scores and penalties of routes as column expressions.

Predicates are never null: what they cannot tell is false. Scores are null
where one of their inputs is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import geo
from fellpath.plans.staging import materialise

#: Road classes for paths only, and values of access tags that bar a bicycle.
PATH_ONLY_CLASSES = ("S1710", "S1820")
PROHIBITED_VALUES = ("no", "private", "customers", "destination", "use_sidepath", "dismount")
#: How many times the largest radius the cells are wide in which legs meet hazards.
HAZARD_CELL = 8


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def told(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def finite(x: Column | str) -> Column:
    x = _c(x)
    return told(~F.isnan(x) & (F.abs(x) < float("inf")))


def layer_enabled(status: Column | str, roles: Column | str, enabled: list[str], proposed: bool = False) -> Column:
    """Any role is enabled; proposed features only if these are."""
    some = F.arrays_overlap(_c(roles), F.array(*map(F.lit, enabled))) if enabled else F.lit(False)
    return told(some & (F.lit(proposed) | (_c(status) != "Proposed")))


def snap_eligible(road_class: Column | str, distance: Column | str, direct: float = 8.0) -> Column:
    """Path-only road classes take snaps of ``direct`` metres at most; no class takes any."""
    road_class = _c(road_class)
    return road_class.isNull() | ~road_class.isin(*PATH_ONLY_CLASSES) | told(_c(distance) <= direct)


def meaningful_access(direct: Column | str, mapped: Column | str, estimated: Column | str, limit: float, least_mapped: float = 30.0, ratio: float = 0.2) -> Column:
    """An estimated stretch within ``limit``, or mapped metres that close enough of the gap."""
    direct, mapped, estimated = (_c(x) for x in (direct, mapped, estimated))
    sound = F.lit(True)
    for x in (direct, mapped, estimated):
        sound &= finite(x) & (x >= 0)
    closes = (mapped >= least_mapped) & (F.greatest(F.lit(0.0), direct - estimated) >= ratio * mapped)
    return told(sound & ((estimated <= limit) | closes))


def is_circuit(total: Column | str, overlap: Column | str) -> Column:
    total, overlap = _c(total), _c(overlap)
    return told(finite(total) & (total > 0) & finite(overlap) & (overlap / total < 0.40))


def valid_point(lat: Column | str, lon: Column | str) -> Column:
    return finite(lat) & finite(lon) & told(_c(lat).between(-90, 90) & _c(lon).between(-180, 180))


def credible_fix(accuracy: Column | str, fix_ms: Column | str, now_ms: Column | str, accuracy_limit: float = 25.0, age_limit: int = 10_000, ahead: int = 0) -> Column:
    """Accurate enough, not older than the limit and at most ``ahead`` milliseconds in the future."""
    age = _c(now_ms) - _c(fix_ms)
    return told((_c(accuracy) <= accuracy_limit) & (age >= -ahead) & (age <= age_limit))


def usable_fix(accuracy: Column | str, fix_ms: Column | str, now_ms: Column | str) -> Column:
    """The planner's limits: 35 m, 15 s old, 5 s ahead."""
    return credible_fix(accuracy, fix_ms, now_ms, 35.0, 15_000, 5_000)


def osm_access(tags: Column | str) -> Column:
    """Whether tags (map) let a bicycle use a service road."""
    access, bicycle, service = (F.lower(F.coalesce(_c(tags)[k], F.lit(""))) for k in ("access", "bicycle", "service"))
    barred = access.isin("no", "private") & ~bicycle.isin("yes", "designated", "permissive")
    return ~(barred | bicycle.isin("no", "private") | service.isin("drive-through", "emergency_access"))


def prohibited_tags(tags: Column | str) -> Column:
    """Tags that bar bicycles, or a way that is no existing path."""
    tags = _c(tags)
    barred = F.lit(False)
    for key in ("access", "vehicle", "bicycle"):
        barred |= told(tags[key].isin(*PROHIBITED_VALUES))
    for key in ("construction", "proposed", "disused", "abandoned"):
        barred |= tags[key].isNotNull()
    return barred | ~told(tags["highway"] == "path")


def crosses_box(a_lat, a_lon, b_lat, b_lon, south: float, west: float, north: float, east: float) -> Column:  # noqa: ANN001
    """Whether a segment meets a box, by clipping it against the slabs of both axes."""
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, minimum, maximum in ((_c(a_lon), _c(b_lon), west, east), (_c(a_lat), _c(b_lat), south, north)):
        delta = b - a
        t1, t2 = (F.lit(minimum) - a) / F.when(delta != 0, delta), (F.lit(maximum) - a) / F.when(delta != 0, delta)
        low = F.when(delta == 0, low).otherwise(F.greatest(low, F.least(t1, t2)))
        high = F.when(delta == 0, high).otherwise(F.least(high, F.greatest(t1, t2)))
        inside &= (delta != 0) | a.between(minimum, maximum)
    return told(inside & (low <= high))


def all_words(query: Column | str, text: Column | str) -> Column:
    """Every word of ``query`` is part of ``text``, but for case and apostrophes; no word fits all."""

    def plain(x: Column | str) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "['’]", "")

    words = F.filter(F.split(plain(query), r"\s+"), lambda w: w != "")
    body = plain(text)
    return F.forall(words, lambda w: F.contains(body, w))


def looks_like_address(text: Column | str) -> Column:
    """A house number and then some text."""
    return told(_c(text).rlike(r"^\s*\d+[A-Za-z]?(?:-\d+|\s1/2)?\s+\S"))


def stale(now_ms: Column | str, checked_ms: Column | str, reviewed_ms: Column | str, limit_ms: Column | str) -> Column:
    """Checked or reviewed in the future or too long ago."""
    now, limit = _c(now_ms), _c(limit_ms)
    out = F.lit(False)
    for then in (_c(checked_ms), _c(reviewed_ms)):
        out |= (now < then) | (now - then >= limit)
    return F.coalesce(out, F.lit(True))


def road_name_matches(name: Column | str, pattern: str) -> Column:
    """A road name, lower case, without dots and with single blanks, fits a pattern."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(name)), r"\.", ""), r"\s+", " "))
    return told(plain.rlike(pattern))


def guide_status(now_ms: Column | str, review_ms: Column | str, expires_ms: Column | str) -> Column:
    """``current`` until the review time, ``due`` until it expires, then ``expired``."""
    now = _c(now_ms)
    return F.when(now < _c(review_ms), "current").when(now < _c(expires_ms), "due").otherwise("expired")


def access_score(routed: Column | str, estimated: Column | str, roles: Column | str) -> Column:
    """Cost of an endpoint's access: estimates weigh more where no road is mapped,
    and much more beyond 125 m; connectors and shared roads are favoured."""
    routed, estimated, roles = _c(routed), _c(estimated), _c(roles)
    weight = F.when(routed > 0.01, 8.0).otherwise(50.0)
    favour = F.when(F.array_contains(roles, "ParkConnectors"), 0.5).when(F.array_contains(roles, "SharedRoadways"), 0.75).otherwise(1.0)
    return (routed + estimated * weight + F.greatest(F.lit(0.0), estimated - 125.0) * 400.0) * favour


def route_rating(total: Column | str, access: Column | str, shared: Column | str, straight: Column | str, hazards: Column | str | float = 0.0, endpoint: Column | str | float = 0.0) -> Column:
    """Trail metres, dearer shared and access metres, and what goes beyond twice the straight line and 400 m."""
    total, access, shared = (_c(x) for x in (total, access, shared))
    trail = F.greatest(F.lit(0.0), total - access - shared)
    detour = F.greatest(F.lit(0.0), total - (_c(straight) * 2.0 + 400.0))
    return trail + shared * 12.0 + access * 8.0 + detour * 20.0 + _c(hazards) + _c(endpoint)


def overlap_penalty(total: Column | str, overlap: Column | str) -> Column:
    """A quarter of the overlap up to 10 % of the route, all of it up to 25 %, three times what is beyond."""
    total, overlap = _c(total), _c(overlap)
    own = F.least(overlap, total)
    near, far = total * 0.10, total * 0.25
    out = F.least(own, near) * 0.25 + F.least(F.greatest(F.lit(0.0), own - near), far - near) + F.greatest(F.lit(0.0), own - far) * 3.0
    return F.when(finite(total) & (total > 0) & finite(overlap) & (overlap > 0), out).otherwise(0.0)


def candidate_score(error: Column | str, safety: Column | str, history: Column | str, total: Column | str, overlap: Column | str, shape: Column | str) -> Column:
    return _c(error) * 6.0 + _c(safety) * 0.15 + _c(history) * 2.5 + overlap_penalty(total, overlap) * 5.0 + _c(shape) * 3.0


def best_candidate(candidates: DataFrame, group: str, hazard: str, within: str, score: str, signature: str) -> DataFrame:
    """One row per group: no hazard first, then within tolerance, then the least score, then the signature."""
    order = Window.partitionBy(group).orderBy(F.col(hazard), ~F.col(within), F.round(score, 6), signature)
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def shape_penalty(reach: Column | str, excursions: Column | str, turnarounds: Column | str, target: Column | str) -> Column:
    """Metres by which a loop stays too near its start, and for going out or turning back too often."""
    target = _c(target)
    out = F.greatest(F.lit(0.0), target * 0.20 - F.coalesce(_c(reach), F.lit(0.0))) * 2.0
    out += F.greatest(F.lit(0), F.coalesce(_c(excursions), F.lit(0)) - 1) * target * 0.30
    out += F.greatest(F.lit(0), F.coalesce(_c(turnarounds), F.lit(0)) - 1) * target * 0.75
    return F.when(finite(target) & (target > 0), out).otherwise(0.0)


def hazard_events(legs: DataFrame, hazards: DataFrame, group: str = "feature_ord", order: str = "leg_ord") -> DataFrame:
    """Per group and hazard it meets: ``crossings`` of its circle, ``visits`` and ``enters``.

    ``hazards`` (hazard_id, h_lat, h_lon, radius, penalty) is a catalogue; each lies in one cell,
    and a leg looks at the cells of its box, widened at its latitude by the largest radius. The
    catalogue is written first, so that the planner knows whether it can be sent to all tasks
    and no leg is shuffled by cell; legs that lie by group stay where they are."""
    active = materialise(hazards.where("radius > 0 and penalty > 0"), "hazards")
    reach = active.agg(F.max("radius")).first()[0]
    if reach is None:
        reach = 1.0
    cell = reach * HAZARD_CELL
    row, col = geo.grid_cell("h_lat", "h_lon", cell)
    placed = active.withColumns({"row": row, "col": col})
    high = reach * geo.GRID_MARGIN / geo.FRAME_METERS_PER_DEGREE
    wide = F.lit(high) / F.cos(F.radians(F.least(F.greatest(F.abs("a_lat"), F.abs("b_lat")) + F.lit(0.05 + high), F.lit(89.9))))
    lo = geo.grid_cell(F.least("a_lat", "b_lat") - high, F.least("a_lon", "b_lon") - wide, cell)
    hi = geo.grid_cell(F.greatest("a_lat", "b_lat") + high, F.greatest("a_lon", "b_lon") + wide, cell)
    own = Window.partitionBy(group)
    ended = legs.where(F.col(group).isNotNull()).withColumns({"_first": F.min(order).over(own), "_last": F.max(order).over(own)})
    cells = ended.withColumn("row", F.explode(F.sequence(lo[0], hi[0]))).withColumn("col", F.explode(F.sequence(lo[1], hi[1])))
    met = cells.join(placed, ["row", "col"])
    inside = {f"{e}_in": geo.haversine(f"{e}_lat", f"{e}_lon", "h_lat", "h_lon") <= F.col("radius") for e in "ab"}
    near = geo.project_to_segment("h_lat", "h_lon", "a_lat", "a_lon", "b_lat", "b_lon")["distance"] <= F.col("radius")
    met = met.withColumns(inside | {"near": near})
    crossings = F.when(F.col("a_in") != F.col("b_in"), 1).when(F.col("a_in"), 0).when(F.col("near"), 2).otherwise(0)
    out = met.withColumn("crossings", crossings)
    extra = F.when((F.col(order) == F.col("_first")) & F.col("a_in"), 1).otherwise(0) + F.when((F.col(order) == F.col("_last")) & F.col("b_in"), 1).otherwise(0)
    per = out.withColumn("_extra", extra).groupBy(group, "hazard_id", "penalty").agg(F.sum("crossings").alias("crossings"), F.sum("_extra").alias("_ends"), F.max(F.col("near") | F.col("a_in") | F.col("b_in")).alias("enters"))
    return per.where("enters").withColumn("visits", F.floor((F.col("crossings") + F.col("_ends")) / 2)).drop("_ends")
