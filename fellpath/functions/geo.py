"""Distances, projections and directions as column expressions.

All take and give DOUBLE degrees and metres and stay inside code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius, metres per degree of the source frame and of the grid.
EARTH_RADIUS = 6_371_008.8
FRAME_METERS_PER_DEGREE = 111_194.93
GRID_METERS_PER_DEGREE = 111_320.0
#: Latitude (radians) at which grid cells are sized in longitude.
GRID_LATITUDE = 0.70686
#: A degree of the grid has more metres than one of the sphere; cells this much larger than a reach hold it.
GRID_MARGIN = 1.002


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:  # noqa: ANN001
    """Great-circle metres between two points."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def _frame(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north metres of a point seen from an origin."""
    scale = F.lit(EARTH_RADIUS)
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * scale, F.radians(lat - lat0) * scale


def project_to_segment(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:  # noqa: ANN001
    """Nearest place of a segment: struct (t in 0..1, lat, lon, distance).

    Planar around the segment's start; a segment without length is its start.
    """
    lat, lon, a_lat, a_lon, b_lat, b_lon = (_c(x) for x in (lat, lon, a_lat, a_lon, b_lat, b_lon))
    px, py = _frame(a_lat, a_lon, lat, lon)
    bx, by = _frame(a_lat, a_lon, b_lat, b_lon)
    square = bx * bx + by * by
    t = F.when(square > 0, F.least(F.greatest((px * bx + py * by) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    distance = F.when(square > 0, F.sqrt(F.pow(px - bx * t, 2) + F.pow(py - by * t, 2))).otherwise(haversine(lat, lon, a_lat, a_lon))
    return F.struct(t.alias("t"), (a_lat + (b_lat - a_lat) * t).alias("lat"), (a_lon + (b_lon - a_lon) * t).alias("lon"), distance.alias("distance"))


def with_projection(rows: DataFrame, name: str = "p") -> DataFrame:
    """``rows`` (lat, lon and the ends of a segment) with ``project_to_segment`` as a column.

    Each step is generated as a value of its own. As one expression every use of a part takes all of
    it again, within conditions that share nothing, and becomes too long a method to be compiled."""
    def step(rows: DataFrame, column: str, value: Column) -> DataFrame:
        return rows.withColumn(column, F.explode(F.array(value)))

    px, py = _frame(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    bx, by = _frame(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    out = step(rows, "_f", F.struct(px.alias("px"), py.alias("py"), bx.alias("bx"), by.alias("by")))
    px, py, bx, by = (F.col(f"_f.{c}") for c in ("px", "py", "bx", "by"))
    out = step(out, "_square", bx * bx + by * by)
    square, t = F.col("_square"), F.col("_t")
    out = step(out, "_t", F.when(square > 0, F.least(F.greatest((px * bx + py * by) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)))
    distance = F.when(square > 0, F.sqrt(F.pow(px - bx * t, 2) + F.pow(py - by * t, 2))).otherwise(haversine("lat", "lon", "a_lat", "a_lon"))
    a_lat, a_lon = F.col("a_lat"), F.col("a_lon")
    out = step(out, name, F.struct(t.alias("t"), (a_lat + (F.col("b_lat") - a_lat) * t).alias("lat"), (a_lon + (F.col("b_lon") - a_lon) * t).alias("lon"), distance.alias("distance")))
    return out.drop("_f", "_square", "_t")


def source_frame(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:  # noqa: ANN001
    """Place of a point along and across the directed line a to b: struct (along, across,
    side); side is across with its sign."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = (_c(x) for x in (lat, lon, a_lat, a_lon, b_lat, b_lon))
    k, shrink = F.lit(FRAME_METERS_PER_DEGREE), F.cos(F.radians(a_lat))
    px, py = (lon - a_lon) * k * shrink, (lat - a_lat) * k
    bx, by = (b_lon - a_lon) * k * shrink, (b_lat - a_lat) * k
    length = F.sqrt(bx * bx + by * by)
    side = (px * by - py * bx) / length
    return F.struct(((px * bx + py * by) / length).alias("along"), F.abs(side).alias("across"), side.alias("side"))


def bearing(lat1, lon1, lat2, lon2) -> Column:  # noqa: ANN001
    """Forward azimuth in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_bucket(lat1, lon1, lat2, lon2, buckets: int = 8) -> Column:  # noqa: ANN001
    """Planar direction in equal buckets, north first, clockwise."""
    turn = F.atan2(_c(lon2) - _c(lon1), _c(lat2) - _c(lat1)) / F.lit(2 * 3.141592653589793)
    return F.least(F.floor(F.pmod(turn, F.lit(1.0)) * buckets), F.lit(buckets - 1)).cast("int")


def turn_delta(before, after) -> Column:  # noqa: ANN001
    """Signed change of direction in [-180, 180)."""
    return F.pmod(_c(after) - _c(before) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def maneuver(delta) -> Column:  # noqa: ANN001
    """Name of a turn by its size; null below 35 degrees."""
    delta = _c(delta)
    side = F.when(delta > 0, "Right").otherwise("Left")
    size = F.abs(delta)
    return F.when(size < 35, F.lit(None).cast("string")).when(size < 60, F.concat(F.lit("Slight"), side)).when(size < 135, F.concat(F.lit("Turn"), side)).otherwise(F.concat(F.lit("Sharp"), side))


def grid_cell(lat, lon, meters: float) -> tuple[Column, Column]:  # noqa: ANN001
    """Row and column of the grid cell of a point.

    Rows are ``meters`` high. Columns are ``meters`` wide at the grid's own
    latitude and narrower further north; ``columns_around`` tells how many of
    them ``meters`` may span.
    """
    lat_step = meters / GRID_METERS_PER_DEGREE
    lon_step = meters / (GRID_METERS_PER_DEGREE * math.cos(GRID_LATITUDE))
    return F.floor(_c(lat) / F.lit(lat_step)), F.floor(_c(lon) / F.lit(lon_step))


def columns_around(lat) -> Column:  # noqa: ANN001
    """How many columns on either side of a point at ``lat`` lie within one cell's metres."""
    narrow = F.cos(F.radians(F.least(F.abs(_c(lat)) + F.lit(0.05), F.lit(89.9))))
    return F.ceil(F.lit(math.cos(GRID_LATITUDE) * GRID_METERS_PER_DEGREE / (EARTH_RADIUS * math.pi / 180) * 1.0001) / narrow).cast("long")


def tile_key(lat, lon) -> tuple[Column, Column]:  # noqa: ANN001
    """Row and column of the 0.01 degree tile of a point."""
    return F.floor(_c(lat) * 100), F.floor(_c(lon) * 100)


def interpolate(a_lat, a_lon, b_lat, b_lon, share) -> Column:  # noqa: ANN001
    """The point at a share of the way from a to b."""
    a_lat, a_lon, b_lat, b_lon, share = (_c(x) for x in (a_lat, a_lon, b_lat, b_lon, share))
    return F.struct((a_lat + (b_lat - a_lat) * share).alias("lat"), (a_lon + (b_lon - a_lon) * share).alias("lon"))


#: Fixed factors of the edge cost.
FACILITY_FACTOR = {"OffRoadTrail": 1.0, "SeparatedTrail": 1.0, "UrbanTrail": 1.0, "BikeLane": 1.15, "SharedLane": 1.35, "Other": 1.2, "Unknown": 1.1}
COMFORT_FACTOR = {"AllAgesAndAbilities": 1.0, "MostAdults": 1.1, "ExperiencedBicyclists": 1.35, "StrongAndFearless": 1.75, "Unknown": 1.1}
SHARED_ROADWAY_FACTOR = 10.0


def _factor(column: Column, table: dict[str, float], other: float = 1.0) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def role_factor(roles) -> Column:  # noqa: ANN001
    """Shared roadways cost more unless the feature is a park connector too; ``roles`` is an array."""
    roles = _c(roles)
    shared = F.array_contains(roles, "SharedRoadways") & ~F.array_contains(roles, "ParkConnectors")
    return F.when(shared, F.lit(SHARED_ROADWAY_FACTOR)).otherwise(F.lit(1.0))


def edge_cost(distance, facility, comfort, roles, access=0.0, estimated=0.0, hazard=0.0) -> Column:  # noqa: ANN001
    """Cost of an edge: trail metres weighted by facility, comfort and roles, its
    access metres (``estimated`` of them unmapped), and hazards."""
    distance, access = _c(distance), _c(access)
    unmapped = F.least(_c(estimated), access)
    trail = F.greatest(F.lit(0.0), distance - access)
    return trail * _factor(_c(facility), FACILITY_FACTOR) * _factor(_c(comfort), COMFORT_FACTOR) * role_factor(roles) + access_cost(F.greatest(F.lit(0.0), access - unmapped), unmapped) + _c(hazard)


def access_cost(routed, estimated, grace: float = 125.0) -> Column:  # noqa: ANN001
    """Cost of reaching the network: routed metres, estimated metres, and a
    surcharge on estimates beyond the grace."""
    routed, estimated = _c(routed), _c(estimated)
    return routed * 8 + estimated * 75 + F.greatest(estimated - F.lit(grace), F.lit(0.0)) * 400


def recency_weight(age_days, half_life: float = 21.0) -> Column:  # noqa: ANN001
    return F.pow(F.lit(0.5), F.greatest(_c(age_days), F.lit(0.0)) / F.lit(half_life))


def loop_tolerance(target) -> Column:  # noqa: ANN001
    return F.greatest(F.lit(160.0), _c(target) * F.lit(0.1))


def segments_distance(a, b, c, d) -> Column:  # noqa: ANN001
    """Metres between segments a-b and c-d, each end a (lat, lon) pair: 0 where they cross,
    else the least distance of an end to the other segment."""

    def side(p, q, r) -> Column:  # noqa: ANN001
        return (_c(q[1]) - _c(p[1])) * (_c(r[0]) - _c(p[0])) - (_c(q[0]) - _c(p[0])) * (_c(r[1]) - _c(p[1]))

    cross = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    ends = [project_to_segment(*p, *q, *r)["distance"] for p, q, r in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))]
    return F.when(cross, F.lit(0.0)).otherwise(F.least(*ends))
