"""Queries over the ordered vertices, legs and stages of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.functions import geo
from fellpath.operators import network, sequence
from fellpath.plans.network_queries import MEASURED, measured_legs
from fellpath.plans.projection import view
from fellpath.plans.registry import query, sql_haversine

BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LEGS = MEASURED + f", placed AS (SELECT *, coalesce(sum(meters) OVER (PARTITION BY feature_ord ORDER BY leg_ord {BEFORE}), 0) AS starts_at, sum(meters) OVER (PARTITION BY feature_ord ORDER BY leg_ord) AS ends_at, sum(meters) OVER (PARTITION BY feature_ord) AS whole FROM measured)"
SHAPE = MEASURED + """
, shape AS (SELECT *, sum(u_turn::INT) OVER (PARTITION BY feature_ord ORDER BY leg_ord) AS leg_index FROM (
  SELECT *, coalesce(lag(a_id) OVER w = b_id AND lag(b_id) OVER w = a_id, false) AS u_turn, row_number() OVER (PARTITION BY feature_ord, u, v ORDER BY leg_ord) > 1 AS repeats
  FROM measured WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord)))"""


@query("win01_leg_pairing", "SELECT feature_ord, leg_ord, a_id, b_id FROM legs")
def leg_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive vertices as legs, built from the vertices."""
    return network.pair_legs(view(spark, sf_dir, "points")).select("feature_ord", "leg_ord", "a_id", "b_id")


@query("win02_cumulative", LEGS + "SELECT feature_ord, leg_ord, round(starts_at, 3) AS starts_at, round(ends_at, 3) AS ends_at FROM placed")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.cumulative_legs(measured_legs(spark, sf_dir))
    return out.select("feature_ord", "leg_ord", F.round("starts_at", 3).alias("starts_at"), F.round("ends_at", 3).alias("ends_at"))


COARSE = "node_id // 30000"


@query("win03_polyline_runs", f"""
, p AS (SELECT *, {COARSE} AS node, lag(node_id) OVER w AS was FROM points WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
q AS (SELECT *, lag(node) OVER w AS from_node, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WHERE was IS NULL OR was <> node_id WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
r AS (SELECT *, coalesce(sum((node <> from_node)::INT) OVER (PARTITION BY feature_ord ORDER BY vertex_ord {BEFORE}), 0) AS run FROM q WHERE from_node IS NOT NULL)
SELECT feature_ord, CAST(run AS BIGINT) AS run, min(from_node) AS from_node, max(node) FILTER (node <> from_node) AS to_node, count(*) + 1 AS n_points, round(sum({sql_haversine('lat0', 'lon0', 'lat', 'lon')}), 3) AS meters
FROM r GROUP BY feature_ord, run HAVING bool_or(node <> from_node)""")
def polyline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs between changes of a node three lattice columns wide."""
    points = view(spark, sf_dir, "points").withColumn("node", F.floor(F.col("node_id") / 30000))
    return sequence.polyline_runs(points, "node").withColumn("meters", F.round("meters", 3))


@query("win04_segment_merge", """
, s AS (SELECT feature_ord, leg_ord, a_id, b_id, a_id // 20000 % 3 AS style FROM legs),
i AS (SELECT *, sum((NOT coalesce(a_id = lag(b_id) OVER w AND style = lag(style) OVER w, false))::INT) OVER w AS n FROM s WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord))
SELECT feature_ord, CAST(n - 1 AS BIGINT) AS island, style, count(*) AS n_segments, min(leg_ord) AS first_leg FROM (SELECT feature_ord, leg_ord, style, sum(begins) OVER (PARTITION BY feature_ord ORDER BY leg_ord) AS n
  FROM (SELECT *, (NOT coalesce(a_id = lag(b_id) OVER w AND style = lag(style) OVER w, false))::INT AS begins FROM s WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord))) GROUP BY ALL""".replace("""i AS (SELECT *, sum((NOT coalesce(a_id = lag(b_id) OVER w AND style = lag(style) OVER w, false))::INT) OVER w AS n FROM s WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord))
""", "").replace("FROM legs),\n", "FROM legs)\n"))
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring legs of one style that meet exactly, as one segment."""
    legs = view(spark, sf_dir, "legs").withColumn("style", F.floor(F.col("a_id") / 20000) % 3)
    merged = sequence.merge_segments(legs, ["style"])
    return merged.groupBy("feature_ord", "island", "style").agg(F.count("*").alias("n_segments"), F.min("leg_ord").alias("first_leg"))


@query("win05_drawable_merge", MEASURED + f"""
, s AS (SELECT *, a_id // 20000 % 2 AS style FROM measured WHERE leg_ord % 3 <> 0),
j AS (SELECT *, {sql_haversine('lag(b_lat) OVER w', 'lag(b_lon) OVER w', 'a_lat', 'a_lon')} AS apart, style = lag(style) OVER w AS alike, coalesce(lag(a_id) OVER w = b_id AND lag(b_id) OVER w = a_id, false) AS back FROM s WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord)),
k AS (SELECT *, coalesce(apart <= 120 AND alike AND NOT back, false) AS joined FROM j),
n AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY feature_ord ORDER BY leg_ord) - 1 AS island FROM k)
SELECT feature_ord, CAST(island AS BIGINT) AS island, count(*) AS n_segments, round(coalesce(sum(apart) FILTER (joined AND apart > 0), 0), 3) AS bridged FROM n GROUP BY feature_ord, island""")
def drawable_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third leg is missing; gaps up to 120 m are bridged, turns back are not."""
    legs = measured_legs(spark, sf_dir).where("leg_ord % 3 <> 0").withColumn("style", F.floor(F.col("a_id") / 20000) % 2)
    merged = sequence.merge_drawable(legs, ["style"], gap=120.0)
    return merged.groupBy("feature_ord", "island").agg(F.count("*").alias("n_segments"), F.round(F.coalesce(F.sum("bridged"), F.lit(0.0)), 3).alias("bridged"))


@query("win06_consecutive_dedupe", "SELECT feature_ord, count(*) AS n FROM (SELECT *, lag(node_id) OVER (PARTITION BY feature_ord ORDER BY vertex_ord) AS was FROM points) WHERE was IS NULL OR was <> node_id GROUP BY feature_ord")
def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.without_repeats(view(spark, sf_dir, "points"), ["lat", "lon"]).groupBy("feature_ord").agg(F.count("*").alias("n"))


@query("win07_u_turns", SHAPE + "SELECT feature_ord, leg_ord FROM shape WHERE u_turn")
def u_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.traversal_shape(measured_legs(spark, sf_dir)).where("u_turn").select("feature_ord", "leg_ord")


@query("win08_leg_index", SHAPE + "SELECT feature_ord, leg_ord, CAST(leg_index AS BIGINT) AS leg_index FROM shape")
def leg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.traversal_shape(measured_legs(spark, sf_dir)).select("feature_ord", "leg_ord", "leg_index")


@query("win09_repeats", SHAPE + "SELECT feature_ord, leg_ord, repeats FROM shape")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.traversal_shape(measured_legs(spark, sf_dir)).select("feature_ord", "leg_ord", "repeats")


@query("win10_split_at_reversals", f"""
, kept AS (SELECT * FROM (SELECT *, {sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM points WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)) WHERE step IS NULL OR step >= 0.1),
cut AS (SELECT *, coalesce(lag(node_id) OVER w = lead(node_id) OVER w, false)::INT AS cut FROM kept WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
placed AS (SELECT feature_ord, vertex_ord, cut, sum(cut) OVER (PARTITION BY feature_ord ORDER BY vertex_ord) AS piece FROM cut)
SELECT feature_ord, CAST(piece AS BIGINT) AS piece, count(*) AS n, min(vertex_ord) AS first, max(vertex_ord) AS last FROM (SELECT feature_ord, vertex_ord, piece FROM placed UNION ALL SELECT feature_ord, vertex_ord, piece - 1 FROM placed WHERE cut = 1) GROUP BY feature_ord, piece""")
def split_at_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every feature between the vertices where it turns back on itself."""
    cut = sequence.split_at_reversals(view(spark, sf_dir, "points"))
    return cut.groupBy("feature_ord", "piece").agg(F.count("*").alias("n"), F.min("vertex_ord").alias("first"), F.max("vertex_ord").alias("last"))


@query("win11_excursions", f"""
, d AS (SELECT feature_ord, vertex_ord, {sql_haversine('first_value(lat) OVER w', 'first_value(lon) OVER w', 'lat', 'lon')} AS d FROM points WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
e AS (SELECT *, CASE WHEN d >= 180 THEN 1 WHEN d <= 75 THEN 0 END AS event FROM d),
f AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY feature_ord ORDER BY vertex_ord {BEFORE}), 0) AS was FROM e)
SELECT feature_ord, CAST(sum((event IS NOT NULL AND event = 1 AND was = 0)::INT) AS BIGINT) AS excursions, round(max(d), 3) AS reach FROM f GROUP BY feature_ord""")
def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a feature leaves the surroundings of its first vertex, for a target of 1.5 km."""
    points = view(spark, sf_dir, "points")
    w = sequence.along("feature_ord", "vertex_ord")
    far = points.withColumn("d", geo.haversine(F.first("lat").over(w), F.first("lon").over(w), "lat", "lon"))
    return sequence.excursions(far, "d", F.lit(1500.0)).withColumn("reach", F.round("reach", 3))


STEMS = LEGS + f"""
, head AS (SELECT *, least(150, whole * 0.025::DOUBLE) AS stem FROM placed),
h AS (SELECT *, meters - greatest(0, least(meters, stem - starts_at)) AS rest FROM head),
t AS (SELECT *, coalesce(sum(rest) OVER (PARTITION BY feature_ord ORDER BY leg_ord DESC {BEFORE}), 0) AS after FROM h),
kept AS (SELECT feature_ord, leg_ord, u, v, rest - greatest(0, least(rest, stem - after)) AS meters FROM t)"""


@query("win12_stem_discount", STEMS + "SELECT feature_ord, leg_ord, round(meters, 3) AS meters FROM kept WHERE meters > 0")
def stem_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.without_stems(measured_legs(spark, sf_dir)).select("feature_ord", "leg_ord", F.round("meters", 3).alias("meters"))


@query("win13_traversal_slice", LEGS + """
SELECT feature_ord, leg_ord, round(CASE WHEN inside >= meters - 1e-6 THEN meters ELSE inside END, 3) AS meters FROM (SELECT *, least(ends_at, whole * 0.6::DOUBLE) - greatest(starts_at, 130) AS inside FROM placed) WHERE inside > 1e-6""")
def traversal_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 130 m to six tenths of each feature."""
    legs = measured_legs(spark, sf_dir)
    whole = F.sum("meters").over(sequence.Window.partitionBy("feature_ord"))
    cut = sequence.slice_traversal(legs, F.lit(130.0), whole * 0.6, [])
    return cut.select("feature_ord", "leg_ord", F.round("meters", 3).alias("meters"))


@query("win14_distance_basis", LEGS + f"""
, w AS (SELECT *, meters * (1 + leg_ord % 3) AS other, coalesce(sum(meters * (1 + leg_ord % 3)) OVER (PARTITION BY feature_ord ORDER BY leg_ord {BEFORE}), 0) AS other_at, leg_ord = max(leg_ord) OVER (PARTITION BY feature_ord) AS last FROM placed)
SELECT feature_ord, round(other_at + other * least(1, (250 - starts_at) / meters), 3) AS converted FROM w WHERE 250 >= starts_at AND (250 < ends_at OR last)""")
def distance_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """250 m along each feature told along a measure that counts some legs twice or thrice."""
    legs = measured_legs(spark, sf_dir).withColumn("other", F.col("meters") * (1 + F.col("leg_ord") % 3))
    asked = legs.select("feature_ord").distinct().withColumn("at", F.lit(250.0))
    return sequence.convert_distance(legs, asked, "meters", "other").select("feature_ord", F.round("converted", 3).alias("converted"))


@query("jon22_leg_at", LEGS + """
, w AS (SELECT *, leg_ord = max(leg_ord) OVER (PARTITION BY feature_ord) AS last FROM placed)
SELECT feature_ord, leg_ord, round(a_lat + (b_lat - a_lat) * s, 7) AS lat, round(a_lon + (b_lon - a_lon) * s, 7) AS lon FROM (
  SELECT *, least(1, greatest(0, (250 - starts_at) / meters)) AS s FROM w WHERE (250 <= ends_at AND (250 > starts_at OR starts_at = 0)) OR (last AND 250 > ends_at))""")
def leg_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leg and the point 250 m along each feature, or its end."""
    legs = measured_legs(spark, sf_dir)
    asked = legs.select("feature_ord").distinct().withColumn("at", F.lit(250.0))
    return sequence.leg_at(legs, asked).select("feature_ord", "leg_ord", F.round("point.lat", 7).alias("lat"), F.round("point.lon", 7).alias("lon"))


@query("win15_ridden", LEGS + """
SELECT feature_ord, count(*) AS n_legs, round(sum(meters * s), 3) AS meters, round(arg_max(a_lat + (b_lat - a_lat) * s, leg_ord), 7) AS end_lat FROM (SELECT *, least(1, (whole * 0.4::DOUBLE - starts_at) / meters) AS s FROM placed WHERE starts_at < whole * 0.4::DOUBLE) GROUP BY feature_ord""")
def ridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four tenths of each feature."""
    out = sequence.ridden_share(measured_legs(spark, sf_dir), 0.4)
    return out.groupBy("feature_ord").agg(F.count("*").alias("n_legs"), F.round(F.sum("meters"), 3).alias("meters"), F.round(F.max_by("b_lat", "leg_ord"), 7).alias("end_lat"))


@query("win16_sideways", """
, n AS (SELECT *, (coalesce(lead(lon) OVER w, lon) - coalesce(lag(lon) OVER w, lon)) * 111194.93::DOUBLE * cos(radians(lat)) AS dx, (coalesce(lead(lat) OVER w, lat) - coalesce(lag(lat) OVER w, lat)) * 111194.93::DOUBLE AS dy FROM points WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
m AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM n)
SELECT feature_ord, vertex_ord, round(CASE WHEN len > 0 THEN lat - dx / len * 8 / 111194.93::DOUBLE ELSE lat END, 7) AS off_lat, round(CASE WHEN len > 0 THEN lon + dy / len * 8 / (111194.93::DOUBLE * cos(radians(lat))) ELSE lon END, 7) AS off_lon FROM m""")
def sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices moved eight metres to the right."""
    return sequence.sideways(view(spark, sf_dir, "points")).select("feature_ord", "vertex_ord", F.round("off_lat", 7).alias("off_lat"), F.round("off_lon", 7).alias("off_lon"))


@query("win17_vertices_between", f"""
, s AS (SELECT *, coalesce({sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM points WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
c AS (SELECT *, sum(step) OVER (PARTITION BY feature_ord ORDER BY vertex_ord) AS reached, sum(step) OVER (PARTITION BY feature_ord) AS whole FROM s)
SELECT feature_ord, vertex_ord, CAST(row_number() OVER (PARTITION BY feature_ord ORDER BY vertex_ord DESC) AS INTEGER) AS rank FROM c WHERE whole > 0 AND reached > 0.2::DOUBLE * whole + 0.01 AND reached < 0.8::DOUBLE * whole - 0.01""")
def vertices_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner vertices from eight tenths back to two tenths of each feature."""
    return sequence.vertices_between(view(spark, sf_dir, "points"), 0.8, 0.2).select("feature_ord", "vertex_ord", "rank")


@query("win18_itinerary", """
, s AS (SELECT rider, ride_id, CASE WHEN ride_id % 11 = 0 THEN -1 ELSE meters END AS d FROM rides),
g AS (SELECT *, d >= 0 AS good FROM s)
SELECT rider, ride_id, CASE WHEN sum((NOT good)::INT) OVER w > 0 THEN NULL ELSE round(sum(d) OVER w, 3) END AS from_start, CASE WHEN lead(good) OVER w THEN lead(d) OVER w END AS to_next, lead(1) OVER w IS NULL AS last FROM g WINDOW w AS (PARTITION BY rider ORDER BY ride_id)""")
def itinerary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as steps; every eleventh has a bad distance."""
    steps = view(spark, sf_dir, "rides").select("rider", "ride_id", F.when(F.col("ride_id") % 11 == 0, -1.0).otherwise(F.col("meters")).alias("d"))
    return sequence.itinerary(steps, "d", "rider", "ride_id").select("rider", "ride_id", F.round("from_start", 3).alias("from_start"), "to_next", "last")


@query("win19_phases", """
, c AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER w AND lag(ride_id) OVER w IS NOT NULL)::INT AS begins FROM rides WINDOW w AS (PARTITION BY rider ORDER BY ride_id)),
p AS (SELECT *, sum(begins) OVER (PARTITION BY rider ORDER BY ride_id) AS phase FROM c)
SELECT rider, CAST(phase AS BIGINT) AS phase, kind, count(*) AS n, min(ride_id) AS first, max(ride_id) AS last FROM p GROUP BY rider, phase, kind""")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides of one kind in a row."""
    return sequence.phases(view(spark, sf_dir, "rides"), "kind", "rider", "ride_id")


@query("win20_marks", LEGS + """
, k AS (SELECT feature_ord, leg_ord, unnest(generate_series(0, CAST(whole / 110 AS BIGINT) + 1)) AS mark, starts_at, ends_at, meters, a_lat, b_lat, a_lon, b_lon FROM placed)
SELECT feature_ord, mark, round(a_lat + (b_lat - a_lat) * (mark * 110 + 55 - starts_at) / meters, 7) AS lat, round(a_lon + (b_lon - a_lon) * (mark * 110 + 55 - starts_at) / meters, 7) AS lon FROM k WHERE mark * 110 + 55 <= ends_at AND (mark * 110 + 55 > starts_at OR (starts_at = 0 AND mark = 0))""")
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark every 110 m along each feature."""
    out = sequence.marks_along(measured_legs(spark, sf_dir), 110.0)
    return out.select("feature_ord", "mark", F.round("point.lat", 7).alias("lat"), F.round("point.lon", 7).alias("lon"))


@query("win21_densify", MEASURED + """
, n AS (SELECT *, CAST(greatest(1, ceil(meters / 50)) AS BIGINT) AS n FROM measured)
SELECT feature_ord, leg_ord, CAST(piece AS INTEGER) AS piece, round(a_lat + (b_lat - a_lat) * (piece + 0.5) / n, 7) AS lat, round(meters / n, 4) AS piece_m FROM (SELECT *, unnest(range(n)) AS piece FROM n)""")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.densify(measured_legs(spark, sf_dir), 50.0)
    return out.select("feature_ord", "leg_ord", "piece", F.round("point.lat", 7).alias("lat"), F.round("piece_m", 4).alias("piece_m"))


@query("win22_deltas", "SELECT feature_ord, vertex_ord, node_id - coalesce(lag(node_id) OVER (PARTITION BY feature_ord ORDER BY vertex_ord), 0) AS delta, node_id AS value FROM points")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of node ids, and the ids summed back from them."""
    coded = sequence.deltas(view(spark, sf_dir, "points"), "node_id", "feature_ord", "vertex_ord").select("feature_ord", "vertex_ord", "delta")
    return sequence.undelta(coded, "delta", "feature_ord", "vertex_ord")


@query("win23_diverse_snaps", """
, s AS (SELECT rider, ride_id, title, meters FROM rides),
o AS (SELECT *, row_number() OVER (PARTITION BY rider, title ORDER BY meters, ride_id) AS own FROM s)
SELECT rider, ride_id, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY own > 1, meters, ride_id) AS pick FROM o) WHERE pick <= 6""")
def diverse_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rides of each rider, nearest first, one of each title while others remain."""
    return sequence.diverse(view(spark, sf_dir, "rides"), "rider", "title", ["meters", "ride_id"], 6, per_feature=1).select("rider", "ride_id", "pick")


@query("win24_alternatives", """
, r AS (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY meters, ride_id) AS rank, row_number() OVER (PARTITION BY rider, kind ORDER BY meters, ride_id) AS of_kind FROM rides)
SELECT rider, ride_id, false AS extra FROM r WHERE rank <= 2 UNION ALL SELECT rider, ride_id, true FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY rank) AS n FROM r WHERE rank > 2 AND of_kind = 1) WHERE n <= 2""")
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two shortest rides of each rider, and the shortest of a kind these lack."""
    return sequence.with_alternatives(view(spark, sf_dir, "rides"), "rider", "kind", ["meters", "ride_id"], 2).select("rider", "ride_id", "extra")


@query("win25_slot_rank", """
, s AS (SELECT rider, title, ride_id AS new_slot, row_number() OVER (PARTITION BY rider, title ORDER BY ride_id) AS k FROM rides),
d AS (SELECT rider, title, ride_id, row_number() OVER (PARTITION BY rider, title ORDER BY CASE WHEN ride_id % 5 > 0 THEN meters END NULLS LAST, ride_id) AS k FROM rides)
SELECT d.rider, d.ride_id, s.new_slot FROM d JOIN s ON s.rider = d.rider AND s.title = d.title AND s.k = d.k""")
def slot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides of one title dealt to their own slots, nearest first; some distances are unknown."""
    rides = view(spark, sf_dir, "rides").select("rider", "title", "ride_id", F.when(F.col("ride_id") % 5 > 0, F.col("meters")).alias("d"))
    return sequence.rank_in_slots(rides, "title", "ride_id", "d", "rider").select("rider", "ride_id", "new_slot")


@query("win26_offsets", f"SELECT address AS street, n, coalesce(CAST(sum(n) OVER (ORDER BY address {BEFORE}) AS BIGINT), 0) AS start FROM (SELECT address, count(*) AS n FROM addresses GROUP BY address)")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries come before the first of each address line."""
    return sequence.offsets(view(spark, sf_dir, "addresses"), "address", ["oid"]).withColumnRenamed("address", "street")


@query("win28_stride", """
SELECT rider, ride_id FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY ride_id) - 1 AS i, count(*) OVER (PARTITION BY rider) AS n FROM rides) WHERE i % CAST(ceil(n / 4) AS BIGINT) = 0""")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four rides of each rider, evenly spaced."""
    return sequence.stride(view(spark, sf_dir, "rides"), 4, "rider", "ride_id").select("rider", "ride_id")
