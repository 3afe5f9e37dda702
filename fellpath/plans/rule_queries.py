"""Queries over predicates, penalties and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellpath.functions import geo, text
from fellpath.operators import network, rules, sequence
from fellpath.plans.network_queries import LENGTH, MEASURED, measured_legs
from fellpath.plans.projection import view
from fellpath.plans.registry import query, sql_haversine, sql_segment
from fellpath.plans.sequence_queries import LEGS, SHAPE, STEMS
from fellpath.plans.text_queries import NOW_MS

DAY = 86_400_000


@query("flt03_endpoint_local", f"""
, near AS (SELECT DISTINCT feature_ord FROM legs, (SELECT lat, lon FROM query_points WHERE point_id % 100 = 0) q
  WHERE abs(q.lat - (a_lat + b_lat) / 2) < 0.0075 AND abs(q.lon - (a_lon + b_lon) / 2) < 0.0095 AND {sql_segment('q.lat', 'q.lon', 'd')} <= 600)
SELECT feature_ord FROM features WHERE facility <> 'Other' OR feature_ord IN (SELECT feature_ord FROM near)""")
def endpoint_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local features (facility Other) stay only within 600 m of an endpoint; all others stay."""
    features = view(spark, sf_dir, "features").select("feature_ord", "facility")
    local = view(spark, sf_dir, "legs").join(features.where("facility = 'Other'"), "feature_ord", "left_semi")
    endpoints = view(spark, sf_dir, "query_points").where("point_id % 100 = 0")
    lines = network.places_in_reach(endpoints, local, 600.0).select(*network.SEGMENT).distinct()
    near = local.join(lines, network.SEGMENT, "left_semi").select("feature_ord").distinct()
    return features.where("facility <> 'Other'").select("feature_ord").union(near)


@query("flt04_loop_radius", f"""
, starts AS (SELECT point_id AS request, lat, lon, greatest(2000, 0.8::DOUBLE * (1000 + point_id % 7 * 500)) AS radius FROM query_points WHERE point_id % 100 = 0),
roads AS (SELECT l.* FROM legs l JOIN features f ON f.feature_ord = l.feature_ord WHERE role = 'SharedRoadways')
SELECT request, count(DISTINCT feature_ord) AS n_roads FROM starts, roads WHERE abs(lat - a_lat) < 0.03 AND abs(lon - a_lon) < 0.04 AND {sql_segment('lat', 'lon', 'd')} <= radius GROUP BY request""")
def loop_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many roads lie within the reach of a loop from every hundredth query point."""
    starts = view(spark, sf_dir, "query_points").where("point_id % 100 = 0").select(F.col("point_id").alias("request"), "lat", "lon", (1000 + F.col("point_id") % 7 * 500).cast("double").alias("target"))
    roads = view(spark, sf_dir, "legs").join(view(spark, sf_dir, "features").where("role = 'SharedRoadways'").select("feature_ord"), "feature_ord", "left_semi")
    return network.count_within_loop_radius(starts, roads)


@query("flt05_snap_eligible", "SELECT ride_id FROM rides WHERE ride_id % 3 <> 0 OR access_m / 20 <= 8")
def snap_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    road = F.when(F.col("ride_id") % 3 == 0, "S1710").when(F.col("ride_id") % 3 == 1, "S1400")
    return view(spark, sf_dir, "rides").where(rules.snap_eligible(road, F.col("access_m") / 20)).select("ride_id")


@query("flt06_meaningful_access", "SELECT ride_id FROM rides WHERE meters / 10 >= 0 AND (access_m <= 150 OR (shared_m >= 30 AND greatest(0, meters / 10 - access_m) >= 0.2::DOUBLE * shared_m))")
def meaningful_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").where(rules.meaningful_access(F.col("meters") / 10, "shared_m", "access_m", 150.0)).select("ride_id")


@query("flt07_active_closures", f"SELECT ride_id FROM rides WHERE {NOW_MS} - {400 * DAY} >= used_ms")
def active_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides taken as closures from their date on; an estimated end never lifts one."""
    return view(spark, sf_dir, "rides").where(F.lit(NOW_MS - 400 * DAY) >= F.col("used_ms")).select("ride_id")


@query("flt09_loop_target", "SELECT ride_id FROM rides WHERE target_m / 40 BETWEEN 804.672 AND 160934.4")
def loop_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").where(text.loop_target_valid(F.col("target_m") / 40)).select("ride_id")


@query("flt10_circuit", "SELECT ride_id FROM rides WHERE meters > 0 AND overlap_m * 1.5::DOUBLE / meters < 0.4::DOUBLE")
def circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").where(rules.is_circuit("meters", F.col("overlap_m") * 1.5)).select("ride_id")


@query("flt11_valid_point", "SELECT point_id FROM query_points WHERE point_id % 4 < 2")
def valid_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which a quarter has a latitude that is no number and a quarter one beyond the pole."""
    bad = F.when(F.col("point_id") % 4 == 2, float("nan")).when(F.col("point_id") % 4 == 3, 90.5).otherwise(F.col("lat"))
    return view(spark, sf_dir, "query_points").where(rules.valid_point(bad, "lon")).select("point_id")


@query("flt12_credible_fix", "SELECT event_id FROM fixes WHERE accuracy_m <= 25 AND event_id % 16 - 3 BETWEEN 0 AND 10")
def credible_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes looked at from 3 s before to 12 s after they were taken."""
    now = F.col("fix_ms") + (F.col("event_id") % 16 - 3) * 1000
    return view(spark, sf_dir, "fixes").where(rules.credible_fix("accuracy_m", "fix_ms", now)).select("event_id")


@query("flt13_usable_fix", "SELECT event_id FROM fixes WHERE accuracy_m <= 35 AND event_id % 30 - 8 BETWEEN -5 AND 15")
def usable_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.col("fix_ms") + (F.col("event_id") % 30 - 8) * 1000
    return view(spark, sf_dir, "fixes").where(rules.usable_fix("accuracy_m", "fix_ms", now)).select("event_id")


def tags(n: str = "feature_ord") -> F.Column:
    """Way tags derived from a number; absent keys are absent."""
    n = F.col(n)
    pairs = {"access": F.when(n % 4 == 0, "Private").when(n % 4 == 1, "no"), "bicycle": F.when(n % 3 == 0, "yes").when(n % 3 == 1, "dismount"), "service": F.when(n % 5 == 0, "drive-through").when(n % 5 == 1, "driveway"), "highway": F.when(n % 2 == 0, "path"), "proposed": F.when(n % 7 == 0, "path")}
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda k, v: v.isNotNull())


@query("flt14_osm_access", "SELECT feature_ord FROM features WHERE NOT (feature_ord % 4 < 2 AND feature_ord % 3 <> 0) AND feature_ord % 5 <> 0")
def osm_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "features").where(rules.osm_access(tags())).select("feature_ord")


@query("flt15_prohibited", "SELECT feature_ord FROM features WHERE feature_ord % 4 = 1 OR feature_ord % 3 = 1 OR feature_ord % 7 = 0 OR feature_ord % 2 = 1")
def prohibited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "features").where(rules.prohibited_tags(tags())).select("feature_ord")


@query("flt16_crosses_box", """
, box AS (SELECT feature_ord, leg_ord, a_lat, a_lon, b_lat - a_lat AS dy, b_lon - a_lon AS dx FROM legs),
t AS (SELECT *, CASE WHEN dx <> 0 THEN least((-89.1852::DOUBLE - a_lon) / dx, (-89.1501::DOUBLE - a_lon) / dx) ELSE 0 END AS x0, CASE WHEN dx <> 0 THEN greatest((-89.1852::DOUBLE - a_lon) / dx, (-89.1501::DOUBLE - a_lon) / dx) ELSE 1 END AS x1,
  CASE WHEN dy <> 0 THEN least((40.3993::DOUBLE - a_lat) / dy, (40.4307::DOUBLE - a_lat) / dy) ELSE 0 END AS y0, CASE WHEN dy <> 0 THEN greatest((40.3993::DOUBLE - a_lat) / dy, (40.4307::DOUBLE - a_lat) / dy) ELSE 1 END AS y1 FROM box)
SELECT feature_ord, leg_ord FROM t WHERE greatest(0, x0, y0) <= least(1, x1, y1) AND (dx <> 0 OR a_lon BETWEEN -89.1852 AND -89.1501) AND (dy <> 0 OR a_lat BETWEEN 40.3993 AND 40.4307)""")
def crosses_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs that meet one fixed box."""
    return view(spark, sf_dir, "legs").where(rules.crosses_box("a_lat", "a_lon", "b_lat", "b_lon", 40.3993, -89.1852, 40.4307, -89.1501)).select("feature_ord", "leg_ord")


@query("flt17_kind", "SELECT ride_id FROM rides WHERE kind = 'ExerciseLoop'")
def kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").where("kind = 'ExerciseLoop'").select("ride_id")


@query("flt18_place_words", "SELECT oid FROM addresses WHERE contains(lower(address), 'north') AND contains(lower(address), 'str')")
def place_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "addresses").where(rules.all_words(F.lit(" Str  NO'RTH"), "address")).select("oid")


@query("flt19_looks_like_address", "SELECT oid FROM addresses WHERE oid % 3 <> 1")
def looks_like_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.when(F.col("oid") % 3 == 0, F.col("address")).when(F.col("oid") % 3 == 1, F.concat(F.lit("x"), "address")).otherwise("12-3 A")
    return view(spark, sf_dir, "addresses").where(rules.looks_like_address(typed)).select("oid")


@query("flt20_stale", f"SELECT ride_id FROM rides WHERE {NOW_MS} - {500 * DAY} < used_ms OR {NOW_MS} - {500 * DAY} - used_ms >= {300 * DAY} OR {NOW_MS} - {500 * DAY} - used_ms + {10 * DAY} >= {300 * DAY}")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as checks, reviewed ten days before, seen 500 days before the end."""
    rides = view(spark, sf_dir, "rides")
    return rides.where(rules.stale(F.lit(NOW_MS - 500 * DAY), "used_ms", F.col("used_ms") - 10 * DAY, F.lit(300 * DAY))).select("ride_id")


@query("flt23_road_name", "SELECT oid FROM addresses WHERE regexp_matches(lower(address), ' (north )?(machinery|furniture) st')")
def road_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = F.regexp_replace("address", " ", " . ")
    return view(spark, sf_dir, "addresses").where(rules.road_name_matches(dotted, " (north )?(machinery|furniture) st")).select("oid")


@query("flt25_guide_status", f"SELECT ride_id, CASE WHEN {NOW_MS} - {900 * DAY} < used_ms THEN 'current' WHEN {NOW_MS} - {900 * DAY} < used_ms + {365 * DAY} THEN 'due' ELSE 'expired' END AS status FROM rides")
def guide_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", rules.guide_status(F.lit(NOW_MS - 900 * DAY), "used_ms", F.col("used_ms") + 365 * DAY).alias("status"))


HAZARDS = [(1, 40.4012, -89.1799, 55.0, 50_000.0), (2, 40.4005, -89.1603, 60.0, 1000.0), (3, 40.4021, -89.1752, 40.0, 200.0), (4, 40.43, -89.17, 0.0, 10.0)]


def hazards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HAZARDS, "hazard_id int, h_lat double, h_lon double, radius double, penalty double")


EVENTS = f""", hazards(hazard_id, h_lat, h_lon, radius, penalty) AS (VALUES {', '.join(f'({a}, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)' for a, b, c, d, e in HAZARDS)}),
met AS (SELECT *, {sql_haversine('a_lat', 'a_lon', 'h_lat', 'h_lon')} <= radius AS a_in, {sql_haversine('b_lat', 'b_lon', 'h_lat', 'h_lon')} <= radius AS b_in, {sql_segment('h_lat', 'h_lon', 'd')} <= radius AS near,
  leg_ord = min(leg_ord) OVER (PARTITION BY feature_ord, hazard_id) AS first, leg_ord = max(leg_ord) OVER (PARTITION BY feature_ord, hazard_id) AS last FROM legs, hazards WHERE radius > 0 AND penalty > 0),
events AS (SELECT feature_ord, hazard_id, penalty, CAST(sum(CASE WHEN a_in <> b_in THEN 1 WHEN a_in THEN 0 WHEN near THEN 2 ELSE 0 END) AS BIGINT) AS crossings, sum((first AND a_in)::INT + (last AND b_in)::INT) AS ends, bool_or(near OR a_in OR b_in) AS enters FROM met GROUP BY ALL)"""


@query("flt08_hazard_enters", EVENTS + "SELECT feature_ord, hazard_id FROM events WHERE enters")
def hazard_enters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hazard_events(view(spark, sf_dir, "legs"), hazards(spark)).select("feature_ord", "hazard_id")


@query("agg09_hazard_crossings", EVENTS + "SELECT feature_ord, hazard_id, crossings, CAST((crossings + ends) // 2 AS BIGINT) AS visits FROM events WHERE enters")
def hazard_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hazard_events(view(spark, sf_dir, "legs"), hazards(spark)).select("feature_ord", "hazard_id", "crossings", "visits")


@query("rte11_hazard_cost", EVENTS + "SELECT feature_ord, sum(crossings * penalty / 2) AS edge_cost, CAST(sum((crossings + ends) // 2 * penalty) AS DOUBLE) AS route_cost FROM events WHERE enters GROUP BY feature_ord")
def hazard_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the penalty for each crossing of an edge; the whole for each visit of a route."""
    met = rules.hazard_events(view(spark, sf_dir, "legs"), hazards(spark))
    return met.groupBy("feature_ord").agg(F.sum(F.col("crossings") * F.col("penalty") / 2).alias("edge_cost"), F.sum(F.col("visits") * F.col("penalty")).alias("route_cost"))


@query("fun14_distance_cost", EVENTS + f""", length AS (SELECT feature_ord, sum({LENGTH}) AS meters FROM legs GROUP BY feature_ord),
cost AS (SELECT feature_ord, sum(crossings * penalty / 2) AS extra FROM events GROUP BY feature_ord)
SELECT l.feature_ord, round(meters + coalesce(extra, 0), 3) AS cost FROM length l LEFT JOIN cost c ON c.feature_ord = l.feature_ord""")
def distance_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of each feature and its hazards."""
    legs = measured_legs(spark, sf_dir)
    extra = rules.hazard_events(legs, hazards(spark)).groupBy("feature_ord").agg(F.sum(F.col("crossings") * F.col("penalty") / 2).alias("extra"))
    lengths = legs.groupBy("feature_ord").agg(F.sum("meters").alias("meters")).join(extra, "feature_ord", "left")
    return lengths.select("feature_ord", F.round(F.col("meters") + F.coalesce("extra", F.lit(0.0)), 3).alias("cost"))


@query("agg10_access_score", """SELECT ride_id, round((shared_m + access_m * CASE WHEN shared_m > 0.01 THEN 8 ELSE 50 END + greatest(0, access_m - 125) * 400) * CASE ride_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 1 END, 3) AS score FROM rides""")
def access_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.when(F.col("ride_id") % 3 == 0, F.array(F.lit("SharedRoadways"), F.lit("ParkConnectors"))).when(F.col("ride_id") % 3 == 1, F.array(F.lit("SharedRoadways"))).otherwise(F.array(F.lit("TrailBranches")))
    return view(spark, sf_dir, "rides").select("ride_id", F.round(rules.access_score("shared_m", "access_m", roles), 3).alias("score"))


@query("agg11_route_rating", "SELECT ride_id, round(greatest(0, meters - access_m - shared_m) + shared_m * 12 + access_m * 8 + greatest(0, meters - (target_m / 3 * 2 + 400)) * 20 + 7, 3) AS rating FROM rides")
def route_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", F.round(rules.route_rating("meters", "access_m", "shared_m", F.col("target_m") / 3, 0.0, 7.0), 3).alias("rating"))


PENALTY = "CASE WHEN overlap_m > 0 THEN least(least(overlap_m, meters), meters * 0.1::DOUBLE) * 0.25 + least(greatest(0, least(overlap_m, meters) - meters * 0.1::DOUBLE), meters * 0.25::DOUBLE - meters * 0.1::DOUBLE) + greatest(0, least(overlap_m, meters) - meters * 0.25::DOUBLE) * 3 ELSE 0 END"


@query("agg13_overlap_penalty", f"SELECT ride_id, round({PENALTY}, 3) AS penalty FROM rides")
def overlap_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", F.round(rules.overlap_penalty("meters", "overlap_m"), 3).alias("penalty"))


@query("agg12_best_candidate", f"""
, s AS (SELECT *, abs(meters - target_m) AS error, abs(meters - target_m) * 6 + access_m * 0.15::DOUBLE + shared_m * 2.5 + ({PENALTY}) * 5 + access_m * 3 AS score FROM rides)
SELECT rider, ride_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY ride_id % 5 = 0, NOT (error <= greatest(160, target_m * 0.1::DOUBLE)), round(score, 6), title, ride_id) AS n FROM s) WHERE n = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each rider's rides as candidates; every fifth enters a hazard."""
    rides = view(spark, sf_dir, "rides").withColumn("error", F.abs(F.col("meters") - F.col("target_m")))
    rides = rides.withColumns({"hazard": F.col("ride_id") % 5 == 0, "within": F.col("error") <= geo.loop_tolerance("target_m"), "score": rules.candidate_score("error", "access_m", "shared_m", "meters", "overlap_m", "access_m"), "signature": F.struct("title", "ride_id")})
    return rules.best_candidate(rides, "rider", "hazard", "within", "score", "signature").select("rider", "ride_id", F.round("score", 3).alias("score"))


@query("agg14_shape_penalty", f"""
, d AS (SELECT feature_ord, vertex_ord, {sql_haversine('first_value(lat) OVER w', 'first_value(lon) OVER w', 'lat', 'lon')} AS d FROM points WINDOW w AS (PARTITION BY feature_ord ORDER BY vertex_ord)),
f AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY feature_ord ORDER BY vertex_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM (SELECT *, CASE WHEN d >= 180 THEN 1 WHEN d <= 75 THEN 0 END AS event FROM d)),
x AS (SELECT feature_ord, sum((event IS NOT NULL AND event = 1 AND was = 0)::INT) AS n, max(d) AS reach FROM f GROUP BY feature_ord),
legs2 AS (SELECT feature_ord, a_id, b_id, leg_ord FROM legs),
turns AS (SELECT feature_ord, sum(back::INT) AS t FROM (SELECT feature_ord, coalesce(lag(a_id) OVER w = b_id AND lag(b_id) OVER w = a_id, false) AS back FROM legs2 WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord)) GROUP BY feature_ord)
SELECT x.feature_ord, round(greatest(0, 300 - reach) * 2 + greatest(0, n - 1) * 450 + greatest(0, coalesce(t, 0) - 1) * 1125, 3) AS penalty FROM x LEFT JOIN turns ON turns.feature_ord = x.feature_ord""")
def shape_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties of every feature as a loop of 1.5 km."""
    points = view(spark, sf_dir, "points")
    w = sequence.along("feature_ord", "vertex_ord")
    far = points.withColumn("d", geo.haversine(F.first("lat").over(w), F.first("lon").over(w), "lat", "lon"))
    out = sequence.excursions(far, "d", F.lit(1500.0))
    turns = sequence.traversal_shape(view(spark, sf_dir, "legs")).groupBy("feature_ord").agg(F.sum(F.col("u_turn").cast("int")).alias("turns"))
    return out.join(turns, "feature_ord", "left").select("feature_ord", F.round(rules.shape_penalty("reach", "excursions", "turns", F.lit(1500.0)), 3).alias("penalty"))


@query("agg06_route_key", STEMS + """
SELECT feature_ord, 'exercise:' || string_agg(u || '-' || v || ':' || mm, '|' ORDER BY CAST(u || '-' || v AS VARCHAR)) AS key FROM (
  SELECT feature_ord, u, v, CAST(floor(sum(meters) * 1000 + 0.5) AS BIGINT) AS mm FROM measured GROUP BY feature_ord, u, v) GROUP BY feature_ord""")
def route_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route's edges with their millimetres, in order of the edge key."""
    legs = measured_legs(spark, sf_dir).withColumn("edge", F.concat_ws("-", F.least("a_id", "b_id").cast("string"), F.greatest("a_id", "b_id").cast("string")))
    return network.route_keys(legs, "feature_ord", "edge")


@query("agg16_exclusions", "SELECT CASE WHEN (feature_ord % 4 < 2 AND feature_ord % 3 <> 0) OR feature_ord % 5 = 0 THEN 'access-or-service' WHEN n < 2 THEN 'fewer-than-two-points' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT f.feature_ord, (SELECT count(*) FROM points p WHERE p.feature_ord = f.feature_ord) AS n FROM features f) GROUP BY reason")
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why features are left out, counted by reason."""
    counts = view(spark, sf_dir, "points").groupBy("feature_ord").agg(F.count("*").alias("n_points"))
    rows = view(spark, sf_dir, "features").join(counts, "feature_ord", "left")
    reason = F.when(~rules.osm_access(tags()), "access-or-service").when(F.coalesce("n_points", F.lit(0)) < 2, "fewer-than-two-points").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("agg17_layer_counts", "SELECT role AS layer, count(*) AS n, 100 AS expected, count(*) = 100 AS agrees FROM features GROUP BY role UNION ALL SELECT 'Absent', 0, 5, false")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by layer against a manifest; layers of either side only are told too."""
    manifest = spark.createDataFrame([("TrailBranches", 100), ("ParkConnectors", 100), ("SharedRoadways", 100), ("Absent", 5)], "layer string, expected int")
    counts = view(spark, sf_dir, "features").groupBy(F.col("role").alias("layer")).agg(F.count("*").alias("n"))
    joined = counts.join(manifest, "layer", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("layer", "n", "expected", rules.told(F.col("n") == F.col("expected")).alias("agrees"))


@query("agg19_tile_statistics", "SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, list_sort(list(n))[CAST(count(*) // 2 + 1 AS BIGINT)] AS median, count(*) AS tiles FROM (SELECT count(*) AS n FROM points GROUP BY floor(lat * 100), floor(lon * 100))")
def tile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, largest and upper median of the vertices of a tile.

    The median is told from a histogram of sizes, so no list of tiles is built."""
    row, col = geo.tile_key("lat", "lon")
    sizes = view(spark, sf_dir, "points").groupBy(row.alias("r"), col.alias("c")).agg(F.count("*").alias("n"))
    histogram = sizes.groupBy("n").agg(F.count("*").alias("tiles"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.withColumns({"upto": F.sum("tiles").over(w), "all": F.sum("tiles").over(Window.partitionBy())})
    return ranked.agg(F.sum(F.col("n") * F.col("tiles")).alias("total"), F.max("n").alias("largest"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("all").alias("tiles"))


@query("agg20_categories", """SELECT CASE WHEN facility IN ('BikeLane', 'UrbanTrail', 'SharedLane') THEN facility ELSE 'Other published' END AS label,
  CAST(min(CASE facility WHEN 'BikeLane' THEN 1 WHEN 'UrbanTrail' THEN 2 WHEN 'SharedLane' THEN 3 ELSE 5 END) AS INTEGER) AS place, count(*) AS n FROM features GROUP BY label""")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category in a fixed order, all else last; empty categories are left out."""
    wanted = ["BikeLane", "UrbanTrail", "SharedLane", "Ferry"]
    order = F.array(*map(F.lit, wanted))
    place = F.array_position(order, F.col("facility")).cast("int")
    rows = view(spark, sf_dir, "features").select(F.when(place > 0, F.col("facility")).otherwise("Other published").alias("label"), F.when(place > 0, place).otherwise(len(wanted) + 1).alias("place"))
    return rows.groupBy("label", "place").agg(F.count("*").alias("n"))


@query("agg23_distinct_by", "SELECT rider, title, min(ride_id) AS ride_id FROM rides GROUP BY rider, title")
def distinct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ride of each title of a rider."""
    return network.first_of(view(spark, sf_dir, "rides"), ["rider", "title"], ["ride_id"]).select("rider", "title", "ride_id")


@query("top06_newest_first", """SELECT rider, key, used_ms FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY used_ms DESC, ride_id) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY rider, key ORDER BY used_ms DESC, ride_id) AS own FROM (SELECT *, ride_id % 7 AS key FROM rides)) WHERE own = 1) WHERE n <= 5""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of each rider's distinct rides."""
    rides = view(spark, sf_dir, "rides").withColumn("key", F.col("ride_id") % 7)
    newest = network.first_of(rides, ["rider", "key"], [F.desc("used_ms"), F.asc("ride_id")])
    return network.top_of(newest, ["rider"], [F.desc("used_ms"), F.asc("ride_id")], 5).select("rider", "key", "used_ms")


@query("top07_recent", f"""SELECT rider, ride_id FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY used_ms DESC, ride_id) AS n FROM rides r WHERE {NOW_MS} - used_ms <= {900 * DAY}
  AND NOT EXISTS (SELECT 1 FROM rides s WHERE s.rider = r.rider AND s.title = r.title AND s.ride_id % 10 = 0)) WHERE n <= 20""")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rides of each rider in 900 days that are not saved (every tenth is)."""
    rides = view(spark, sf_dir, "rides")
    saved = rides.where("ride_id % 10 = 0").select("rider", "title").distinct()
    fresh = rides.where(F.lit(NOW_MS) - F.col("used_ms") <= 900 * DAY).join(saved, ["rider", "title"], "left_anti")
    return network.top_of(fresh, ["rider"], [F.desc("used_ms"), F.asc("ride_id")], 20).select("rider", "ride_id")


@query("flt21_visible", f"SELECT ride_id FROM rides r WHERE {NOW_MS} - used_ms <= {900 * DAY} AND NOT EXISTS (SELECT 1 FROM rides s WHERE s.rider = r.rider AND s.title = r.title AND s.ride_id % 10 = 0)")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = view(spark, sf_dir, "rides")
    saved = rides.where("ride_id % 10 = 0").select("rider", "title").distinct()
    return rides.where(F.lit(NOW_MS) - F.col("used_ms") <= 900 * DAY).join(saved, ["rider", "title"], "left_anti").select("ride_id")


@query("fun15_recency", f"SELECT ride_id, round(pow(0.5::DOUBLE, greatest(0, {NOW_MS} - used_ms) / 86400000::DOUBLE / 21), 9) AS weight FROM rides")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a ride, halved every 21 days."""
    return view(spark, sf_dir, "rides").select("ride_id", F.round(geo.recency_weight((F.lit(NOW_MS) - F.col("used_ms")) / DAY), 9).alias("weight"))


@query("fun16_tolerance", "SELECT ride_id, round(greatest(160, target_m / 10 * 0.1::DOUBLE), 6) AS tolerance FROM rides")
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", F.round(geo.loop_tolerance(F.col("target_m") / 10), 6).alias("tolerance"))


BEARING = "fmod(degrees(atan2(sin(radians({1}) - radians({0})) * cos(radians({3})), cos(radians({2})) * sin(radians({3})) - sin(radians({2})) * cos(radians({3})) * cos(radians({1}) - radians({0})))) + 360, 360)"
LEG_BEARING = BEARING.format("a_lon", "b_lon", "a_lat", "b_lat")


@query("fun06_bearing", f"SELECT feature_ord, leg_ord, round(fmod({LEG_BEARING}, 360), 6) AS bearing FROM legs")
def bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "legs").select("feature_ord", "leg_ord", F.round(geo.bearing("a_lat", "a_lon", "b_lat", "b_lon"), 6).alias("bearing"))


@query("fun07_bearing_bucket", "SELECT feature_ord, leg_ord, CASE WHEN dx = 0 AND dy > 0 THEN 0 WHEN dx > 0 AND dy > 0 THEN 1 WHEN dx > 0 AND dy = 0 THEN 2 WHEN dx > 0 AND dy < 0 THEN 3 WHEN dx = 0 THEN 4 WHEN dx < 0 AND dy < 0 THEN 5 WHEN dx < 0 AND dy = 0 THEN 6 ELSE 7 END AS bucket FROM (SELECT *, b_id // 10000 - a_id // 10000 AS dx, b_id % 10000 - a_id % 10000 AS dy FROM legs)")
def bearing_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight directions on the lattice, told from rounded coordinates so that diagonals do not wobble."""
    ends = [F.floor(F.col("a_id") % 10000).cast("double"), F.floor(F.col("a_id") / 10000).cast("double"), F.floor(F.col("b_id") % 10000).cast("double"), F.floor(F.col("b_id") / 10000).cast("double")]
    return view(spark, sf_dir, "legs").select("feature_ord", "leg_ord", geo.bearing_bucket(*ends).alias("bucket"))


TURNS = MEASURED + f", b AS (SELECT feature_ord, leg_ord, {LEG_BEARING} AS bearing FROM measured), t AS (SELECT *, fmod(bearing - lag(bearing) OVER (PARTITION BY feature_ord ORDER BY leg_ord) + 540, 360) - 180 AS delta FROM b)"


@query("fun08_turn_delta", TURNS + "SELECT feature_ord, leg_ord, round(abs(delta), 5) AS delta FROM t WHERE delta IS NOT NULL")
def turn_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the turn between each leg and the one before."""
    return network.turns(view(spark, sf_dir, "legs")).where("delta is not null").select("feature_ord", "leg_ord", F.round(F.abs("delta"), 5).alias("delta"))


@query("fun09_maneuver", TURNS + """SELECT feature_ord, leg_ord, CASE WHEN abs(delta) < 60 THEN 'Slight' WHEN abs(delta) < 135 THEN 'Turn' ELSE 'Sharp' END || CASE WHEN delta > 0 THEN 'Right' ELSE 'Left' END AS maneuver FROM t WHERE abs(delta) >= 35 AND abs(abs(delta) - 180) > 1e-6""")
def maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of 35 degrees and more, without those that go straight back."""
    turned = network.turns(view(spark, sf_dir, "legs")).where(F.abs(F.abs("delta") - 180) > 1e-6)
    return turned.select("feature_ord", "leg_ord", geo.maneuver("delta").alias("maneuver")).where("maneuver is not null")


@query("fun04_source_frame", f"""SELECT feature_ord, leg_ord, CASE WHEN round((px * bx + py * by_) / len, 4) = 0 THEN 0::DOUBLE ELSE round((px * bx + py * by_) / len, 4) END AS along, round(abs(px * by_ - py * bx) / len, 4) AS across FROM (
  SELECT *, sqrt(bx * bx + by_ * by_) AS len FROM (SELECT feature_ord, leg_ord, (-89.17::DOUBLE - a_lon) * 111194.93::DOUBLE * cos(radians(a_lat)) AS px, (40.42::DOUBLE - a_lat) * 111194.93::DOUBLE AS py,
  (b_lon - a_lon) * 111194.93::DOUBLE * cos(radians(a_lat)) AS bx, (b_lat - a_lat) * 111194.93::DOUBLE AS by_ FROM legs))""")
def source_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point seen along and across every leg."""
    place = geo.source_frame(F.lit(40.42), F.lit(-89.17), "a_lat", "a_lon", "b_lat", "b_lon")
    along, across = (F.round(place[c], 4) for c in ("along", "across"))
    return view(spark, sf_dir, "legs").select("feature_ord", "leg_ord", F.when(along == 0, 0.0).otherwise(along).alias("along"), across.alias("across"))


@query("fun12_interpolate", "SELECT feature_ord, leg_ord, round(a_lat + (b_lat - a_lat) * 0.3::DOUBLE, 8) AS lat, round(a_lon + (b_lon - a_lon) * 0.3::DOUBLE, 8) AS lon FROM legs")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = geo.interpolate("a_lat", "a_lon", "b_lat", "b_lon", 0.3)
    return view(spark, sf_dir, "legs").select("feature_ord", "leg_ord", F.round(point["lat"], 8).alias("lat"), F.round(point["lon"], 8).alias("lon"))


@query("rte24_traversal_pieces", SHAPE + """
, placed AS (SELECT *, coalesce(sum(meters) OVER (PARTITION BY feature_ord ORDER BY leg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts_at FROM shape),
c AS (SELECT *, coalesce(leg_index <> lag(leg_index) OVER w OR repeats <> lag(repeats) OVER w, false)::INT AS cut FROM placed WINDOW w AS (PARTITION BY feature_ord ORDER BY leg_ord)),
p AS (SELECT *, sum(cut) OVER (PARTITION BY feature_ord ORDER BY leg_ord) AS piece FROM c)
SELECT feature_ord, CAST(piece AS BIGINT) AS piece, CAST(leg_index AS BIGINT) AS leg_index, repeats, count(*) AS n_legs, round(min(starts_at), 3) AS starts_at, round(max(starts_at + meters), 3) AS ends_at FROM p GROUP BY feature_ord, piece, leg_index, repeats""")
def traversal_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each feature between turns back and where it repeats itself."""
    out = sequence.traversal_pieces(measured_legs(spark, sf_dir))
    return out.select("feature_ord", "piece", "leg_index", "repeats", "n_legs", F.round("starts_at", 3).alias("starts_at"), F.round("ends_at", 3).alias("ends_at"))


@query("grf16_reverse", LEGS + "SELECT feature_ord, CAST(row_number() OVER (PARTITION BY feature_ord ORDER BY leg_ord DESC) AS INTEGER) AS leg_ord, b_id AS a_id, a_id AS b_id FROM placed")
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature ridden the other way."""
    return network.reversed_legs(view(spark, sf_dir, "legs")).select("feature_ord", "leg_ord", "a_id", "b_id")
