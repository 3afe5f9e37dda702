"""Queries over the network: legs, spatial joins, graph and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellpath.functions import geo
from fellpath.operators import network, rules, sequence
from fellpath.plans.projection import view
from fellpath.plans.registry import query, sql_haversine, sql_segment
from fellpath.plans.staging import materialise

LENGTH = sql_haversine("a_lat", "a_lon", "b_lat", "b_lon")
MEASURED = f", measured AS (SELECT *, {LENGTH} AS meters, least(a_id, b_id) AS u, greatest(a_id, b_id) AS v FROM legs)"
EDGES = MEASURED + ", edges AS (SELECT u, v, min(meters) AS meters, count(*) AS n_legs FROM measured GROUP BY u, v)"
BOTH = EDGES + ", both_ways AS (SELECT u, v, meters FROM edges UNION ALL SELECT v, u, meters FROM edges)"


def measured_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.with_length(view(spark, sf_dir, "legs"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.undirected_edges(measured_legs(spark, sf_dir))


@query("jon04_nearest_snap", MEASURED + f"""
, d AS (SELECT point_id, feature_ord, leg_ord, {sql_segment('lat', 'lon', 'd')} AS distance FROM query_points, legs
  WHERE abs(lat - (a_lat + b_lat) / 2) < 0.003 AND abs(lon - (a_lon + b_lon) / 2) < 0.004)
SELECT point_id, feature_ord, leg_ord, round(distance, 4) AS distance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 6), feature_ord, leg_ord) AS INTEGER) AS rank
  FROM d WHERE distance <= 150) WHERE rank <= 3""")
def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest legs of every query point within 150 m."""
    ranked = network.nearest_legs(view(spark, sf_dir, "query_points"), view(spark, sf_dir, "legs"), 3, 150.0)
    return ranked.select("point_id", "feature_ord", "leg_ord", F.round("distance", 4).alias("distance"), "rank")


@query("flt02_proximity", f"""
SELECT feature_ord FROM query_points, legs
WHERE abs(lat - (a_lat + b_lat) / 2) < 0.003 AND abs(lon - (a_lon + b_lon) / 2) < 0.004 AND {sql_segment('lat', 'lon', 'd')} <= 60
UNION SELECT p.feature_ord FROM query_points q, points p WHERE abs(q.lat - p.lat) < 0.001 AND abs(q.lon - p.lon) < 0.001 AND {sql_haversine('q.lat', 'q.lon', 'p.lat', 'p.lon')} <= 60""")
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a leg or a vertex within 60 m of any query point."""
    return network.features_in_reach(view(spark, sf_dir, "query_points"), view(spark, sf_dir, "legs"), view(spark, sf_dir, "points"), 60.0)


@query("jon05_map_tap", f"""
, d AS (SELECT point_id, feature_ord, leg_ord, {sql_segment('lat', 'lon', 'd')} AS distance FROM query_points, legs
  WHERE abs(lat - (a_lat + b_lat) / 2) < 0.002 AND abs(lon - (a_lon + b_lon) / 2) < 0.002),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 6), feature_ord, leg_ord) AS n FROM d WHERE distance <= 20) WHERE n = 1)
SELECT q.point_id, n.feature_ord IS NOT NULL AS snapped, coalesce(f.name, CASE WHEN n.feature_ord IS NULL THEN 'Map point' ELSE 'Trail' END) AS label
FROM query_points q LEFT JOIN near n ON q.point_id = n.point_id LEFT JOIN features f ON f.feature_ord = n.feature_ord""")
def map_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tapped point: snapped within 20 m or left where it is, with a label."""
    points, features = view(spark, sf_dir, "query_points"), view(spark, sf_dir, "features").select("feature_ord", "name")
    best = network.nearest_legs(points, view(spark, sf_dir, "legs"), 1, 20.0).select("point_id", "feature_ord")
    labelled = points.join(best, "point_id", "left").join(features, "feature_ord", "left")
    label = F.coalesce("name", F.when(F.col("feature_ord").isNull(), "Map point").otherwise("Trail"))
    return labelled.select("point_id", F.col("feature_ord").isNotNull().alias("snapped"), label.alias("label"))


@query("jon01_vertex_snap")
def vertex_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of each snapped node, on walks of which every second lattice line is 11 m from the last.

    No SQL: whether a vertex is a node depends on all nodes before it; tests hold
    it against the ordered pass."""
    snapped = network.snap_vertices(close_points(spark, sf_dir))
    return snapped.groupBy("node_feature", "node_vertex").agg(F.count("*").alias("n_vertices"))


def close_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices drawn together to steps of 11 m north and 21 m east."""
    row, col = F.col("node_id") % 10000 - 500, F.floor(F.col("node_id") / 10000) - 500
    return view(spark, sf_dir, "points").select("feature_ord", "vertex_ord", (F.lit(40.4) + row * 0.0001).alias("lat"), (F.lit(-89.2) + col * 0.00025).alias("lon"))


@query("agg01_path_length", MEASURED + "SELECT feature_ord, round(sum(meters), 3) AS meters FROM measured GROUP BY feature_ord")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_legs(spark, sf_dir).groupBy("feature_ord").agg(F.round(F.sum("meters"), 3).alias("meters"))


ACCESS = "CASE WHEN leg_ord % 4 = 0 THEN meters * 0.25::DOUBLE ELSE 0 END"


@query("agg02_route_totals", MEASURED + f"""
SELECT m.feature_ord, round(sum(meters), 3) AS meters, round(sum({ACCESS}), 3) AS access_meters, round(sum(CASE WHEN f.role = 'SharedRoadways' THEN greatest(0, meters - {ACCESS}) ELSE 0 END), 3) AS shared_meters
FROM measured m JOIN features f ON f.feature_ord = m.feature_ord GROUP BY m.feature_ord""")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of each feature, its access metres (a quarter of every fourth leg), and those on shared roadways."""
    joined = measured_legs(spark, sf_dir).join(view(spark, sf_dir, "features").select("feature_ord", F.array("role").alias("roles")), "feature_ord")
    out = network.totals(joined.withColumn("access", F.when(F.col("leg_ord") % 4 == 0, F.col("meters") * 0.25).otherwise(0.0)))
    return out.select("feature_ord", *(F.round(c, 3).alias(c) for c in ("meters", "access_meters", "shared_meters")))


@query("agg03_self_overlap", MEASURED + """
, s AS (SELECT *, sum(meters) OVER (PARTITION BY feature_ord) AS whole, coalesce(sum(meters) OVER (PARTITION BY feature_ord ORDER BY leg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM measured),
h AS (SELECT *, least(150, whole * 0.025::DOUBLE) AS stem, meters - greatest(0, least(meters, least(150, whole * 0.025::DOUBLE) - before)) AS rest FROM s),
t AS (SELECT *, coalesce(sum(rest) OVER (PARTITION BY feature_ord ORDER BY leg_ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM h),
k AS (SELECT feature_ord, u, v, rest - greatest(0, least(rest, stem - after)) AS m FROM t)
SELECT feature_ord, round(sum(total - longest), 3) AS self_overlap
FROM (SELECT feature_ord, u, v, sum(m) AS total, max(m) AS longest FROM k WHERE m > 0 GROUP BY feature_ord, u, v) GROUP BY feature_ord""")
def self_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres that repeat an earlier stretch, less the stems at both ends."""
    legs = measured_legs(spark, sf_dir).withColumns({"u": F.least("a_id", "b_id"), "v": F.greatest("a_id", "b_id")})
    out = network.self_overlap(sequence.without_stems(legs))
    return out.select("feature_ord", F.round("self_overlap", 3).alias("self_overlap"))


@query("grf03_adjacency", BOTH + "SELECT u, count(*) AS n_neighbours, round(sum(meters), 3) AS meters FROM both_ways GROUP BY u")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.adjacency(edges(spark, sf_dir)).groupBy("u").agg(F.count("*").alias("n_neighbours"), F.round(F.sum("meters"), 3).alias("meters"))


@query("grf01_edges", EDGES + "SELECT u, v, round(meters, 4) AS meters, n_legs FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("u", "v", F.round("meters", 4).alias("meters"), "n_legs")


@query("agg07_junctions", BOTH + "SELECT u AS node_id, count(DISTINCT v) AS degree FROM both_ways GROUP BY u HAVING count(DISTINCT v) >= 3")
def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(edges(spark, sf_dir)).where("degree >= 3")



WALK = """
labels AS (
  WITH RECURSIVE walk(node, label) USING KEY (node) AS (
    SELECT u, u FROM adj GROUP BY u
    UNION
    SELECT a.v, min(w.label) FROM walk w JOIN adj a ON a.u = w.node JOIN recurring.walk r ON r.node = a.v WHERE w.label < r.label GROUP BY a.v)
  SELECT node, label FROM walk)"""


@query("grf04_components", "\n, adj AS (SELECT DISTINCT a_id AS u, b_id AS v FROM legs UNION SELECT b_id, a_id FROM legs)," + WALK + " SELECT node AS node_id, label AS component_id FROM labels")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the whole network."""
    return network.components(edges(spark, sf_dir))


@query("agg18_part_summary", MEASURED + ", adj AS (SELECT DISTINCT u, v FROM measured UNION SELECT v, u FROM measured)," + WALK + """
SELECT l.label AS component_id, count(DISTINCT feature_ord) AS n_features, count(*) AS n_legs, round(sum(k.meters) / 1000, 6) AS km, round((SELECT sum(meters) FROM measured) / 1000, 4) AS total_km FROM measured k JOIN labels l ON l.node = k.u GROUP BY l.label""")
def part_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, legs and kilometres of each component, and kilometres in all."""
    legs = measured_legs(spark, sf_dir)
    out = network.part_summary(legs, network.components(network.undirected_edges(legs)))
    return out.select("component_id", "n_features", "n_legs", F.round("km", 6).alias("km"), F.round("total_km", 4).alias("total_km"))


SEARCH = EDGES + """
, ask AS (SELECT a.node_id AS start, b.node_id AS goal FROM points a JOIN points b ON b.feature_ord = a.feature_ord + 1 AND b.vertex_ord = 1 WHERE a.feature_ord % 100 = 0 AND a.vertex_ord = 1 GROUP BY ALL),
starts AS (SELECT DISTINCT start FROM ask),
adj AS (SELECT u, v, meters FROM edges UNION ALL SELECT v, u, meters FROM edges),
dist AS (
  WITH RECURSIVE walk(start, node, cost) USING KEY (start, node) AS (
    SELECT start, start, 0::DOUBLE FROM starts
    UNION
    SELECT w.start, a.v, min(w.cost + a.meters) FROM walk w JOIN adj a ON a.u = w.node
      LEFT JOIN recurring.walk r ON r.start = w.start AND r.node = a.v
    WHERE r.cost IS NULL OR w.cost + a.meters < r.cost - 1e-9 GROUP BY w.start, a.v)
  SELECT * FROM walk)
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches (start, node): from the first vertex of each feature whose
    number is divisible by 100 to that of the next feature."""
    points = view(spark, sf_dir, "points").where("vertex_ord = 1")
    heads = points.where("feature_ord % 100 = 0").select((F.col("feature_ord") + 1).alias("feature_ord"), F.col("node_id").alias("start"))
    return heads.join(points.select("feature_ord", F.col("node_id").alias("node")), "feature_ord").select("start", "node").distinct()


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The query set, the graph, and the labels of the searches from its starts to its goals."""
    goals = materialise(asked(spark, sf_dir), "asked")
    legs = measured_legs(spark, sf_dir)
    graph = materialise(network.undirected_edges(legs).select("u", "v", F.col("meters").alias("cost")), "graph")
    found = network.shortest_paths(graph, goals.select("start").distinct(), goals=goals.withColumn("last", F.lit(0.0)), places=network.node_places(legs), every=True)
    return goals, graph, found


@query("grf08_shortest_path", SEARCH + "SELECT start, goal AS node, round(cost, 3) AS cost FROM ask JOIN dist USING (start) WHERE node = goal")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from every trail head of the query set to its destinations."""
    goals, _, found = searched(spark, sf_dir)
    return goals.join(found, ["start", "node"]).select("start", "node", F.round("cost", 3).alias("cost"))


@query("grf09_path", SEARCH + "SELECT start, goal, round(cost, 3) AS cost, round(cost, 3) AS along, true AS joined FROM ask JOIN dist USING (start) WHERE node = goal")
def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from each head to its destinations: its cost, the metres along its
    nodes, and whether each step of it is an edge."""
    goals, graph, found = searched(spark, sf_dir)
    nodes = network.path_nodes(found, goals)
    step = nodes.withColumn("next", F.lead("node").over(Window.partitionBy("start", "goal").orderBy(F.desc("place"))))
    steps = step.withColumns({"u": F.least("node", "next"), "v": F.greatest("node", "next")}).join(graph.select("u", "v", F.col("cost").alias("step")), ["u", "v"], "left")
    along = steps.groupBy("start", "goal").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("along"), F.max(F.col("next").isNotNull() & F.col("step").isNull()).alias("broken"))
    out = goals.join(found, ["start", "node"]).withColumnRenamed("node", "goal").join(along, ["start", "goal"])
    return out.select("start", "goal", F.round("cost", 3).alias("cost"), F.round("along", 3).alias("along"), (~F.col("broken")).alias("joined"))


@query("rte03_direct_plan", EDGES + f"""
, requests AS (SELECT p.point_id AS request, p.lat AS f_lat, p.lon AS f_lon, q.lat AS t_lat, q.lon AS t_lon FROM query_points p JOIN query_points q ON q.point_id = p.point_id + 1 WHERE p.point_id % 100 = 0),
ends AS (SELECT request, 'f' AS side, f_lat AS lat, f_lon AS lon FROM requests UNION ALL SELECT request, 't', t_lat, t_lon FROM requests),
near AS (SELECT *, {sql_segment('lat', 'lon', 'd')} AS d, {sql_segment('lat', 'lon', 't')} AS t FROM ends, measured WHERE abs(lat - (a_lat + b_lat) / 2) < 0.009 AND abs(lon - (a_lon + b_lon) / 2) < 0.012),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, side ORDER BY round(d, 6), feature_ord, leg_ord) AS n FROM near WHERE d <= 800) WHERE n = 1),
entry AS (SELECT request, side, a_id AS node, meters * t AS cost FROM snap UNION ALL SELECT request, side, b_id, meters * (1 - t) FROM snap),
adj AS (SELECT u, v, meters FROM edges UNION ALL SELECT v, u, meters FROM edges),
dist AS (
  WITH RECURSIVE walk(start, node, cost) USING KEY (start, node) AS (
    SELECT request, node, min(cost) FROM entry WHERE side = 'f' GROUP BY request, node
    UNION
    SELECT w.start, a.v, min(w.cost + a.meters) FROM walk w JOIN adj a ON a.u = w.node LEFT JOIN recurring.walk r ON r.start = w.start AND r.node = a.v
    WHERE r.cost IS NULL OR w.cost + a.meters < r.cost - 1e-9 GROUP BY w.start, a.v)
  SELECT * FROM walk),
over AS (SELECT request, min(dist.cost + entry.cost) AS over FROM dist JOIN entry ON entry.request = dist.start AND entry.node = dist.node AND side = 't' GROUP BY request)
SELECT f.request, round(least(over, CASE WHEN f.u = t.u AND f.v = t.v THEN abs(CASE WHEN f.a_id = f.u THEN f.t ELSE 1 - f.t END - CASE WHEN t.a_id = t.u THEN t.t ELSE 1 - t.t END) * f.meters END), 3) AS meters, round(f.d, 3) AS from_m, round(t.d, 3) AS to_m
FROM snap f JOIN snap t ON t.request = f.request AND t.side = 't' JOIN over ON over.request = f.request WHERE f.side = 'f'""")
def direct_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest way over the network from each 100th query point to the next point."""
    points = view(spark, sf_dir, "query_points")
    asked = points.where("point_id % 100 = 0").select(F.col("point_id").alias("request"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    asked = asked.join(points.select((F.col("point_id") - 1).alias("request"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")), "request")
    out = network.direct_plans(asked, view(spark, sf_dir, "legs"))
    return out.select("request", *(F.round(c, 3).alias(c) for c in ("meters", "from_m", "to_m")))


@query("fun13_edge_cost", MEASURED + f"""
SELECT feature_ord, round(sum((meters - access) * fac * com * CASE WHEN role = 'SharedRoadways' THEN 10 ELSE 1 END + (access - estimated) * 8 + estimated * 75 + greatest(0, estimated - 125) * 400), 2) AS cost FROM (
  SELECT m.feature_ord, meters, role, {ACCESS} AS access, CASE WHEN leg_ord % 4 = 0 THEN meters * 0.125::DOUBLE ELSE 0 END AS estimated,
    CASE facility WHEN 'BikeLane' THEN 1.15::DOUBLE WHEN 'SharedLane' THEN 1.35::DOUBLE WHEN 'Other' THEN 1.2::DOUBLE WHEN 'Unknown' THEN 1.1::DOUBLE ELSE 1::DOUBLE END AS fac,
    CASE comfort WHEN 'MostAdults' THEN 1.1::DOUBLE WHEN 'ExperiencedBicyclists' THEN 1.35::DOUBLE WHEN 'StrongAndFearless' THEN 1.75::DOUBLE WHEN 'Unknown' THEN 1.1::DOUBLE ELSE 1::DOUBLE END AS com
  FROM measured m JOIN features f ON f.feature_ord = m.feature_ord) GROUP BY feature_ord""")
def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cost of every feature; a quarter of every fourth leg is access, half of that unmapped."""
    joined = measured_legs(spark, sf_dir).join(view(spark, sf_dir, "features").select("feature_ord", F.array("role").alias("roles"), "facility", "comfort"), "feature_ord")
    access = F.when(F.col("leg_ord") % 4 == 0, F.col("meters") * 0.25).otherwise(0.0)
    cost = geo.edge_cost("meters", "facility", "comfort", "roles", access, access / 2)
    return joined.groupBy("feature_ord").agg(F.round(F.sum(cost), 2).alias("cost"))


@query("agg08_bounds", """
SELECT feature_ord, round(greatest(-85, (s + n) / 2 - greatest(n - s, 0.002::DOUBLE) * 0.58::DOUBLE), 9) AS south, round(least(85, (s + n) / 2 + greatest(n - s, 0.002::DOUBLE) * 0.58::DOUBLE), 9) AS north,
  round(greatest(-180, (w + e) / 2 - greatest(e - w, 0.002::DOUBLE) * 0.58::DOUBLE), 9) AS west, round(least(180, (w + e) / 2 + greatest(e - w, 0.002::DOUBLE) * 0.58::DOUBLE), 9) AS east
FROM (SELECT feature_ord, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM points GROUP BY feature_ord)""")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewport of every feature: at least 0.002 degree wide, 8 % more on each side."""
    out = network.viewports(view(spark, sf_dir, "points"))
    return out.select("feature_ord", *(F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")))


@query("jon30_tile_window", """
, wanted AS (SELECT DISTINCT CAST(floor(lat * 100) AS BIGINT) + dy AS tr, CAST(floor(lon * 100) AS BIGINT) + dx AS tc FROM query_points, (VALUES (-1), (0), (1)) y(dy), (VALUES (-1), (0), (1)) x(dx))
SELECT feature_ord, count(*) AS n_vertices FROM points p WHERE EXISTS (SELECT 1 FROM wanted WHERE tr = floor(p.lat * 100) AND tc = floor(p.lon * 100)) GROUP BY feature_ord""")
def tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices in the 3 x 3 tiles around every query point."""
    row, col = geo.tile_key("lat", "lon")
    asked = view(spark, sf_dir, "query_points").select(row.alias("row"), col.alias("col")).distinct()
    asked = asked.select(F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), "col")
    asked = asked.select("row", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col")).distinct()
    points = view(spark, sf_dir, "points").withColumns({"row": row, "col": col})
    return points.join(asked, ["row", "col"], "left_semi").groupBy("feature_ord").agg(F.count("*").alias("n_vertices"))


@query("flt01_layers", "SELECT feature_ord, status, role FROM features WHERE status <> 'Proposed' AND role IN ('TrailBranches', 'ParkConnectors')")
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the enabled layers; proposed ones are off by default."""
    features = view(spark, sf_dir, "features")
    return features.where(rules.layer_enabled("status", F.array("role"), ["TrailBranches", "ParkConnectors"])).select("feature_ord", "status", "role")
