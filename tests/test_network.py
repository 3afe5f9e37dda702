"""Hand-worked cases and brute force of the network operators."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fellpath.functions import geo, text
from fellpath.operators import address, advisories, changes, closures, graph, history, instructions, network, records, rules, sequence
from fellpath.sources import formats, tiles
from fellpath.plans import projection
from fellpath.streaming import deviation

NORTH = 1 / 111_195


def meters(a, b):
    return float(deviation._metres(*a, *b))


def polylines(spark, paths):
    """paths: {feature: [(north metres, east metres)]} around 40 N, 89 W."""
    rows = [(f, i, 40 + y * NORTH, -89 + x * NORTH / math.cos(math.radians(40))) for f, path in paths.items() for i, (y, x) in enumerate(path)]
    return spark.createDataFrame(rows, "feature_ord long, vertex_ord long, lat double, lon double")


def greedy_nodes(points, tolerance):
    """The ordered pass: each vertex takes the first node in reach by cell, else becomes one."""
    lat_step, lon_step = tolerance / 111_320, tolerance / (111_320 * math.cos(0.70686))
    grid, out = {}, {}
    for f, v, lat, lon in sorted(points):
        r, c = math.floor(lat / lat_step), math.floor(lon / lon_step)
        hit = next((n for dr in (-1, 0, 1) for dc in (-1, 0, 1) for n in grid.get((r + dr, c + dc), []) if meters((n[2], n[3]), (lat, lon)) <= tolerance), None)
        if hit is None:
            hit = (f, v, lat, lon)
            grid.setdefault((r, c), []).append(hit)
        out[f, v] = hit[:2]
    return out


def test_snapping_takes_nodes_only(spark):
    got = {r.vertex_ord: r.node_vertex for r in network.snap_vertices(polylines(spark, {1: [(0, 0), (10, 0), (20, 0), (30, 0)]})).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_snapping_against_the_ordered_pass(spark):
    rng = random.Random(4)
    points = polylines(spark, {f: [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(6)] for f in range(20)})
    rows = [tuple(r) for r in points.collect()]
    got = {(r.feature_ord, r.vertex_ord): (r.node_feature, r.node_vertex) for r in network.snap_vertices(points).collect()}
    assert got == greedy_nodes(rows, 15.0) and len(set(got.values())) < len(got)


def test_graph_of_a_crossing(spark):
    """A line, and another that ends 8 m beside its middle: two connectors."""
    points = polylines(spark, {1: [(0, 0), (0, 50), (0, 100)], 2: [(8, 70), (100, 70)], 3: [(0, 100), (0, 100.001), (50, 100)]})
    nodes, edges = graph.build(points)
    assert nodes.count() == 6
    got = sorted((r.feature_ord, r.connector, round(r.meters, 1)) for r in edges.collect())
    assert got == [(1, False, 50.0), (1, False, 50.0), (1, True, 28.0), (1, True, 38.0), (2, False, 92.0), (3, False, 50.0)]


def test_connectors_are_found_once_for_each_line(spark, monkeypatch):
    """Copies of features on the same lines take the ways of the first; no line is projected for each of them."""
    paths = {1: [(0, 0), (0, 50), (0, 100)], 2: [(8, 70), (100, 70)], 3: [(0, 100), (50, 100)]}
    copies = paths | {f + 10 * k: p for f, p in paths.items() for k in range(1, 5)}
    met = []
    monkeypatch.setattr(network, "segments_in_reach", lambda points, legs, meters, f=network.segments_in_reach: met.append(legs.count()) or f(points, legs, meters))
    told = {}
    for name, own in (("once", paths), ("copies", copies)):
        rows = graph.build(polylines(spark, own))[1].collect()
        assert len({r.edge for r in rows}) == len(rows)
        told[name] = sorted((r.feature_ord % 10, r.u, r.v, round(r.meters, 6), r.connector) for r in rows)
    assert told["copies"] == sorted(5 * told["once"]) and any(r[-1] for r in told["once"])
    assert met[0] == met[1]


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 2.0), (3, 3, 0.0)], "u long, v long, cost double")
    parts = {r.node_id: r.component_id for r in network.components(edges).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    tree = network.shortest_paths(edges, spark.createDataFrame([(1,), (9,)], "start long"))
    got = {(r.start, r.node): (r.cost, r.hops, r.before) for r in tree.collect()}
    assert got == {(1, 1): (0.0, 0, None), (1, 2): (1.0, 1, 1), (1, 3): (2.0, 2, 2), (9, 9): (0.0, 0, None)}
    way = {r.place: r.node for r in network.path_nodes(tree, spark.createDataFrame([(1, 3)], "start long, node long")).collect()}
    assert way == {0: 3, 1: 2, 2: 1}
    assert {r.node for r in network.shortest_paths(edges, spark.createDataFrame([(1,)], "start long"), 1.5).collect()} == {1, 2}


def test_searches_in_tasks_agree_with_rounds(spark, monkeypatch):
    """Small networks are searched by tasks, start by start; labels are those of the rounds of joins."""
    rng = random.Random(5)
    rows = [(u, v, float(rng.randint(1, 9)), float(rng.randint(1, 5))) for u in range(60) for v in rng.sample(range(60), 3)]
    edges = spark.createDataFrame(rows, "u long, v long, cost double, meters double")
    starts = spark.createDataFrame([(1, 4, 0.5, 2.0), (1, 9, 0.0, 1.0), (2, 77, 1.0, 0.0), (3, None, 0.0, 0.0)], "start long, node long, cost double, meters double")
    goals = spark.createDataFrame([(1, 30, 1.0), (1, 31, 9.0), (1, 90, 0.0), (2, 77, 0.0)], "start long, node long, last double")

    def labels(**more):
        return {(r.start, r.node): (r.cost, r.hops, r.before, r.meters) for r in network.shortest_paths(edges, starts.where("node is not null"), 20.0, **more).collect()}

    calls = []
    monkeypatch.setattr(network, "_search", lambda *a, f=network._search: calls.append(1) or f(*a))
    mine, bounded = labels(), [labels(goals=goals, every=every) for every in (False, True)]
    assert not calls
    monkeypatch.setattr(network, "BROADCAST_STEPS", 0)
    theirs = labels()
    assert calls and mine == theirs and len(mine) > 50
    for got in bounded:
        assert all(theirs[k] == x for k, x in got.items()) and (1, 30) in got and (2, 77) in got
        assert all(x[2] is None or (k[0], x[2]) in got for k, x in got.items())
    assert (1, 31) in bounded[1] and len(bounded[1]) < len(theirs)


@pytest.mark.parametrize("latitude", [0.0, 50.0, 70.0, -60.0])
def test_pairs_in_reach_at_any_latitude(spark, latitude):
    rng = random.Random(2)
    wide = math.cos(math.radians(latitude))
    legs = [(i, latitude + rng.uniform(0, 0.003), rng.uniform(0, 0.003) / wide) for i in range(40)]
    legs = spark.createDataFrame([(i, a, o, a + 0.0005, o + 0.0007 / wide) for i, a, o in legs], "leg_ord int, a_lat double, a_lon double, b_lat double, b_lon double")
    points = spark.createDataFrame([(i, latitude + rng.uniform(0, 0.003), rng.uniform(0, 0.003) / wide) for i in range(60)], "point_id int, lat double, lon double")
    got = {(r.point_id, r.leg_ord) for r in network.segments_in_reach(points, legs, 40.0).collect()}
    every = points.crossJoin(legs).where(geo.project_to_segment("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")["distance"] <= 40)
    assert got == {(r.point_id, r.leg_ord) for r in every.collect()} and got


def test_viewports(spark):
    points = spark.createDataFrame([(1, 40.0, -89.0), (2, 40.0, -89.0), (2, 40.1, -89.3), (3, float("nan"), 0.0), (4, 84.9999, 179.9999)], "feature_ord int, lat double, lon double")
    got = {r.feature_ord: tuple(round(x, 6) for x in r[1:]) for r in network.viewports(points).collect()}
    assert got[1] == (39.99884, 40.00116, -89.00116, -88.99884) and got[2] == (39.992, 40.108, -89.324, -88.976)
    assert got[4][1] == 85.0 and got[4][3] == 180.0 and 3 not in got


def test_stem_discount_and_overlap(spark):
    """Out and back over 1 km: 25 m of stem are taken from head and tail."""
    legs = spark.createDataFrame([(1, 1, 1, 2, 500.0), (1, 2, 2, 1, 500.0)], "feature_ord int, leg_ord int, u int, v int, meters double")
    legs = legs.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    assert [r.meters for r in sequence.without_stems(legs).orderBy("leg_ord").collect()] == [475.0, 475.0]
    assert network.self_overlap(sequence.without_stems(legs)).first().self_overlap == 475.0


def test_excursions_need_a_return(spark):
    rows = [(1, i, d) for i, d in enumerate([0, 100, 500, 300, 500, 80, 70, 400, 10])]
    got = sequence.excursions(spark.createDataFrame(rows, "feature_ord int, vertex_ord int, d int"), "d", F.lit(2000.0)).first()
    assert (got.excursions, got.reach) == (2, 500)


def test_slices_and_conversion(spark):
    legs = spark.createDataFrame([(1, k, 100.0, 10.0) for k in range(3)], "feature_ord int, leg_ord int, meters double, access double")
    got = [(r.leg_ord, r.meters, r.access) for r in sequence.slice_traversal(legs, F.lit(50.0), F.lit(200.0), ["access"]).orderBy("leg_ord").collect()]
    assert got == [(0, 50.0, 5.0), (1, 100.0, 10.0)]
    asked = spark.createDataFrame([(1, 150.0), (1, 999.0)], "feature_ord int, at double")
    assert [r.converted for r in sequence.convert_distance(legs, asked, "meters", "access").orderBy("at").collect()] == [15.0, 30.0]


def test_marks(spark):
    legs = polylines(spark, {1: [(0, 0), (0, 100), (0, 250)]})
    out = sequence.marks_along(network.pair_legs(legs.withColumn("node_id", F.col("vertex_ord"))), 110.0)
    assert [(r.mark, r.leg_ord) for r in out.orderBy("mark").collect()] == [(0, 0), (1, 1)]


def test_closures_on_hand_worked_paths(spark):
    points = polylines(spark, {1: [(0, 0), (0, 100), (0, 200), (0, 300)], 2: [(50, 0), (50, 100)]})
    where = {(r.feature_ord, r.vertex_ord): (r.lat, r.lon) for r in points.collect()}

    def closure(start, end, projected):
        return spark.createDataFrame([(1, 7, *start, *end, 0, projected, False)], "feature_ord long, closure_id int, from_lat double, from_lon double, to_lat double, to_lon double, active_ms int, projected boolean, crossing boolean")

    cut = closures.cut_at_vertices(points, closure(where[1, 2], where[1, 1], False))
    assert sorted((r.feature_ord, r.piece, r.vertex_ord) for r in cut.collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (2, 0, 0), (2, 0, 1)]
    between = [(a[0], (a[1] + b[1]) / 2) for a, b in ((where[1, 0], where[1, 1]), (where[1, 2], where[1, 3]))]
    pieces = closures.cut_at_bounds(points, closure(*between, True)).orderBy("piece", "place").collect()
    assert [(r.piece, round((r.lon + 89) / NORTH * math.cos(math.radians(40)))) for r in pieces] == [(0, 0), (0, 50), (1, 250), (1, 300)]
    section = closures.closed_section(points, closure(*reversed(between), True)).orderBy("place").collect()
    assert [round((r.lon + 89) / NORTH * math.cos(math.radians(40))) for r in section] == [50, 100, 200, 250]
    assert closures.cut_at_bounds(points, closure((41.0, -89.0), between[0], True)).count() == 0


def test_several_closures_on_one_feature(spark):
    points = polylines(spark, {1: [(0, 100 * k) for k in range(10)], 2: [(50, 100 * k) for k in range(10)], 3: [(90, 0), (90, 100)]})
    where = {(r.feature_ord, r.vertex_ord): (r.lat, r.lon) for r in points.collect()}
    schema = "feature_ord long, closure_id int, from_lat double, from_lon double, to_lat double, to_lon double, active_ms int, projected boolean, crossing boolean"

    def closed(spans, projected, share=0.0):
        def at(feature, k):
            return tuple(a + (b - a) * share for a, b in zip(where[feature, k], where[feature, min(k + 1, 9)], strict=True))

        return spark.createDataFrame([(f, n, *at(f, a), *at(f, b), 0, projected, False) for n, (f, a, b) in enumerate(spans)], schema)

    spans = [(1, 2, 4), (1, 8, 6), (2, 1, 3), (2, 3, 5), (2, 4, 7)]
    pieces = {}
    for r in closures.cut_at_vertices(points, closed(spans, False)).collect():
        pieces.setdefault((r.feature_ord, r.piece), []).append(r.vertex_ord)
    assert {k: sorted(v) for k, v in pieces.items()} == {(1, 0): [0, 1, 2], (1, 1): [4, 5, 6], (1, 2): [8, 9], (2, 0): [0, 1], (2, 2): [7, 8, 9], (3, 0): [0, 1]}
    pieces = {}
    for r in closures.cut_at_bounds(points, closed(spans[:2] + spans[2:3] + [(2, 2, 5)], True, 0.5)).collect():
        pieces.setdefault((r.feature_ord, r.piece), []).append(round((r.lon + 89) / NORTH * math.cos(math.radians(40))))
    assert {k: sorted(v) for k, v in pieces.items()} == {(1, 0): [0, 100, 200, 250], (1, 1): [450, 500, 600, 650], (1, 2): [850, 900], (2, 0): [0, 100, 150], (2, 1): [550, 600, 700, 800, 900]}


def test_ridden_sections(spark):
    """Runs of legs along a section count together; crossing it, touching a bound and lines beside it do not."""
    ways = {1: [(0, 0), (0, 50), (0, 50), (0, 51), (0, 300)], 2: [(-50, 100), (50, 100)], 3: [(0, -100), (0, 20)], 4: [(0.8, 0), (0.8, 300)], 5: [(0, 150), (0, 100), (40, 100), (0, 100), (0, 60)], 6: [(0, 199.995), (0, 400)]}
    points = polylines(spark, ways)
    w = Window.partitionBy("feature_ord").orderBy("vertex_ord")
    legs = points.select(F.col("feature_ord").alias("route"), F.lit(9).alias("feature_ord"), F.col("vertex_ord").alias("leg_ord"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon")).where("b_lat is not null")
    east = NORTH / math.cos(math.radians(40.0))
    line = (9, 7, 40.0, -89.0 + 20 * east, 40.0, -89.0 + 200 * east, 0, True, False)
    schema = "feature_ord int, closure_id int, from_lat double, from_lon double, to_lat double, to_lon double, active_ms int, projected boolean, crossing boolean"
    sections = spark.createDataFrame([line, line, (8, 6, *line[2:]), (9, 5, 40.0, -89.0, 40.0, -89.0, 0, True, False)], schema)
    got = {(r.route, r.closure_id): round(r.meters) for r in advisories.ridden_sections(legs, sections).collect()}
    assert got == {(1, 7): 180, (5, 7): 50}
    routes = legs.select("route").distinct()
    assert {r.route: r.blocked_by for r in advisories.gate(routes, legs, sections, 0).collect()} == {1: [7], 2: [], 3: [], 4: [], 5: [7], 6: []}
    assert advisories.gate(routes, legs, sections, -1).where("size(blocked_by) > 0").isEmpty()


@pytest.mark.parametrize("latitude", [0.0, 40.4, 65.0, 84.0, -70.0])
def test_hazards_at_any_latitude(spark, latitude):
    """Hazards 95 m beside a leg with a radius of 100 m are met wherever they are."""
    shrink = math.cos(math.radians(latitude))
    rows = [(k, latitude + 0.01 * k, -89.0, latitude + 0.01 * k + 0.001, -89.0) for k in range(20)]
    legs = spark.createDataFrame([(k, 1, 1, 2, *r) for k, *r in rows], "feature_ord int, leg_ord int, a_id int, b_id int, a_lat double, a_lon double, b_lat double, b_lon double")
    side = [(k, latitude + 0.01 * k + 0.0005, -89.0 + (1 if k % 2 else -1) * 95 * NORTH / math.cos(math.radians(latitude + 0.01 * k)), 100.0, 1.0) for k in range(20)]
    hazards = spark.createDataFrame(side, "hazard_id int, h_lat double, h_lon double, radius double, penalty double")
    assert shrink > 0 and {(r.feature_ord, r.hazard_id) for r in rules.hazard_events(legs, hazards).collect()} == {(k, k) for k in range(20)}


def test_small_networks_are_searched_without_rounds(spark, monkeypatch):
    """Components of a small graph are one task, those of a large one rounds, with the same result."""
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (3, None), (None, 4)] + [(1000 + k, 1001 + k) for k in range(60)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    rounds = []
    monkeypatch.setattr(network, "connected_components", lambda *a, f=network.connected_components: rounds.append(a) or f(*a))
    small = sorted(tuple(r) for r in network.components(edges).collect())
    assert small and not rounds
    monkeypatch.setattr(network, "TASK_EDGES", 10)
    assert sorted(tuple(r) for r in network.components(edges).collect()) == small and len(rounds) == 1
    assert network.components(edges.limit(0)).count() == 0


def test_projection_in_steps(spark):
    """Step by step the projection is bit for bit that of the one expression, also on segments without length and nulls."""
    rng = random.Random(3)
    rows = [tuple(40 + rng.uniform(-0.02, 0.02) if k % 2 == 0 else -89 + rng.uniform(-0.02, 0.02) for k in range(6)) for _ in range(300)]
    rows += [(40.0, -89.0, 40.1, -89.1, 40.1, -89.1), (40.0, -89.0, 40.0, -89.0, 40.0, -89.0), (None, -89.0, 40.1, -89.1, 40.1, -89.2)]
    points = spark.createDataFrame(rows, "lat double, lon double, a_lat double, a_lon double, b_lat double, b_lon double")
    both = geo.with_projection(points).withColumn("q", geo.project_to_segment("lat", "lon", *network.SEGMENT))
    assert both.count() == 303 and both.where("not p <=> q").isEmpty()


def test_pairs_in_reach_are_dealt_to_tasks(spark):
    """However few bytes the segments are, more than one task projects places on them."""
    legs = projection.view(spark, "/root/testdata/sf0.001", "legs")
    found = network.places_in_reach(legs.limit(3).select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")), legs, 4_000.0)
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_connectors_hold_nodes_of_a_place_together(spark, monkeypatch):
    """Nodes of one place and edges of one line meet as arrays, of any size; the pairs are those of every node by itself."""
    legs = projection.view(spark, "/root/testdata/sf0.001", "legs").where("feature_ord < 60")
    legs = network.with_length(legs).select((F.col("feature_ord") * 100 + F.col("leg_ord")).alias("edge"), *network.SEGMENT, "meters", F.col("a_id").alias("from_node"), F.col("b_id").alias("to_node"))
    ends = legs.select(F.col("from_node").alias("node"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).union(legs.select("to_node", "b_lat", "b_lon")).distinct()
    tips = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))).select((F.col("node") * -10 - F.col("k")).alias("node"), F.col("lat") + 0.0001, F.col("lon") + 0.0003).toDF("node", "lat", "lon")
    tips = tips.union(ends.limit(5))
    whole = legs.withColumns({"leg": F.lit(1), "starts_at": F.lit(0.0), "whole": F.col("meters")})
    columns = ["node", "edge", "end_node", "toward_end", F.round("meters", 3)]
    want = sorted(tuple(r) for r in graph.connectors(tips.union(ends), whole, 15.0).join(tips, "node", "left_semi").select(*columns).collect())
    assert want and len(want) == len(set(want))
    edges, lines = graph.leg_edges(legs)
    for size in (2, 4_096):
        monkeypatch.setattr(graph, "PLACE_NODES", size)
        got = graph.connected(tips.union(tips), edges, 15.0, lines=lines, ends=ends, digits=3)
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
    # What is shuffled grows with nodes and edges, not with their pairs: these come last.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ways") < plan.index("Generate explode(nodes") < plan.index("Join Inner")


def test_share_that_ends_where_a_leg_begins(spark):
    """Five equal legs have their third begin at four tenths: the last bits decide, those of the C library."""
    lats = [40.4 + byy * 0.001 for byy in range(-8, 68)]
    rows = [(k, leg, lat, -89.2 + bx * 0.001, lat, -89.2 + (bx + 1) * 0.001) for k, lat in enumerate(lats) for leg, bx in enumerate((7, 8, 7, 8, 7))]
    rows = [(k, leg, a, min(b, d), c, max(b, d)) for k, leg, a, b, c, d in rows]
    legs = network.with_length(spark.createDataFrame(rows, "feature_ord long, leg_ord long, a_lat double, a_lon double, b_lat double, b_lon double"))
    want = {}
    for k, leg, *ends in rows:
        lat1, lon1, lat2, lon2 = map(math.radians, ends)
        h = math.pow(math.sin((lat2 - lat1) / 2), 2) + math.cos(lat1) * math.cos(lat2) * math.pow(math.sin((lon2 - lon1) / 2), 2)
        want.setdefault(k, []).append(12742017.6 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))
    got = {r.feature_ord: r.n for r in sequence.ridden_share(legs, 0.4).groupBy("feature_ord").agg(F.count("*").alias("n")).collect()}
    # Summed leg by leg, as both engines do; ``sum`` of Python corrects the last bits.
    before = {k: [float(x) for x in np.concatenate([[0.0], np.cumsum(m)])] for k, m in want.items()}
    assert got == {k: sum(s < x[-1] * 0.4 for s in x[:-1]) for k, x in before.items()}
    assert set(got.values()) == {2, 3}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_hazards_do_not_shuffle_legs_by_cell(spark, monkeypatch, adaptive):
    """Whatever the planner learns on the way, legs move only where the views put them in order, and all pairs are found."""
    monkeypatch.setattr(rules, "HAZARD_CELL", 2)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        legs = projection.view(spark, "/root/testdata/sf0.001", "legs")
        hazards = spark.createDataFrame([(k, 40.4 + k % 7 * 0.0031, -89.2 + k * 0.0017, 30.0 + k, 1.0) for k in range(40)], "hazard_id int, h_lat double, h_lon double, radius double, penalty double")
        found = rules.hazard_events(legs, hazards)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert " Exchange hashpartitioning(row" not in plan and plan.count(" Exchange ") <= legs._jdf.queryExecution().executedPlan().toString().count(" Exchange ")
        near = geo.project_to_segment("h_lat", "h_lon", "a_lat", "a_lon", "b_lat", "b_lon")["distance"] <= F.col("radius")
        want = {tuple(r) for r in legs.crossJoin(hazards).where(near).select("feature_ord", "hazard_id").distinct().collect()}
        assert {(r.feature_ord, r.hazard_id) for r in found.collect()} == want and want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hazards(spark):
    legs = network.pair_legs(polylines(spark, {1: [(0, -200), (0, 200)], 2: [(0, 0), (0, 300)], 3: [(500, 0), (500, 9)]}).withColumn("node_id", F.col("vertex_ord")))
    hazards = spark.createDataFrame([(1, 40.0, -89.0, 55.0, 100.0), (2, 40.0, -89.0, 0.0, 9.0)], "hazard_id int, h_lat double, h_lon double, radius double, penalty double")
    got = {r.feature_ord: (r.crossings, r.visits) for r in rules.hazard_events(legs, hazards).collect()}
    assert got == {1: (2, 1), 2: (1, 1)}


def test_coverage_by_heading(spark):
    legs = network.pair_legs(polylines(spark, {1: [(0, 0), (0, 100)], 2: [(5, 0), (5, 50)], 3: [(-50, 50), (50, 50)]}).withColumn("node_id", F.col("vertex_ord")))
    scale = math.cos(math.radians(40))
    samples = history.samples(legs.where("feature_ord = 1"), "feature_ord", scale)
    past = history.segments(legs.where("feature_ord > 1").withColumnRenamed("feature_ord", "session"), "session", scale)
    got = {r.session: r.share for r in history.coverage(samples, past, "feature_ord", "session").collect()}
    assert set(got) == {2} and math.isclose(got[2], 0.5, abs_tol=0.03)


def test_instructions(spark):
    rows = [(1, 1, 100.0, "A", "Trail", "TrailBranches", True, 0.0), (1, 2, 50.0, "A", "Trail", "TrailBranches", True, 90.0), (1, 3, 10.0, None, "Trail", "TrailBranches", True, 90.0), (1, 4, 70.0, "B", "Trail", "SharedRoadways", True, 180.0), (2, 1, 5.0, "A", "Trail", "TrailBranches", False, 0.0)]
    legs = spark.createDataFrame(rows, "feature_ord int, leg_ord int, meters double, name string, type string, roles string, routed boolean, entry double")
    legs = legs.withColumns({"exit": F.col("entry"), "style": F.lit("Unknown"), "junction_turn": F.lit(False), "a_id": F.col("leg_ord"), "b_id": F.col("leg_ord") + 1})
    got = [(r.leg_ord, r.maneuver, r.text, r.meters) for r in instructions.instructions(legs).orderBy("leg_ord", "meters").collect()]
    assert got == [(1, "Start", "Start on A", 0.0), (4, "Arrive", "Arrive at destination", 70.0), (4, "TurnRight", "Turn right onto B", 160.0)]


FIXES = "rider long, seq long, fix_ms long, now_ms long, lat double, lon double, accuracy_m double, off_m double"


def steps(spark, *rides):
    """Statuses of rides of fixes (seconds, metres off, accuracy, metres north, seconds until seen), by
    windows and, a few fixes at a time, by the state of a stream."""
    rows = [(r, k, s * 1000, (s + late) * 1000, 40 + north * NORTH, -89.0, None if accuracy is None else float(accuracy), float(off)) for r, fixes in enumerate(rides) for k, (s, off, accuracy, north, late) in enumerate(fixes)]
    told = deviation.statuses(spark.createDataFrame(rows, FIXES).withColumn("kind", deviation.fix_class())).orderBy("rider", "seq").toPandas()
    for r in range(len(rides)):
        own = told[told["rider"] == r]
        for size in (1, 2, 5):
            ride, seen = deviation.Ride(), []
            for k in range(0, len(own), size):
                part = own.iloc[k : k + size]
                ride, some = deviation.advance(ride, *(part[c].to_numpy() for c in ("kind", "fix_ms", "lat", "lon")))
                seen += some
            assert seen == own["status"].tolist()
    return [told[told["rider"] == r]["status"].tolist() for r in range(len(rides))]


def test_deviation_states(spark):
    on, maybe, sure, lost = "OnRoute", "PossiblyOffRoute", "ConfirmedOffRoute", "UncertainPosition"
    a, b, c, d, e, f, g, h = steps(
        spark,
        [(0, 90, 10, 0, 0), (8, 90, 10, 20, 0), (15, 90, 10, 40, 0)],
        [(0, 90, 10, 0, 0), (8, 90, 10, 2, 0), (15, 90, 10, 4, 0)],
        [(0, 90, 10, 0, 0), (8, 90, 10, 20, 0), (14, 90, 10, 40, 0)],
        [(0, 90, 10, 0, 0), (20, 90, 10, 20, 0), (28, 90, 10, 40, 0)],
        [(0, 90, 10, 0, 0), (8, 90, None, 20, 0), (15, 90, 10, 40, 0), (20, 90, 10, 60, 0)],
        [(0, 90, 10, 0, 11), (1, 90, 10, 0, -1), (2, 55, 10, 0, 0)],
        [(0, 90, 10, 0, 0), (8, 90, 10, 20, 0), (15, 90, 10, 40, 0), (18, 30, 10, 40, 0), (20, 30, 30, 40, 0), (22, 30, 10, 40, 0), (24, 30, 10, 40, 0)],
        [(0, 90, 10, 0, 0), (8, 90, 10, 20, 0), (15, 90, 10, 40, 0), (18, 30, 10, 40, 0), (40, 30, 10, 40, 0), (45, 45, 10, 40, 0), (46, 30, 10, 40, 0), (47, 30, 10, 40, 0), (50, 90, 10, 40, 0)],
    )
    assert a == [maybe, maybe, sure]
    assert b == c == d == [maybe, maybe, maybe]
    assert e == [maybe, lost, maybe, sure]
    assert f == [lost, lost, on]
    assert g == [maybe, maybe, sure, sure, sure, sure, on]
    assert h == [maybe, maybe, sure, sure, sure, sure, sure, on, maybe]


def test_stretches_of_random_rides(spark):
    """Windows and the state of a stream agree however a ride is cut into batches."""
    rng = random.Random(4)
    rides = []
    for _ in range(8):
        at, fixes = 0, []
        for _ in range(120):
            at += rng.choice([1, 4, 7, 16])
            fixes.append((at, rng.choice([0, 0, 45, 90, 90, 90]), rng.choice([5, 10, 30, None]), at * rng.choice([1, 3]), 0))
        rides.append(fixes)
    assert len({x for told in steps(spark, *rides) for x in told}) == 4


def test_ridden_and_completion(spark, monkeypatch):
    progress, off = np.array([100, 350, 900, 1000, 1060, 2000, 1100, np.nan, 1700, 1500, 1860, 1900, 1950]), np.array([0, 0, 0, 0, 0, 80, 0, 0, 0, 0, 0, 10, 60])
    for size in (512, 1, 3):
        monkeypatch.setattr(deviation, "CHUNK", size)
        told, waits = deviation.metres_ridden(progress, off)
        assert told.tolist() == [100, 350, 350, 350, 1060, 1060, 1100, 1100, 1100, 1100, 1100, 1100, 1100]
        assert [None if np.isnan(x) else x for x in waits] == [None, None, 900, 900, None, None, None, None, 1700, 1500, 1860, 1860, None]
    rows = [(1, k, float(200 * k), 4000.0, 5.0, "ExerciseLoop") for k in range(20)] + [(1, 20, None, 4000.0, 5.0, "ExerciseLoop"), (1, 21, 3990.0, 4000.0, 41.0, "ExerciseLoop"), (1, 22, 3990.0, 4000.0, 5.0, "ExerciseLoop")]
    rows += [(2, 0, 3990.0, 4000.0, 5.0, "ExerciseLoop"), (3, 0, 3990.0, 4000.0, 5.0, "Navigation")] + [(4, k, float(200 * k), 4000.0, 5.0, "Navigation") for k in range(21)]
    loops = deviation.completion(spark.createDataFrame(rows, "rider long, seq long, progress double, whole double, off_m double, kind string"))
    ends = {r.rider: r for r in loops.orderBy("seq").collect()}
    assert ends[1].departed and ends[1].verified == 3990 and ends[1].completed
    assert ends[2].departed and not ends[2].completed and not ends[3].departed and not ends[4].completed
    assert loops.where("completed").count() == 1


def test_stream_equals_windows(spark, tmp_path):
    """The states of a stream are those of a recorded trip, and older fixes are dropped."""
    rng = random.Random(1)
    rows = [(r, 8000 * k + 1, 8000 * k + 600, 40 + k * 20 * NORTH, -89.0, rng.choice([5.0, 10.0, 30.0, None]), float(rng.choice([0, 0, 90, 90, 90, 45]))) for r in (1, 2) for k in range(40)]
    schema = "rider long, fix_ms long, now_ms long, lat double, lon double, accuracy_m double, off_m double"
    for part in range(4):
        spark.createDataFrame([x for x in rows if part * 10 <= (x[1] - 1) // 8000 < part * 10 + 10] + rows[:1] * (part > 0), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = deviation.track(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination(300)
    got = {(r.rider, r.fix_ms): r.status for r in spark.table("states").collect()}
    want = deviation.statuses(spark.createDataFrame(rows, schema), order="fix_ms")
    assert got == {(r.rider, r.fix_ms): r.status for r in want.collect()} and len(set(got.values())) > 2


def test_signal_loss_timer(spark, tmp_path):
    """A ride without a fix for ten seconds is told of once, by a timer."""
    schema = "rider long, fix_ms long, now_ms long, lat double, lon double, accuracy_m double, off_m double"
    spark.createDataFrame([(1, 1000, 1000, 40.0, -89.0, 5.0, 0.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = deviation.track(stream, timers=True).writeStream.format("memory").queryName("signals").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="2 seconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("signals").where("status = 'SignalLost'").isEmpty():
            time.sleep(1)
    finally:
        out.stop()
    assert [r.status for r in spark.table("signals").orderBy("status").collect()] == ["OnRoute", "SignalLost"]


def test_text_of_hand_worked_cases(spark):
    row = spark.range(1).select(
        text.duration_text(F.lit(100.0)), text.duration_text(F.lit(20_000.0)), text.instruction_distance(F.lit(0.5)), text.instruction_distance(F.lit(100.0)), text.instruction_distance(F.lit(1609.344)),
        text.mileage(F.lit(2.0)), text.mileage(F.lit(1.234)), text.network_prefix(F.lit("1.2.3.004")), text.network_prefix(F.lit("2001:db8::1")), text.network_prefix(F.lit("::ffff:1.2.3.4")), text.network_prefix(F.lit("1::2::3")),
        text.route_key(F.lit("")), text.route_key(F.lit("a")), text.fixed(F.lit(-0.000001)), text.elapsed_text(F.lit(0), F.lit(90_000_000)), text.first_place(F.lit(" , x")), text.utc_millis(F.lit("2020-01-01T00:00:00+01:00")),
    ).first()
    assert list(row) == ["1 min", "1 hr 33 min", "Now", "325 ft", "1 mi", "2.0", "1.23", "1.2.3.4", "2001:db8:0:0::/64", None, None, "route-cbf29ce484222325", "route-af63dc4c8601ec8c", "0.00000", "1 day ago", None, None]


def test_address_index(spark):
    rows = [(1, "12 North Main Street", None, None, "Normal", "61761", 40.0, -89.0), (2, "12 N. Main St.", None, None, "normal", "61761", 40.0, -89.0), (3, "14-A N Main St", "b", "2", "Normal", "61761-9", 40.001, -89.0), (4, "Main St", None, None, None, None, 40.0, -89.0), (5, "9 Oak Ave", None, None, None, None, None, None), (6, "20 Oak & Elm Ave", None, None, "X", None, 41.0, -89.0), (None, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "oid long, address string, building string, unit string, city string, zip string, lat double, lon double")
    index = address.build_index(table)
    assert sorted((r.oid, r.street, r.num, r.suffix, r.unit) for r in index.collect()) == [(1, "N MAIN ST", 12, "", ""), (3, "N MAIN ST", 14, "A", "BLDG B 2"), (6, "OAK AND ELM AVE", 20, "", "")]
    report = address.build_report(table).first()
    assert (report["rows"], report.indexed, report.skipped_point, report.skipped_number, report.duplicates, report.with_unit) == (7, 3, 2, 1, 1, 1)
    asked = spark.createDataFrame(list(enumerate(["12 main", "13 n main st", "main", "oak", "zzz", "", None, "14a north main"])), "query int, text string")
    got = {r["query"]: (r.kind, r.found) for r in address.search(asked, index).collect()}
    assert got == {0: ("matches", ["12 N Main St, Normal"]), 1: ("nearest-numbers", ["12 N Main St, Normal", "14A N Main St, Normal"]), 2: ("streets", ["N Main St"]), 3: ("streets", ["Oak And Elm Ave"]), 4: ("none", None), 5: ("none", None), 6: ("none", None), 7: ("matches", ["14A N Main St, Normal"])}


def test_place_search(spark):
    places = spark.createDataFrame([(1, "12 N Machinery St", "Normal", 40.0, -89.0), (2, "O’Neil Park", "9 Café Way", 40.1, -89.0), (3, "Machine Hall", None, 40.2, -89.0), (4, None, "nowhere", 40.0, -89.0), (5, "12 N Machinery St", "Normal", 40.0, -89.0)], "place_ord long, label string, address string, lat double, lon double")
    asked = spark.createDataFrame([(1, "mach", 40.2, -89.0), (2, "  ", 40.0, -89.0), (3, "ONEIL cafe", 40.0, -89.0), (4, "n st mach", 40.0, -89.0), (5, "zzz", 40.0, -89.0), (6, None, 40.0, -89.0), (7, "chin", 40.0, -89.0)], "query int, words string, lat double, lon double")
    got = {}
    for r in address.nearest_places(asked, places, 3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.label)
    first = [x[1] for x in ((1, "12 N Machinery St"), (2, "O’Neil Park"), (3, "Machine Hall"))]
    assert got == {1: ["Machine Hall", "12 N Machinery St", "12 N Machinery St"], 2: first, 3: ["O’Neil Park"], 4: ["12 N Machinery St"] * 2, 6: first, 7: ["Machine Hall", "12 N Machinery St", "12 N Machinery St"][1:] + ["Machine Hall"]}


def test_split_at_reversals(spark):
    points = polylines(spark, {1: [(0, 0), (0, 100), (0, 200), (0, 200.05), (0, 100), (0, 0), (0, 50)], 2: [(0, 0), (0, 9)]})
    names = {(0, 0): 1, (0, 100): 2, (0, 200): 3, (0, 50): 4}
    where = {1: [1, 2, 3, 9, 2, 1, 4], 2: [1, 5]}
    nodes = spark.createDataFrame([(f, k, n) for f, ns in where.items() for k, n in enumerate(ns)], "feature_ord long, vertex_ord long, node_id long")
    pieces = {}
    for r in sequence.split_at_reversals(points.drop("node_id").join(nodes, ["feature_ord", "vertex_ord"])).orderBy("vertex_ord").collect():
        pieces.setdefault((r.feature_ord, r.piece), []).append(r.vertex_ord)
    assert names and pieces == {(1, 0): [0, 1, 2], (1, 1): [2, 4, 5, 6], (2, 0): [0, 1]}


def test_best_pairs(spark):
    starts = spark.createDataFrame([(1, k, float(k)) for k in range(12)] + [(2, 1, 5.0)], "request int, s int, a double")
    goals = spark.createDataFrame([(1, k, float((k * 7) % 11)) for k in range(11)] + [(3, 1, 5.0)], "request int, g int, b double")
    got = records.best_pairs(starts, goals, "request", F.abs(F.col("a") * F.col("b") - 20), [F.col("s"), F.col("g")], start_order=["a"], goal_order=["b"], limit=8).collect()
    want = min((abs(a * b - 20), a, g) for a in range(8) for g in range(11) for b in [(g * 7) % 11] if b < 8)
    assert [(r.request, r.score, r.s, r.g) for r in got] == [(1, *want)]


def test_changes(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "id int, v string")
    right = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id int, v string")
    assert {(r.id, r.change) for r in changes.snapshot_diff(left, right, "id", "v").collect()} == {(1, "removed"), (2, "changed"), (4, "added"), (None, "removed")}
    assert {(r.id, r.outcome) for r in changes.add_or_conflict(left, right, "id", "v").collect()} == {(2, "conflict"), (3, "same"), (4, "added")}
    chain = changes.journal(spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "source string, n int, id string"), "source", "n", "id")
    assert changes.broken_links(chain, "source", "n", "id").count() == 0
    assert [r.n for r in changes.broken_links(chain.withColumn("id", F.when(F.col("n") == 1, "z").otherwise(F.col("id"))), "source", "n", "id").orderBy("n").collect()] == [1, 2]
    many = spark.createDataFrame([(k, 1, k) for k in range(9)] + [(0, 1, 5)], "id int, network int, at long")
    assert sorted(r.id for r in changes.admitted_requests(many, "id", "network", "at", per_hour=5).collect()) == [0, 1, 2, 3, 4]


def test_polyline_codec(spark):
    rows = [([38.5, 40.7, 43.252], [-120.2, -120.95, -126.453]), ([], []), (None, [1.0]), ([float("nan")], [1.0]), ([-90.0, 90.0], [-180.0, 180.0])]
    frame = spark.createDataFrame(rows, "lats array<double>, lons array<double>")
    got = frame.select(formats.encode_path("lats", "lons").alias("e")).select("e", formats.decode_path("e").alias("d")).collect()
    assert [r.d.lats for r in got] == [rows[0][0], [], None, None, rows[4][0]] and got[0].d.lons == rows[0][1]
    for a, b in zip("?@A", (0, -1, 1)):
        assert formats._packed(formats.np.array([b], formats.np.int64)).decode() == a
    bad = spark.createDataFrame([("?",), ("~",), ("é?",), (None,)], "e string").select(formats.decode_path("e").alias("d")).collect()
    assert [r.d.lats for r in bad] == [None, None, None, None]


def test_points_near_does_not_broadcast_copied_points(spark):
    """Points are looked up by distinct place, and their copies around each cell are never sent whole through the driver."""
    points = polylines(spark, {f: [(0, 0), (0, 400)] for f in range(30)}).select(F.col("feature_ord").alias("point_id"), "lat", "lon")
    places = polylines(spark, {1: [(5, 5), (0, 900)]}).select("lat", "lon")
    found = network.points_near(points, places, 25.0)
    assert found.count() == 30 and found.columns == points.columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and plan.index("Generate explode") > plan.index("strategy=merge")
    assert all(r.lon < -88.99999 for r in found.collect())


def test_polylines_are_coded_a_batch_at_once():
    """Paths of a batch do not run into each other, and no step is taken for each of them."""
    pa, calls = formats.pa, []
    rng = random.Random(2)
    paths = [None if k % 7 == 3 else [(round(rng.uniform(-90, 90), 7), round(rng.uniform(-180, 180), 7)) for _ in range(k % 5)] for k in range(60)]
    paths[9] = [(float("inf"), 1.0), (2.0, 3.0)]
    columns = [pa.array([None if p is None else [x[c] for x in p] for p in paths], pa.list_(pa.float64())) for c in range(2)]
    inner, formats._packed = formats._packed, lambda values: calls.append(len(values)) or inner(values)
    try:
        told = formats._encode_paths(*columns)
    finally:
        formats._packed = inner
    assert len(calls) == 1
    back = formats._decode_paths(told).to_pylist()
    for k, (path, found) in enumerate(zip(paths, back, strict=True)):
        want = [None, None] if path is None or k == 9 else [[x[c] for x in path] for c in range(2)]
        assert [found["lats"], found["lons"]] == want
    long = formats._decode_paths(pa.array(["?@", "?" * 3, "~~~~~~~~~?@", "", "?@?@", "_?@"])).to_pylist()
    assert [r["lats"] for r in long] == [[0.0], None, None, [], [0.0, 0.0], [0.0]]
    assert formats._decode_paths(pa.array([], pa.string())).to_pylist() == [] and formats._encode_paths(*(pa.array([None], pa.list_(pa.float64())) for _ in range(2))).to_pylist() == [None]


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('﻿{"layers":[{"id":"x","features":[{"id":"1","name":" ","routeRoles":["b","a"],"facilityType":"Urban Trail","paths":[[[-89,40],[-89.1,40.1]]]},{"id":"2","routeRoles":"c","paths":[[[-89,40]]]}]}]}')
    (only,) = formats.read_trails(spark, f"{tmp_path}/t.json").collect()
    assert (only.id, only.name, only.roles, only.facility, only.comfort, only.paths[0][1].lat) == ("1", None, ["a", "b"], "UrbanTrail", "Unknown", 40.1)
    (tmp_path / "o.xml").write_text('<osm><node id="1" lat="40" lon="-89"/><node id="2" lat="41" lon="-89"/><way id="7" version="3"><nd ref="2"/><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way><way id="8" version="1"><nd ref="1"/><nd ref="9"/></way></osm>')
    (way,) = formats.osm_ways(spark, f"{tmp_path}/o.xml").collect()
    assert (way.way_id, way.version, way.tags, [p.lat for p in way.points]) == (7, 3, {"highway": "path"}, [41.0, 40.0, 41.0])
    pages = [(1, "<title>News</title><main><nav>menu</nav><p>The trail is closed at the bridge &amp; beyond, for now</p><script>x</script></main>"), (2, "<title>Not found</title><main>" + "trail " * 20 + "</main>"), (3, None), (4, "")]
    got = {r.id: r for r in formats.notices(spark.createDataFrame(pages, "id int, html string"), "html", ["Trail"]).collect()}
    assert got[1].body == "The trail is closed at the bridge & beyond, for now" and [got[k].verified for k in (1, 2, 3, 4)] == [True, False, False, False]
    nested = "<title>A &amp; b</title><main>Hi <b>there</b> a < b <header>no</header><article>in</article> out</main> after <article/><nav>a<nav>b</nav>c</nav></main><ARTICLE>left open &eacute;<!-- <nav> -->"
    times = [f"<meta content='{t}' property='article:published_time'>" for t in ("2026-03-01T10:00:00+02:00", "2026-03-01T10:00:00", "soon")]
    told = spark.createDataFrame([(0, nested), *enumerate(times, 1)], "id int, html string")
    read = told.select("id", formats.notice_text("html").alias("n"), formats.published("html").alias("at")).orderBy("id").collect()
    assert tuple(read[0].n) == ("A & b", "Hi there a < b in out left open é")
    assert [r["at"] for r in read] == [None, "2026-03-01T08:00:00Z", None, None]
    body = spark.createDataFrame([('{"elements":[{"type":"way","id":5,"tags":{"b":"1","a":"2"},"geometry":[{"lat":1,"lon":2},{"lat":3,"lon":4}]},{"type":"node","id":6}]}',), ("{",)], "value string")
    assert [(r.way_id, r.copies) for r in formats.overpass_ways(body).collect()] == [(5, 1)]
    told = formats.geojson(spark.createDataFrame([(1, 0, "Trail", True, [(40.0, -89.0), (41.0, -89.5)])], "route int, place int, type string, routed boolean, points array<struct<lat:double,lon:double>>"), "route", "place").first().geojson
    assert json.loads(told)["features"][0]["geometry"] == {"type": "LineString", "coordinates": [[-89.0, 40.0], [-89.5, 41.0]]}


def test_tiles(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 40.001, 40.002, -89.002, -89.001), (2, 40.001, 40.051, -89.0, -88.99), (3, 41.0, 41.0, -89.0, -89.0)], "id int, south double, north double, west double, east double")
    tiles.write(boxes, "id", f"{tmp_path}/tiles")
    points = spark.createDataFrame([(40.015, -89.005), (None, 1.0)], "lat double, lon double")
    assert sorted(r.id for r in tiles.window(spark, f"{tmp_path}/tiles", points, "id").collect()) == [1, 2]
    assert tiles.audit(tiles.placed(boxes, "id"), "id").count() == 0


def test_distance_to_a_polyline_is_not_rounded(spark):
    """The tie is told at 1e-6 m, the distance as it is: rounded again it would go up at a half."""
    rows = [(1, 1, 40.0, -89.0, 40.001, -89.0, 111.0), (1, 2, 40.001, -89.0, 40.001, -88.99, 852.0)]
    legs = spark.createDataFrame(rows, "feature_ord long, leg_ord long, a_lat double, a_lon double, b_lat double, b_lon double, meters double")
    got = network.project_to_polylines(legs, F.lit(40.0004), F.lit(-89.00012345)).first()
    want = spark.range(1).select(geo.project_to_segment(40.0004, -89.00012345, 40.0, -89.0, 40.001, -89.0)["distance"].alias("d")).first().d
    assert got.distance == want and want != round(want, 6) and math.isclose(got.left, 963.0 - got.along)


def test_weights_of_coverage_without_its_pairs(spark, monkeypatch):
    """Routes over one another: weights equal the shares of each session, summed by recency."""
    rng = random.Random(8)
    walks = {f: [(0, 0)] for f in range(12)}
    for line in walks.values():
        for _ in range(5):
            line.append((line[-1][0] + rng.choice([-60, 0, 60]), line[-1][1] + 60))
    points = polylines(spark, walks)
    legs = network.pair_legs(points.withColumn("node_id", F.hash("lat", "lon").cast("long")))
    asked = history.samples(legs.where("feature_ord < 3"), "feature_ord", 0.76)
    past = history.segments(legs.where("feature_ord >= 3").withColumnRenamed("feature_ord", "session"), "session", 0.76)
    recency = spark.createDataFrame([(f, 1 / f) for f in range(3, 11)], "session long, recency double")
    want = {r.feature_ord: r.weight for r in history.edge_weights(history.coverage(asked, past, "feature_ord", "session"), recency, "feature_ord", "session").collect()}
    monkeypatch.setattr(history, "coverage", None)
    got = {r.feature_ord: r.weight for r in history.coverage_weights(asked, past, recency, "feature_ord", "session").collect()}
    assert set(got) == set(want) and got and all(math.isclose(got[f], want[f]) for f in want)


def test_coverage_without_pairs_of_samples(spark, monkeypatch):
    """Distinct places meet distinct lines, over several blocks of edges; shares agree with the pairs of samples and sessions."""
    rng = random.Random(9)
    walks = {f: [(0, 0)] for f in range(12)}
    for line in walks.values():
        for _ in range(5):
            line.append((line[-1][0] + rng.choice([-60, 0, 60]), line[-1][1] + rng.choice([-60, 60])))
    legs = network.pair_legs(polylines(spark, walks).withColumn("node_id", F.hash("lat", "lon").cast("long")))
    asked = history.samples(legs.where("feature_ord < 4"), "feature_ord", 0.76)
    past = history.segments(legs.where("feature_ord >= 4").withColumnRenamed("feature_ord", "session"), "session", 0.76)
    met = history._covered(asked, past, 25.0).select("feature_ord", "session", "sample", "piece_m").distinct().groupBy("feature_ord", "session").agg(F.sum("piece_m").alias("m"))
    want = {(r.feature_ord, r.session): r.m / r.total for r in met.join(asked.groupBy("feature_ord").agg(F.sum("piece_m").alias("total")), "feature_ord").collect()}
    seen = []
    monkeypatch.setattr(history, "_covered", lambda samples, drawn, cell, f=history._covered: seen.append((samples, drawn)) or f(samples, drawn, cell))
    for name in ("TASK_PAIRS", "BLOCK_ROWS"):
        monkeypatch.setattr(history, name, 7, raising=False)
    got = history.coverage(asked.union(asked.limit(0)), past.union(past), "feature_ord", "session").collect()
    assert all(x.count() == x.distinct().count() and not {"feature_ord", "session"} & set(x.columns) for x in seen[0])
    shares = {(r.feature_ord, r.session): r.share for r in got}
    assert len(got) == len(shares) and set(shares) == set(want) and want and all(math.isclose(shares[p], want[p]) for p in want)
    assert history.coverage(asked.limit(0), past, "feature_ord", "session").count() == 0


def test_nearest_address_by_distinct_places(spark):
    """What lies at one place is told once: neither points nor entries there are paired; ties go to the first entry, repeated points are one."""
    at = [(40.0, -89.0), (40.0004, -89.0), (40.0, -89.0005), (41.0, -89.0)]
    index = spark.createDataFrame([(o, f"S{o % 3}", o % 7, "", "", "C", "", round(la * 1e6), round(lo * 1e6)) for o in range(80) for la, lo in [at[o % 3]]], "oid long, street string, num long, suffix string, unit string, city string, zip string, lat long, lon long")
    points = spark.createDataFrame([(p, *at[p % 4]) for p in range(40)] + [(1, *at[1]), (90, None, -89.0)], "point_id long, lat double, lon double")
    got = address.nearest_address(points, index).collect()
    by_place = {k: min((f"S{o % 3}", o % 7, o) for o in range(80) if o % 3 == k)[2] for k in range(3)}
    assert sorted((r.point_id, r.oid, r.distance) for r in got) == [(p, by_place[p % 4], 0.0) for p in range(40) if p % 4 < 3]
    plan = address.nearest_address(points, index)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.splitlines()[next(i for i, x in enumerate(plan.splitlines()) if "Join Inner" in x and "(r#" in x) :]
    assert sum("Aggregate" in x for x in below) == 2


def test_place_search_by_cells(spark, monkeypatch):
    """Anchors look at the points around them only; the nearest places equal brute force, near and far, without points and at poles."""
    rng = random.Random(5)
    at = [(round(rng.gauss(40, s), 4), round(rng.gauss(-89, s), 4)) for s in (0.002, 0.05, 20) for _ in range(80)] + [(40.0, -89.0)] * 30 + [(89.9, 3.0), (-89.5, 170.0), (None, -89.0), (700.0, 1.0)]
    places = [(i, f"{rng.choice('abc')} Park {i % 50}", la, lo) for i, (la, lo) in enumerate(at)]
    asked = [(i, ("park", "b park", "c PARK 1")[i % 3], la, lo) for i, (la, lo) in enumerate(at[::4] + [(None, 0.0), (89.99, 0.0), (0.0, 0.0), (600.0, 0.0)])]
    met = []
    monkeypatch.setattr(address, "_in_reach", lambda *x, f=getattr(address, "_in_reach", None): met.append(f(*x)) or met[-1])
    got = {}
    for r in address.nearest_places(spark.createDataFrame(asked, "query int, words string, lat double, lon double"), spark.createDataFrame(places, "place_ord int, label string, lat double, lon double"), 5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.label)

    def far(q, p):
        if None in (*q, *p):
            return -1.0
        dx = (p[1] - q[1]) * math.cos(math.radians(q[0]))
        return round((p[0] - q[0]) ** 2 + dx * dx, 12)

    for i, words, *q in asked:
        fits = [p for p in places if all(w in p[1].lower() for w in words.lower().split())]
        assert got.get(i, []) == [x[1] for x in sorted((far(q, p[2:]), p[1], p[0]) for p in fits)[:5]]
    sound = met[0].where("abs(q_lat - 40) < 0.01 and set = 0")
    assert 0 < sound.count() < sound.select("q_lat", "q_lon").distinct().count() * len(set(at)) / 2
