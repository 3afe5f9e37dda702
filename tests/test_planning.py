"""Plans with road access and searches under a cap, against brute force on small networks."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fellpath.operators import network, planning

NORTH = 1 / 111_195
EAST = NORTH / math.cos(math.radians(40.0))
LEGS = "feature_ord long, leg_ord long, a_id long, b_id long, a_lat double, a_lon double, b_lat double, b_lon double, roles array<string>, facility string, comfort string"


def place(x, y):
    return 40.0 + y * NORTH, -89.0 + x * EAST


def table(spark, lines, roles=("TrailBranches",), facility="Other", first=1):
    """lines: lists of (x, y) metres; nodes are places."""
    rows = []
    for f, line in enumerate(lines, first):
        for k, (a, b) in enumerate(itertools.pairwise(line), 1):
            rows.append((f, k, node(a), node(b), *place(*a), *place(*b), list(roles), facility, "AllAgesAndAbilities"))
    return network.with_length(spark.createDataFrame(rows, LEGS))


def node(p):
    return int(p[0] + 50_000) * 1_000_000 + int(p[1] + 50_000)


def dijkstra(adj, start, key):
    best, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for m, w in adj.get(n, []):
            if m not in best:
                heapq.heappush(heap, (d + w[key], m))
    return best


def test_plan_by_roads_and_trails(spark):
    """A trail 300 m north of two endpoints, reached by roads; the ways along it compete by rating."""
    trails = table(spark, [[(0, 300), (1000, 300), (2000, 300)], [(0, 300), (0, 900), (2000, 900), (2000, 300)]])
    roads = table(spark, [[(-100, 0), (0, 0), (0, 300)], [(2000, 300), (2000, 0), (2100, 0)]], ("SharedRoadways",), first=100)
    asked = [(1, *place(-50, 3), *place(2050, -4)), (2, *place(500, 302), *place(1500, 295)), (3, *place(0, 100_000), *place(2000, 0)), (4, None, None, None, None)]
    requests = spark.createDataFrame(asked, "request long, from_lat double, from_lon double, to_lat double, to_lon double").withColumn("meters", F.lit("clash"))
    got = {r.request: r for r in planning.plans(requests, trails, roads).collect()}
    assert set(got) == {1, 2}
    assert abs(got[1].meters - 2707) < 3 and abs(got[1].access - 707) < 3
    assert abs(got[2].meters - 1007) < 2 and abs(got[2].access - 7) < 0.1
    entries = planning.endpoint_access(spark.createDataFrame([(7, *place(-50, 3)), (8, None, 1.0), (9, *place(0, 90_000))], "endpoint long, lat double, lon double"), trails, roads).orderBy("entry").collect()
    assert {r.endpoint for r in entries} == {7} and abs(entries[0].routed - 350) < 2 and abs(entries[0].estimated - 3) < 0.1
    assert planning.plans(requests, trails.limit(0), roads).count() == 0


def test_extended_reach_only_where_needed(spark):
    """An endpoint 2.5 km from the only trail finds it along a road by the second look."""
    trails = table(spark, [[(0, 3000), (1000, 3000)]])
    roads = table(spark, [[(0, 0), (0, 1500), (0, 3000)]], ("SharedRoadways",), first=100)
    far = spark.createDataFrame([(1, *place(0, 500)), (2, *place(10, 2500))], "endpoint long, lat double, lon double")
    got = {}
    for r in planning.endpoint_access(far, trails, roads).collect():
        got.setdefault(r.endpoint, []).append(r)
    assert abs(min(r.routed for r in got[1]) - 2500) < 3 and abs(min(r.routed for r in got[2]) - 500) < 3


def test_plans_against_brute_force(spark):
    """Grids of trails of two kinds and roads: access, way and rating by plain search over all pairs of entries."""
    rng = random.Random(11)
    lines = [[(x, y), (x + 200, y)] for x in range(0, 1000, 200) for y in range(0, 1001, 200) if rng.random() < 0.8] + [[(x, y), (x, y + 200)] for x in range(0, 1001, 200) for y in range(0, 1000, 200) if rng.random() < 0.8]
    rng.shuffle(lines)
    good, dear = table(spark, lines[:25], facility="OffRoadTrail"), table(spark, lines[25:], facility="SharedLane", first=200)
    trails = good.unionByName(dear)
    asked = [(k, *place(rng.randint(0, 1000), rng.randint(0, 1000) // 200 * 200 + 5), *place(rng.randint(0, 1000), rng.randint(0, 1000) // 200 * 200 + 4)) for k in range(6)]
    requests = spark.createDataFrame(asked, "request long, from_lat double, from_lon double, to_lat double, to_lon double")
    entries = planning.endpoint_access(spark.createDataFrame([(2 * r[0] + s, *r[1 + 2 * s : 3 + 2 * s]) for r in asked for s in (0, 1)], "endpoint long, lat double, lon double"), trails, trails.limit(0))
    held = {}
    for e in entries.collect():
        held.setdefault(e.endpoint, []).append(e)
    legs = {(r.feature_ord, r.leg_ord): r for r in trails.collect()}
    factor = {"OffRoadTrail": 1.0, "SharedLane": 1.35}
    adj = {}
    for r in legs.values():
        for a, b in ((r.a_id, r.b_id), (r.b_id, r.a_id)):
            adj.setdefault(a, []).append((b, (r.meters * factor[r.facility], r.meters)))
    got = {r.request: r for r in planning.plans(requests, trails, trails.limit(0)).collect()}
    for k, f_lat, f_lon, t_lat, t_lon in asked:
        a, b = math.radians(f_lat), math.radians(t_lat)
        straight = 2 * 6_371_008.8 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(t_lon - f_lon) / 2) ** 2))
        best = math.inf
        for s in held.get(2 * k, []):
            own = legs[s.feature_ord, s.leg_ord]
            for key in (0, 1):
                weight = (factor[own.facility], 1.0)
                reach = {}
                for end, share in ((own.a_id, s.t), (own.b_id, 1 - s.t)):
                    for n, d in dijkstra_pair(adj, end, key).items():
                        d = (d[0] + share * own.meters * weight[key], d[1] + share * own.meters)
                        reach[n] = min(reach.get(n, (math.inf, 0)), d)
                for g in held.get(2 * k + 1, []):
                    goal = legs[g.feature_ord, g.leg_ord]
                    ways = [(reach[n][0] + share * goal.meters * (factor[goal.facility], 1.0)[key], reach[n][1] + share * goal.meters) for n, share in ((goal.a_id, g.t), (goal.b_id, 1 - g.t)) if n in reach]
                    if (g.feature_ord, g.leg_ord) == (s.feature_ord, s.leg_ord):
                        ways.append((abs(g.t - s.t) * own.meters * weight[key], abs(g.t - s.t) * own.meters))
                    if ways:
                        access = s.estimated + g.estimated
                        total = min(ways)[1] + access
                        best = min(best, total - access + access * 8 + max(0.0, total - (2 * straight + 400)) * 20 + s.score + g.score)
        assert (k in got) == (best < math.inf)
        if k in got:
            assert math.isclose(got[k].score, best, rel_tol=1e-6, abs_tol=1e-3)


def dijkstra_pair(adj, start, key):
    """Cost under ``key`` and metres of the cheapest way to every node."""
    best, heap = {}, [(0.0, 0.0, start)]
    while heap:
        c, m, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (c, m)
        for to, w in adj.get(n, []):
            if to not in best:
                heapq.heappush(heap, (c + w[key], m + w[1], to))
    return best


def test_two_labels(spark):
    """A cheap way of 600 m must not put out the dear one of 300 m that alone reaches 650 m further under a cap of 1 km."""
    edges = spark.createDataFrame([(1, 2, 60.0, 600.0), (1, 3, 100.0, 150.0), (2, 3, 900.0, 150.0), (2, 4, 65.0, 650.0), (4, 5, 1.0, 500.0)], "u long, v long, cost double, meters double")
    starts = spark.createDataFrame([(1,)], "start long")
    found, log = planning.two_label_search(edges, starts, 1000.0, hops=1)
    rows = {(r.node, r.cheapest, r.shortest): r for r in found.collect()}
    assert rows[2, True, False].meters == 600 and rows[2, False, True].meters == 300
    assert rows[4, True, True].meters == 950 and rows[4, True, True].cost == 1065 and not any(n == 5 for n, _, _ in rows)
    nodes = planning.label_paths(log, found.where("node = 4").select("start", "id")).orderBy("place").collect()
    assert [r.node for r in nodes] == [1, 3, 2, 4]
    ended = planning.two_label_search(edges, starts, 1000.0, terminals=spark.createDataFrame([(1, 2)], "start long, node long"))[0]
    assert {r.node for r in ended.collect()} == {1, 2, 3}
    dearer = planning.two_label_search(edges, starts, 1000.0, overlay=spark.createDataFrame([(1, 2, 1, 5000.0)], "start long, u long, v long, extra double"))[0]
    assert {(r.node, r.cost) for r in dearer.where("cheapest").collect()} >= {(2, 1000.0), (3, 100.0)}
    assert planning.two_label_search(edges.limit(0), starts, 10.0)[0].count() == 1 and planning.two_label_search(edges, starts.limit(0), 10.0)[0].count() == 0


@pytest.mark.parametrize("hops", [1, 3])
def test_two_labels_on_random_graphs(spark, hops):
    rng = random.Random(hops)
    edges = [(u, v, float(rng.randint(1, 100)), float(rng.randint(1, 100))) for u in range(14) for v in rng.sample(range(14), 3) if u != v]
    frame = spark.createDataFrame(edges, "u long, v long, cost double, meters double")
    adj = {}
    for u, v, c, m in edges:
        adj.setdefault(u, []).append((v, (c, m)))
        adj.setdefault(v, []).append((u, (c, m)))
    found, log = planning.two_label_search(frame, spark.createDataFrame([(0,), (5,)], "start long"), 120.0, hops=hops)
    rows = found.collect()
    paths = {}
    for r in planning.label_paths(log, found.select("start", "id")).orderBy("start", "id", "place").collect():
        paths.setdefault((r.start, r.id), []).append(r.node)
    for start in (0, 5):
        near = {n: d for n, d in dijkstra(adj, start, 1).items() if d <= 120}
        cheap = dijkstra_pair(adj, start, 0)
        own = [r for r in rows if r.start == start]
        assert {r.node: r.meters for r in own if r.shortest} == near
        for r in own:
            assert r.meters <= 120 and r.cost >= cheap[r.node][0] - 1e-9
            if r.cheapest and cheap[r.node][1] <= 120:
                assert math.isclose(r.cost, cheap[r.node][0])
            way = paths[r.start, r.id]
            assert way[0] == start and way[-1] == r.node
            sums = {(0.0, 0.0)}
            for a, b in itertools.pairwise(way):
                sums = {(c + w[0], m + w[1]) for c, m in sums for n, w in adj[a] if n == b}
            assert (r.cost, r.meters) in sums


def test_trail_snaps_look_at_the_nearest_lines_only(spark, monkeypatch):
    """The same snaps as of all legs in reach, of which few are looked at where many features share the lines."""
    rng = random.Random(11)
    north = [40 + k * 0.0005 for k in range(12)]
    rows = [(f, k, north[k], -89.0, north[k + 1], -89.0, rng.randint(0, 3)) for f in range(40) for k in range(11)]
    # One feature with many legs nearest of all, which must not fill the snaps alone.
    rows += [(99, k, 40 + k * 0.0001, -88.9999, 40 + (k + 1) * 0.0001, -88.9999, 0) for k in range(30)]
    trails = spark.createDataFrame([r[:6] for r in rows if r[6] < 3], "feature_ord long, leg_ord int, a_lat double, a_lon double, b_lat double, b_lon double")
    ends = spark.createDataFrame([(1, 40.0013, -88.9990), (2, 40.004, -89.001), (3, 50.0, -89.0)], "endpoint long, lat double, lon double")
    want = set()
    for e, own in itertools.groupby(sorted(network.segments_in_reach(ends, trails, 1500.0).select("endpoint", F.round("p.distance", 6), "feature_ord", "leg_ord").collect()), key=lambda r: r[0]):
        taken = []
        for r in own:
            if len(taken) < 24 and sum(f == r[2] for f, _ in taken) < planning.OF_A_TRAIL:
                taken.append((r[2], r[3]))
        want |= {(e, k + 1, f, leg) for k, (f, leg) in enumerate(taken)}
    seen = []
    monkeypatch.setattr(planning.network, "top_of", lambda rows, group, order, k, f=network.top_of: (group == ["lat", "lon", "feature_ord"] and seen.append(rows.count()), f(rows, group, order, k))[1])
    got = {(r.endpoint, r.snap, r.feature_ord, r.leg_ord) for r in planning.trail_snaps(ends, trails, planning.NORMAL).collect()}
    assert got == want and len(want) == 48
    assert sum(seen) < trails.count() / 2


def test_two_labels_in_tasks_agree_with_rounds(spark, monkeypatch):
    """Small networks are settled start by start in tasks; ways lie in one piece, so none is put together by rounds."""
    rng = random.Random(9)
    edges = [(u, v, float(rng.randint(1, 100)), float(rng.randint(1, 100))) for u in range(30) for v in rng.sample(range(30), 2) if u != v]
    frame = spark.createDataFrame(edges, "u long, v long, cost double, meters double")
    starts = spark.createDataFrame([(0, 3, 1.0, 2.0), (0, 4, 0.0, 9.0), (5, 5, 0.0, 0.0), (6, 99, 0.0, 0.0), (7, 7, 0.0, 500.0)], "start long, node long, cost double, meters double")
    told = {}
    for name, most in (("tasks", planning.network.BROADCAST_STEPS), ("rounds", 0)):
        monkeypatch.setattr(planning.network, "BROADCAST_STEPS", most)
        found, log = planning.two_label_search(frame, starts, 150.0)
        told[name] = {(r.start, r.node, r.meters) for r in found.where("shortest").collect()}
        assert name == "rounds" or log.where("prev is not null").isEmpty()
        assert found.count() == planning.label_ways(log, found.select("start", "id")).count()
    assert told["tasks"] == told["rounds"] and {s for s, _, _ in told["tasks"]} == {0, 5, 6}


def test_bounded_searches_are_exact(spark, monkeypatch):
    """Searches towards goals agree with plain ones, with and without places and for all goals."""
    rng = random.Random(3)
    lines = [[(x, y), (x + 100, y)] for x in range(0, 1200, 100) for y in range(0, 1201, 100) if rng.random() < 0.75] + [[(x, y), (x, y + 100)] for x in range(0, 1201, 100) for y in range(0, 1200, 100) if rng.random() < 0.75]
    legs = table(spark, lines)
    edges = network.undirected_edges(legs).select("u", "v", F.col("meters").alias("cost"))
    adj = {}
    for r in edges.collect():
        adj.setdefault(r.u, []).append((r.v, (r.cost,)))
        adj.setdefault(r.v, []).append((r.u, (r.cost,)))
    nodes = sorted(adj)
    wanted = [(s, g, float(last)) for s in rng.sample(nodes, 5) for g, last in ((rng.choice(nodes), 10), (rng.choice(nodes), 300))]
    goals = spark.createDataFrame(wanted, "start long, node long, last double")
    plain = {s: dijkstra(adj, s, 0) for s, _, _ in wanted}
    for places, every, least in ((None, False, 0), (network.node_places(legs), False, 0), (network.node_places(legs), True, 50_000), (network.node_places(legs), True, 0)):
        monkeypatch.setattr(network, "BEAM_STEPS", least)
        tree = network.shortest_paths(edges, goals.select("start").distinct(), hops=3, goals=goals, places=places, every=every)
        got = {(r.start, r.node): r.cost for r in tree.collect()}
        for s in plain:
            ends = {(g, last) for a, g, last in wanted if a == s and g in plain[s]}
            if every:
                assert all(math.isclose(got[s, g], plain[s][g], abs_tol=1e-6) for g, _ in ends)
            elif ends:
                assert math.isclose(min(got[s, g] + last for g, last in ends if (s, g) in got), min(plain[s][g] + last for g, last in ends), abs_tol=1e-6)
    way = network.path_nodes(tree, goals.select("start", "node"))
    found = {}
    for r in way.orderBy(F.desc("place")).collect():
        found.setdefault((r.start, r.goal), []).append(r.node)
    for (s, g), ns in found.items():
        assert ns[0] == s and ns[-1] == g
        assert math.isclose(sum(next(w[0] for m, w in adj[a] if m == b) for a, b in itertools.pairwise(ns)), plain[s][g], abs_tol=1e-6)
