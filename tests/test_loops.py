"""Loops: whole plans on small networks, and the choice of anchors, further nodes and retraced metres against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fellpath.operators import loops, network, planning
from tests.test_planning import node, place, table

ASKED = "request long, lat double, lon double, target double"


def asked(spark, *rows):
    return spark.createDataFrame([(r, *place(*p), float(t)) for r, p, t in rows], ASKED)


def grid(n, step, x0=0, y0=0):
    lines = [[(x0 + i * step, y0 + j * step), (x0 + (i + 1) * step, y0 + j * step)] for i in range(n) for j in range(n + 1)]
    return lines + [[(x0 + i * step, y0 + j * step), (x0 + i * step, y0 + (j + 1) * step)] for i in range(n + 1) for j in range(n)]


def checked(row, trails, start):
    """A loop closes at the edge of its start and follows edges whose metres add up."""
    edges = {(r.u, r.v): r.meters for r in loops.graph(trails).collect()}
    length = {(a, b): m for (u, v), m in edges.items() for a, b in ((u, v), (v, u))}
    inner = sum(length[a, b] for a, b in itertools.pairwise(row.nodes))
    tails = sum(math.dist(start, (n // 1_000_000 - 50_000, n % 1_000_000 - 50_000)) for n in (row.nodes[0], row.nodes[-1]))
    assert math.isclose(row.meters, inner + tails + row.access, rel_tol=1e-3)
    used = [tuple(sorted(p)) for p in itertools.pairwise(row.nodes)]
    return len(used) - len(set(used))


def rings(x):
    """Two equal rings that share their middle edge."""
    east = [[(x, 0), (x + 300, 0)], [(x + 300, 0), (x + 300, 300)], [(x + 300, 300), (x, 300)], [(x, 300), (x, 0)]]
    west = [[(x, 0), (x - 300, 0)], [(x - 300, 0), (x - 300, 300)], [(x - 300, 300), (x, 300)]]
    return east, west


def test_loops(spark):
    """Networks far from each other, planned together.

    A grid holds circuits of the target from a corner and from within; a line holds
    ways out and back only. On a net of nine cells there is a circuit of exactly the target, and no
    better one. Of two rings the one not ridden before is taken, and the one without
    a hazard. A start between two dead ends and a ring takes the ring, further off, for want of a
    circuit. Requests without a place or a sound target have no loop, repeated ones have one."""
    lines = {"grid": grid(5, 200), "line": [[(20_000 + i * 200, 0), (20_200 + i * 200, 0)] for i in range(7)], "net": grid(3, 250, x0=-20_000), "ends": [[(30_000, 0), (30_400, 0)], [(30_400, 0), (30_800, 0)], *grid(2, 300, x0=30_000, y0=100)]}
    pairs = {k: rings(k * 10_000) for k in (-3, -4, 4, -1)}
    trails = table(spark, [line for part in lines.values() for line in part] + [line for pair in pairs.values() for side in pair for line in side])
    bad = [node((-10_000 + 300, 0)), node((-10_000 + 300, 300)), node((40_000 - 300, 0)), node((40_000 - 300, 300))]
    trails = trails.withColumn("hazard", F.when(F.col("a_id").isin(bad) | F.col("b_id").isin(bad), 5000.0).otherwise(0.0))
    ridden = [(node(a), node(b), 3.0) for side in (pairs[-3][0], pairs[-4][1]) for a, b in side[:3]]
    history = spark.createDataFrame(ridden, "u long, v long, weight double")
    wanted = asked(spark, (1, (100, 0), 2000), (2, (20_100, 0), 2000), (3, (20_100, 3000), 2000), (4, (100, 0), 100), (5, (500, 400), 1600), (6, (-19_875, 0), 2000), (7, (30_380, 20), 1200), (7, (30_380, 20), 1200), *((10 + i, (k * 10_000, 150), 1200) for i, k in enumerate(pairs)))
    odd = spark.createDataFrame([(20, None, -89.0, 1200.0), (21, 40.0, -89.0, None), (22, 40.0, -89.0, -5.0), (23, 50.0, -89.0, 1200.0)], ASKED)
    rows = loops.loops(wanted.unionByName(odd), trails, history=history).collect()
    found = {r.request: r for r in rows}
    assert len(rows) == len(found) and set(found) == {1, 2, 5, 6, 7, 10, 11, 12, 13}
    for k, target, start in ((1, 2000, (100, 0)), (5, 1600, (500, 400)), (6, 2000, (-19_875, 0)), (7, 1200, None)):
        r = found[k]
        assert r.status == "Exact" and r.circuit and r.within and abs(r.meters - target) <= max(160, target / 10)
        assert r.overlap / r.meters < 0.4 and (start is None or checked(r, trails, start) <= 1)
    back = found[2]
    assert back.status == "Closest" and not back.circuit and back.overlap > 0.4 * back.meters
    assert checked(back, trails, (20_100, 0)) == len(back.nodes) // 2
    assert found[6].error <= 1 + found[6].access and found[6].overlap == 0
    assert found[7].entry > 2
    for i, (k, sign) in enumerate(((-3, -1), (-4, 1), (4, 1), (-1, -1))):
        r = found[10 + i]
        goes = [any(node((k * 10_000 + side * 300, y)) in r.nodes for y in (0, 300)) for side in (sign, -sign)]
        assert goes == [True, False] and r.circuit and not r.hazard and r.history == 0


def test_roads_lead_to_loops(spark):
    """A start away from the trails reaches them by road; access counts both ways."""
    trails = table(spark, grid(3, 300))
    roads = table(spark, [[(150, -500), (150, -2)]], roles=("SharedRoadways",), first=900)
    row = loops.loops(asked(spark, (1, (152, -500), 2400)), trails, roads).collect()[0]
    assert 900 < row.access < 1100 and row.status == "Exact" and abs(row.meters - 2400) <= 240


def choice(rows, target, start):
    """The greedy choice, one node after the other."""
    def bearing(n):
        return int((math.atan2(n[2] - start[1], n[1] - start[0]) % (2 * math.pi)) / (2 * math.pi) * 8)

    ordered = sorted((n for n in rows if n[3] > 0), key=lambda n: (round(abs(n[3] - target / 2), 6), n[0]))
    ordered = [n for n in ordered if 0.08 * target <= n[3] <= 0.55 * target] or ordered
    taken, bearings, bands = [], set(), set()
    for need in (2, 1, 0):
        for n in ordered:
            b, d = bearing(n), int(n[3] / max(1.0, target / 2) * 4)
            if len(taken) < 10 and n[0] not in taken and (b not in bearings) + (d not in bands) >= need:
                taken.append(n[0])
                bearings.add(b)
                bands.add(d)
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors(spark, seed):
    rng = random.Random(seed)
    nodes = {s: [(n, 40 + rng.uniform(-0.01, 0.01), -89 + rng.uniform(-0.01, 0.01), float(rng.randint(0, 1700))) for n in range(size)] for s, size in ((1, 90), (2, 4), (3, 30))}
    targets = {1: 2000.0, 2: 2000.0, 3: 40_000.0}
    places = spark.createDataFrame([(s * 1000 + n, a, b) for s in nodes for n, a, b, _ in nodes[s]], "node long, lat double, lon double")
    tree = spark.createDataFrame([(s, s * 1000 + n, m, n) for s in nodes for n, _, _, m in nodes[s]], "start long, node long, meters double, id long")
    starts = spark.createDataFrame([(s, 40.0, -89.0, t) for s, t in targets.items()], "start long, lat double, lon double, target double")
    got = {}
    for r in loops.anchors(tree, starts, places).orderBy("start", "anchor").collect():
        got.setdefault(r.start, []).append(r.node)
    for s in nodes:
        assert got[s] == choice([(s * 1000 + n, a, b, m) for n, a, b, m in nodes[s]], targets[s], (40.0, -89.0))


@pytest.mark.parametrize("seed", [1, 2])
def test_retraced(spark, seed):
    """Stems and spurs by walking both ways node by node."""
    rng = random.Random(seed)
    lines = [x for x in grid(5, 100) if rng.random() < 0.8]
    trails = table(spark, lines)
    edges = loops.graph(trails).withColumn("cost", F.col("meters") + (F.col("u") * 7 + F.col("v") * 13) % 31)
    root = sorted({p for x in lines for p in x})[0]
    labels, log = planning.two_label_search(edges, spark.createDataFrame([(1, node(root))], "start long, node long"), 5000.0, hops=2)
    out = loops.befores(labels.where("cheapest"), log).persist()
    anchor = max(out.collect(), key=lambda r: r.meters)
    back_labels, back_log = planning.two_label_search(edges, spark.createDataFrame([(17, anchor.node)], "start long, node long"), 5000.0, hops=3)
    back = loops.befores(back_labels.where("cheapest"), back_log).withColumnsRenamed({"start": "key"}).withColumn("start", F.lit(1).cast("long"))
    up = {r.node: r for r in out.collect()}
    on = {r.node: r.before for r in back.collect()}
    length = {(r.u, r.v): r.meters for r in edges.collect()}

    def chain(n):
        while n is not None:
            yield n
            n = up[n].before

    branch = set(chain(anchor.node))
    got = {r.node: r.retraced for r in loops.retraced(out, back, spark.createDataFrame([(17, 1, n) for n in branch], "key long, start long, node long"), edges).collect()}
    for n in on:
        stem = next(up[x].meters for x in chain(n) if x in branch)
        spur, at = 0.0, n
        while on[at] is not None and on[at] == up[at].before:
            spur += length[min(at, on[at]), max(at, on[at])]
            at = on[at]
        assert math.isclose(got[n], stem + spur, abs_tol=1e-6)


def test_no_trails(spark):
    assert loops.loops(asked(spark, (1, (0, 150), 1200)), table(spark, grid(1, 300)).limit(0)).count() == 0
