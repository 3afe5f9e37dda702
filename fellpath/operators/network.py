"""Graph construction and spatial joins over polyline features."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import geo
from fellpath.operators.components import connected_components
from fellpath.plans.staging import materialise

def pair_legs(points: DataFrame) -> DataFrame:
    """Consecutive vertices of each feature as legs with their length in metres."""
    order = Window.partitionBy("feature_ord").orderBy("vertex_ord")
    nxt = points.select("feature_ord", F.col("vertex_ord").alias("leg_ord"), F.col("node_id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *(F.lead(c).over(order).alias(f"b_{n}") for c, n in (("node_id", "id"), ("lat", "lat"), ("lon", "lon"))))
    return with_length(nxt.where(F.col("b_id").isNotNull() & (F.col("a_id") != F.col("b_id"))))


def with_length(legs: DataFrame) -> DataFrame:
    return legs.withColumn("meters", geo.haversine("a_lat", "a_lon", "b_lat", "b_lon"))


def snap_vertices(points: DataFrame, meters: float = 15.0) -> DataFrame:
    """Each vertex with the node it snaps to, in the order (feature_ord, vertex_ord).

    A vertex is a node if no earlier node is within ``meters``; else it snaps to
    an earlier node in reach, that of the smallest cell row, then column, then
    order. Nodes are found by rounds over distinct places: a place whose earlier
    neighbours are all settled as snapped is a node, one next to a node is
    snapped. A round is two joins over what is still open; places in random
    order need a logarithmic number of rounds, a densely drawn line up to one
    for every second vertex. Rows with null coordinates are left out; equal
    orders at one place are one vertex.
    """
    row, col = geo.grid_cell("lat", "lon", meters)
    sound = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = sound.withColumns({"row": row, "col": col, "ord": F.struct("feature_ord", "vertex_ord")})
    places = materialise(placed.groupBy("row", "col", "lat", "lon").agg(F.min("ord").alias("ord")), "places")
    reach = geo.columns_around("lat")
    spread = places.withColumn("c", F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach))).withColumn("r", F.explode(_around("row", 1)))
    look = places.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), F.col("ord").alias("n_ord"))
    near = spread.join(look, ["r", "c"]).where((F.col("n_ord") < F.col("ord")) & (geo.haversine("lat", "lon", "n_lat", "n_lon") <= meters))
    near = materialise(near.select("ord", "n_ord"), "earlier-places")
    nodes = materialise(places.select("ord").join(near.select("ord").distinct(), "ord", "left_anti"), "nodes")
    new = nodes
    while not near.isEmpty():
        snapped = materialise(near.join(new.withColumnRenamed("ord", "n_ord"), "n_ord", "left_semi").select("ord").distinct(), "snapped")
        left = near.join(snapped, "ord", "left_anti").join(snapped.withColumnRenamed("ord", "n_ord"), "n_ord", "left_anti").select("ord", "n_ord")
        left = materialise(left, "earlier-places")
        new = materialise(near.select("ord").distinct().join(snapped, "ord", "left_anti").join(left.select("ord").distinct(), "ord", "left_anti"), "nodes")
        nodes, near = materialise(nodes.union(new), "nodes"), left
    known = places.join(nodes, "ord").select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), F.col("ord").alias("n_ord"))
    offered = spread.drop("ord").join(known, ["r", "c"]).where(geo.haversine("lat", "lon", "n_lat", "n_lon") <= meters).select("lat", "lon", "r", "c", "n_ord")
    # What a place is offered lies in one row of it, so vertices are neither copied nor shuffled for the nodes around them.
    offers = materialise(offered.groupBy("lat", "lon").agg(F.collect_set(F.struct("r", "c", "n_ord")).alias("offers")), "offers")
    held = placed.select("feature_ord", "vertex_ord", "lat", "lon", "ord").dropDuplicates(["feature_ord", "vertex_ord", "lat", "lon"]).join(offers, ["lat", "lon"])
    best = held.withColumn("best", F.array_min(F.filter("offers", lambda x: x["n_ord"] <= F.col("ord")))).where("best is not null")
    return best.select("feature_ord", "vertex_ord", "lat", "lon", F.col("best.n_ord.feature_ord").alias("node_feature"), F.col("best.n_ord.vertex_ord").alias("node_vertex"))


def _around(column: str, reach: int) -> Column:
    return F.sequence(F.col(column) - reach, F.col(column) + reach)


def undirected_edges(legs: DataFrame) -> DataFrame:
    """One row per pair of nodes that a leg joins, with its shortest length."""
    ends = legs.select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), "meters")
    return ends.groupBy("u", "v").agg(F.min("meters").alias("meters"), F.count("*").alias("n_legs"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Every undirected edge in both directions."""
    return edges.select("u", "v", "meters").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "meters"))


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of every node; loops do not count."""
    apart = edges.where(F.col("u") != F.col("v"))
    return adjacency(apart).groupBy(F.col("u").alias("node_id")).agg(F.countDistinct("v").alias("degree"))


#: Edges of a graph whose components one task finds, at most.
TASK_EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node.

    Graphs of up to ``TASK_EDGES`` edges are one task, larger ones go by rounds of joins."""
    apart = materialise(edges.where("u <> v").select("u", "v").distinct(), "component-edges")
    if apart.count() > TASK_EDGES:
        return connected_components(apart, "u", "v").select(F.col("node").alias("node_id"), F.col("root").alias("component_id"))
    kind = edges.schema["u"].dataType.simpleString()
    return apart.coalesce(1).mapInPandas(_components, f"node_id {kind}, component_id {kind}")


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``components`` of edges that one task holds."""
    up: dict = {}

    def root(node):  # noqa: ANN001, ANN202
        top = node
        while up[top] != top:
            top = up[top]
        while up[node] != top:
            up[node], node = top, up[node]
        return top

    for batch in batches:
        for u, v in zip(batch["u"], batch["v"], strict=True):
            for node in (u, v):
                up.setdefault(node, node)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pd.DataFrame({"node_id": list(up), "component_id": [root(node) for node in list(up)]})


SEGMENT = ["a_lat", "a_lon", "b_lat", "b_lon"]


def segments_in_reach(points: DataFrame, legs: DataFrame, meters: float) -> DataFrame:
    """Every (point, leg) pair within ``meters``, with the projection ``p``.

    Legs are copied to the grid cells that their bounding box can be reached
    from; a point looks in its own cell. Only an equi-join on cells remains.
    """
    cell = meters * geo.GRID_MARGIN
    row, col = geo.grid_cell("lat", "lon", cell)
    asked = points.withColumns({"row": row, "col": col})
    lo = geo.grid_cell(F.least("a_lat", "b_lat"), F.least("a_lon", "b_lon"), cell)
    hi = geo.grid_cell(F.greatest("a_lat", "b_lat"), F.greatest("a_lon", "b_lon"), cell)
    reach = geo.columns_around(F.greatest(F.abs("a_lat"), F.abs("b_lat")))
    cells = legs.withColumn("row", F.explode(F.sequence(lo[0] - 1, hi[0] + 1))).withColumn("col", F.explode(F.sequence(lo[1] - reach, hi[1] + reach)))
    found = geo.with_projection(asked.join(cells, ["row", "col"]))
    return found.where(F.col("p.distance") <= meters).drop("row", "col")


def places_in_reach(points: DataFrame, legs: DataFrame, meters: float) -> DataFrame:
    """``segments_in_reach`` of distinct places and distinct segments: lat, lon, the
    segment's ends, p. However often a road is ridden or a place asked for, each
    pair is projected once, so popular cells hold only what is different in them. Segments are
    few bytes and make many pairs, so their number of tasks is told."""
    tasks = max(int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions")), legs.sparkSession.sparkContext.defaultParallelism)
    return segments_in_reach(points.select("lat", "lon").distinct(), legs.select(*SEGMENT).distinct().repartition(tasks), meters)


def nearest_legs(points: DataFrame, legs: DataFrame, k: int, meters: float) -> DataFrame:
    """The ``k`` nearest legs of every point within ``meters``: the point's columns,
    feature_ord, leg_ord, distance, t, rank. Ties (1e-6 m) go to the smaller feature, then leg.

    Segments are ranked before their legs are looked at: the nearest legs lie on the
    ``k`` nearest segments and those as near as the last of them. Of legs on one
    segment only the first ``k`` can be among the nearest.
    """
    first = Window.partitionBy(*SEGMENT).orderBy("feature_ord", "leg_ord")
    few = legs.select(*SEGMENT, "feature_ord", "leg_ord").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    pairs = places_in_reach(points, legs, meters).select("lat", "lon", *SEGMENT, F.col("p.distance").alias("distance"), F.col("p.t").alias("t"))
    near = pairs.withColumn("_n", F.rank().over(Window.partitionBy("lat", "lon").orderBy(F.round("distance", 6)))).where(F.col("_n") <= k).drop("_n")
    order = Window.partitionBy("lat", "lon").orderBy(F.round("distance", 6), "feature_ord", "leg_ord")
    ranked = near.join(few, SEGMENT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop(*SEGMENT)
    return points.join(ranked, ["lat", "lon"])


def features_in_reach(points: DataFrame, legs: DataFrame, vertices: DataFrame, meters: float) -> DataFrame:
    """Features with a leg or a vertex within ``meters`` of any point."""
    if not 0 <= meters < float("inf"):
        return legs.select("feature_ord").limit(0)
    dots = vertices.select("feature_ord", *(F.col(c).alias(f"{e}_{c}") for e in "ab" for c in ("lat", "lon")))
    drawn = legs.select("feature_ord", *SEGMENT).unionByName(dots).distinct()
    near = places_in_reach(points, drawn, meters).select(*SEGMENT).distinct()
    return drawn.join(near, SEGMENT, "left_semi").select("feature_ord").distinct()


#: Directed steps of a network that are sent to all tasks at most (some 50 bytes each); more are joined by shuffle.
BROADCAST_STEPS = 1_000_000
#: Joins between two writes of a search, at first and at most; labels a start keeps while a
#: first bound is looked for, and steps from which on a network is worth that.
FIRST_HOPS, HOPS, BEAM, BEAM_STEPS = 4, 16, 48, 20_000


def _ways(edges: DataFrame) -> DataFrame:
    """Both directions of all edges that can be on a cheapest way: u, v, step, and what ``edges`` holds besides."""
    more = [c for c in edges.columns if c not in ("u", "v", "cost")]
    ways = edges.select("u", "v", "cost", *more).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost", *more)).where("cost >= 0 and u <> v")
    best = ways.groupBy("u", "v").agg(F.min(F.struct(F.col("cost").alias("step"), *more)).alias("x")).select("u", "v", "x.*")
    return materialise(best, "steps")


def _steps(steps: DataFrame, more: list[str], places: DataFrame | None) -> tuple[DataFrame, int]:
    """The ways and a stay at every node, with the place of v where ``places`` are given."""
    stays = steps.select("u", F.col("u").alias("v"), *(F.lit(0).cast(steps.schema[c].dataType).alias(c) for c in ("step", *more))).distinct()
    steps = steps.unionByName(stays)
    if places is not None:
        steps = steps.join(places.select(F.col("node").alias("v"), "lat", "lon").dropDuplicates(["v"]), "v", "left")
    steps = materialise(steps, "steps")
    n = steps.count()
    return F.broadcast(steps) if n <= BROADCAST_STEPS else steps, n


def _ahead(goals: DataFrame, places: DataFrame) -> DataFrame:
    """Per start what no way to any of its goals can undercut: (start, g_lat, g_lon, slack);
    a way from a place costs at least the straight line to the middle of the goals less ``slack``."""
    placed = goals.join(places.select("node", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")), "node")
    middle = placed.groupBy("start").agg(F.avg("n_lat").alias("g_lat"), F.avg("n_lon").alias("g_lon"))
    off = geo.haversine("n_lat", "n_lon", "g_lat", "g_lon") - F.col("last")
    return placed.join(middle, "start").groupBy("start", "g_lat", "g_lon").agg(F.max(off).alias("slack"))


def shortest_paths(edges: DataFrame, starts: DataFrame, limit: float = float("inf"), hops: int = HOPS, *, goals: DataFrame | None = None, places: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Cheapest way from every start to every node within ``limit``: start, node, cost, hops, before.

    ``edges``: u, v, cost (undirected, cost 0 or more) and numbers that are summed along
    the way; ``starts``: start, and where they are given node, cost at which it
    enters and first values of those numbers. ``before`` is the node before on the way (null where it enters); ties go
    to fewer hops, then to the smaller node. Rows with nulls are left out, repeated ones are one.

    Networks of up to ``BROADCAST_STEPS`` steps are sent to all tasks, and starts are
    dealt to tasks that settle their nodes in the order of cost. In larger ones
    a frontier relaxes over the edges, all starts at once, until nothing improves; a
    round is up to ``hops`` joins and aggregations and one write.

    With ``goals`` (start, node, last) a start is searched only as far as the cheapest of
    them needs, or, with ``every``, all; of small networks only the labels on the ways
    to goals are returned. In large ones labels that cost more than that arrival die,
    and, where ``places`` (node, lat, lon) are given and no edge costs less than its
    metres, so do those whose straight line to the goals would. A narrow search
    that keeps the ``BEAM`` most promising labels of a start looks, in large networks, for a first
    arrival, so that the search itself is bounded from its first round; starts for
    which it finds none are searched without. Goals are exact, as are the labels on the ways to them.
    """
    more = [c for c in edges.columns if c not in ("u", "v", "cost")]
    ways = _ways(edges)
    own = starts if "node" in starts.columns else starts.select("start", F.col("start").alias("node"))
    own = own if "cost" in own.columns else own.withColumn("cost", F.lit(0.0))
    zeros = [(F.col(c) if c in own.columns else F.lit(0.0)).cast("double").alias(c) for c in more]
    label = F.struct(F.col("cost").cast("double").alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["u"].dataType).alias("before"), *zeros)
    begin = materialise(own.where(F.col("cost") <= limit).groupBy("start", "node").agg(F.min(label).alias("label")), "entered")
    if ways.count() <= BROADCAST_STEPS:
        return _settled(ways, begin, goals, every, more, limit)
    steps, n_steps = _steps(ways, more, places if goals is not None else None)
    aims = None
    if goals is not None:
        ends = materialise(goals.groupBy("start", "node").agg(F.min(F.col("last").cast("double")).alias("last")), "goals")
        aims = (ends, None if places is None else materialise(_ahead(ends, places), "ahead"), every)
    bound = _search(steps, begin, more, limit, hops, aims, None, BEAM)[1] if places is not None and aims and n_steps > BEAM_STEPS else None
    found = _search(steps, begin, more, limit, hops, aims, bound, None)[0]
    return found.select("start", "node", "label.*")


def _settled(ways: DataFrame, begin: DataFrame, goals: DataFrame | None, every: bool, more: list[str], limit: float) -> DataFrame:
    """``shortest_paths`` over a network that every task holds; one row a start holds its entries and goals."""
    graph = ways.toPandas()
    codes, nodes = pd.factorize(pd.concat([graph["u"], graph["v"]]), sort=True)
    half = len(graph)
    shared = ways.sparkSession.sparkContext.broadcast((nodes, codes[:half], codes[half:], graph["step"].to_numpy(), [graph[c].to_numpy() for c in more]))
    kind, start = begin.schema["node"].dataType.simpleString(), begin.schema["start"].dataType.simpleString()
    rows = begin.select("start", F.struct("node", F.col("label.cost").alias("cost"), F.lit(False).alias("goal"), F.array(*(f"label.{c}" for c in more)).cast("array<double>").alias("sums")).alias("x"))
    if goals is not None:
        goal = F.struct("node", F.col("last").cast("double").alias("cost"), F.lit(True).alias("goal"), F.array().cast("array<double>").alias("sums"))
        rows = rows.unionByName(goals.where("node is not null").select("start", goal.alias("x")).distinct())
    # Rows are few bytes and much work, so their number of tasks is told.
    tasks = max(int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")), ways.sparkSession.sparkContext.defaultParallelism)
    aimed = goals is not None
    asked = rows.repartition(tasks, "start").groupBy("start").agg(F.collect_list("x").alias("rows"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, u, v, step, sums = shared.value
        number = {n: k for k, n in enumerate(nodes)}
        steps: list[list[tuple]] = [[] for _ in number]
        for a, b, w, *x in zip(u.tolist(), v.tolist(), step.tolist(), *(s.tolist() for s in sums), strict=True):
            steps[a].append((b, w, x))
        for batch in batches:
            for key, own in zip(batch["start"], batch["rows"], strict=True):
                entries = [r for r in own if not r["goal"]]
                apart = [(key, r["node"], r["cost"], 0, None, *r["sums"]) for r in entries if r["node"] not in number]
                aims = {}
                for r in own:
                    if r["goal"]:
                        aims[r["node"]] = min(r["cost"], aims.get(r["node"], r["cost"]))
                told = {number[n]: last for n, last in aims.items() if n in number} if aimed else None
                tree = _settle(steps, {number[r["node"]]: (r["cost"], list(r["sums"])) for r in entries if r["node"] in number}, told, every, limit)
                found = apart + [(key, nodes[n], cost, hops, None if before < 0 else nodes[before], *x) for n, (cost, hops, before, x) in tree.items()]
                yield pd.DataFrame(found, columns=["start", "node", "cost", "hops", "before", *more]).astype({"before": "Int64" if kind in ("bigint", "int") else object})

    numbers = "".join(f", `{c}` double" for c in more)
    return materialise(asked.mapInPandas(search, f"start {start}, node {kind}, cost double, hops int, before {kind}{numbers}"), "settled")


def _settle(steps: list[list[tuple]], entries: dict[int, tuple], goals: dict[int, float] | None, every: bool, limit: float) -> dict[int, tuple]:
    """Per settled node (cost, hops, before, sums), by cost, hops, then node before; with
    ``goals`` (node to last) only of nodes on the ways to those that are met."""
    heap = [(cost, 0, -1, n, x) for n, (cost, x) in entries.items()]
    heapq.heapify(heap)
    tree: dict[int, tuple] = {}
    cheapest = {n: cost for n, (cost, _) in entries.items()}
    open_, bound = set(goals or ()), float("inf")
    while heap and (goals is None or open_):
        cost, hops, before, n, x = heapq.heappop(heap)
        if cost > bound:
            break
        if n in tree:
            continue
        tree[n] = (cost, hops, before, x if before < 0 else [a + b for a, b in zip(tree[before][3], x, strict=True)])
        if n in open_:
            open_.discard(n)
            bound = bound if every else min(bound, cost + goals[n])
        for m, w, more in steps[n]:
            far = cost + w
            if m not in tree and far <= limit and far <= cheapest.get(m, far):
                cheapest[m] = far
                heapq.heappush(heap, (far, hops + 1, n, m, more))
    if goals is None:
        return tree
    kept: dict[int, tuple] = {}
    for n in goals:
        while n in tree and n not in kept:
            kept[n] = tree[n]
            n = tree[n][2]
    return kept


def _arrivals(best: DataFrame, ends: DataFrame, every: bool) -> DataFrame:
    """(start, bound): what the cheapest arrival costs, or, with ``every``, the dearest once all are reached."""
    met = ends.join(best, ["start", "node"], "left").groupBy("start").agg(F.min(F.col("label.cost") + F.col("last")).alias("least"), F.max(F.col("label.cost") + F.col("last")).alias("most"), F.count_if(F.col("label").isNull()).alias("missing"))
    return met.select("start", (F.when(F.col("missing") == 0, F.col("most")) if every else F.col("least")).alias("bound"))


def _search(steps: DataFrame, begin: DataFrame, more: list[str], limit: float, hops: int, aims: tuple[DataFrame, DataFrame | None, bool] | None, bound: DataFrame | None, beam: int | None) -> tuple[DataFrame, DataFrame | None]:
    """All labels, and per start its arrival; see ``shortest_paths``.

    What bounds the search of a start travels with its labels, and the places of
    nodes with the steps, so a hop is one join and one aggregation."""
    best, frontier, known, ahead_hops = begin, begin, bound, min(hops, FIRST_HOPS)
    sight = steps.columns
    while True:
        wave = frontier
        aim = F.lit(None).cast("struct<bound:double,g_lat:double,g_lon:double,slack:double>")
        if aims is not None:
            ends, ahead, every = aims
            known = _arrivals(best, ends, every)
            if bound is not None:
                known = known.unionByName(bound).groupBy("start").agg(F.min("bound").alias("bound"))
            facts = known if ahead is None else known.join(ahead, "start", "left")
            wave = wave.join(F.broadcast(facts), "start", "left")
            aim = F.struct("bound", *((F.col(c) if ahead is not None else F.lit(None).cast("double").alias(c)) for c in ("g_lat", "g_lon", "slack")))
            if beam is not None:
                wave = wave.where("bound is null")
        wave = wave.select("start", "node", "label", aim.alias("aim"))
        least = F.col("label.cost")
        if "lat" in sight:
            least = least + F.greatest(F.lit(0.0), F.coalesce(geo.haversine("lat", "lon", "aim.g_lat", "aim.g_lon") - F.col("aim.slack"), F.lit(0.0)))
        for _ in range(ahead_hops):
            step = F.struct((F.col("label.cost") + F.col("step")).alias("cost"), (F.col("label.hops") + 1).alias("hops"), F.col("node").alias("before"), *((F.col(f"label.{c}") + F.col(c)).alias(c) for c in more))
            reached = wave.join(steps, F.col("node") == F.col("u")).withColumn("label", F.when(F.col("u") == F.col("v"), F.col("label")).otherwise(step))
            hopeful = reached.where((F.col("label.cost") <= limit) & (F.col("aim.bound").isNull() | (least <= F.col("aim.bound") + 1e-6)))
            wave = hopeful.groupBy("start", F.col("v").alias("node")).agg(F.min("label").alias("label"), F.first("aim").alias("aim"), *([F.first(least).alias("least")] if beam is not None else []))
        ahead_hops = min(hops, 2 * ahead_hops)
        merged = best.join(wave.withColumnRenamed("label", "offer").drop("aim"), ["start", "node"], "full")
        better = F.col("offer").isNotNull() & (F.col("label").isNull() | (F.col("offer.cost") < F.col("label.cost") - 1e-9))
        merged = materialise(merged.select("start", "node", F.when(better, F.col("offer")).otherwise(F.col("label")).alias("label"), better.alias("better"), *(["least"] if beam is not None else [])), "settled")
        best, frontier = merged.select("start", "node", "label"), merged.where("better")
        if beam is not None:
            frontier = top_of(frontier, ["start"], [F.col("least"), F.col("node")], beam)
        frontier = frontier.select("start", "node", "label")
        if beam is not None and known is not None:
            open_ = _arrivals(best, aims[0], aims[2]).where("bound is null").select("start")
            if frontier.join(open_, "start", "left_semi").isEmpty():
                return best, materialise(_arrivals(best, aims[0], aims[2]), "arrivals")
        elif frontier.isEmpty():
            return best, known


def path_nodes(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of the ways to ``wanted`` (start, node): start, goal, place, node, with
    place 0 at the goal.

    Ancestors are found by doubling: a table of who is 2^k steps before each label
    gives that of 2^(k+1) by one join with itself, and each table takes all that is
    known of the ways that many steps further, so a way of n steps needs about log n
    joins, one write each. Only labels before a wanted one are carried."""
    up = materialise(tree.select("start", "node", "before"), "before")
    at = wanted.select("start", F.col("node").alias("goal"), "node").distinct().join(up.select("start", "node", F.lit(0).alias("place")), ["start", "node"])
    known = materialise(at.select("start", "goal", "place", "node"), "path")
    jump, length = up.where("before is not null").select("start", "node", F.col("before").alias("up")), 1
    while True:
        step = known.join(jump, ["start", "node"]).select("start", "goal", (F.col("place") + length).alias("place"), F.col("up").alias("node"))
        longer = materialise(known.unionByName(step), "path")
        if step.isEmpty():
            return known
        known = longer
        nxt = jump.select("start", F.col("node").alias("up"), F.col("up").alias("far"))
        jump = materialise(jump.join(nxt, ["start", "up"]).select("start", "node", F.col("far").alias("up")), "before")
        length *= 2


def direct_plans(requests: DataFrame, legs: DataFrame, reach: float = 800.0) -> DataFrame:
    """The shortest way over the network between the legs nearest to both ends of each
    request (request, from_lat, from_lon, to_lat, to_lon): request, meters, from_m, to_m.
    The search for each request ends at its destination.

    Both ends snap to their nearest leg within ``reach`` and enter the network
    at either end of that leg; ends on one leg may be joined along it. Requests
    that find no leg or no way have no row. All requests are searched at once.
    """
    measured = materialise(with_length(legs), "measured-legs")
    ends = {}
    for side in ("from", "to"):
        points = requests.select("request", F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon")).where("lat is not null and lon is not null")
        snap = nearest_legs(points, measured, 1, reach).join(measured.select("feature_ord", "leg_ord", "a_id", "b_id", "meters"), ["feature_ord", "leg_ord"])
        ends[side] = materialise(snap.select("request", F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), "meters", "distance", F.when(F.col("a_id") <= F.col("b_id"), F.col("t")).otherwise(1 - F.col("t")).alias("t")), f"{side}-snaps")

    def entries(snaps: DataFrame) -> DataFrame:
        return snaps.select("request", F.explode(F.array(F.struct(F.col("u").alias("node"), (F.col("meters") * F.col("t")).alias("cost")), F.struct(F.col("v").alias("node"), (F.col("meters") * (1 - F.col("t"))).alias("cost")))).alias("e")).select("request", "e.*")

    goals = entries(ends["to"]).select(F.col("request").alias("start"), "node", F.col("cost").alias("last"))
    tree = shortest_paths(undirected_edges(measured).select("u", "v", F.col("meters").alias("cost")), entries(ends["from"]).withColumnRenamed("request", "start"), goals=goals, places=node_places(measured))
    over = tree.join(goals, ["start", "node"]).groupBy(F.col("start").alias("request")).agg(F.min(F.col("cost") + F.col("last")).alias("over"))
    both = ends["from"].alias("f").join(ends["to"].alias("t"), "request").join(over, "request", "left")
    along = F.when((F.col("f.u") == F.col("t.u")) & (F.col("f.v") == F.col("t.v")), F.abs(F.col("f.t") - F.col("t.t")) * F.col("f.meters"))
    out = both.select("request", F.least("over", along).alias("meters"), F.col("f.distance").alias("from_m"), F.col("t.distance").alias("to_m"))
    return out.where("meters is not null")


def node_places(legs: DataFrame) -> DataFrame:
    """(node, lat, lon) of every node; of several places of a node the first in order."""
    ends = legs.select(F.col("a_id").alias("node"), F.struct(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).alias("p")).unionByName(legs.select(F.col("b_id").alias("node"), F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")).alias("p")))
    return ends.groupBy("node").agg(F.min("p").alias("p")).select("node", "p.lat", "p.lon")


def totals(legs: DataFrame, group: str = "feature_ord") -> DataFrame:
    """Per route: meters, access_meters and shared_meters; ``legs`` have meters, access and roles (array)."""
    shared = F.when(F.array_contains("roles", "SharedRoadways"), F.greatest(F.lit(0.0), F.col("meters") - F.col("access"))).otherwise(0.0)
    return legs.groupBy(group).agg(F.sum("meters").alias("meters"), F.sum("access").alias("access_meters"), F.sum(shared).alias("shared_meters"))


def self_overlap(legs: DataFrame, group: str = "feature_ord") -> DataFrame:
    """Per route: metres that repeat an earlier stretch of the same undirected leg (u, v)."""
    per_key = legs.groupBy(group, "u", "v").agg(F.sum("meters").alias("total"), F.max("meters").alias("longest"))
    return per_key.groupBy(group).agg(F.sum(F.greatest(F.lit(0.0), F.col("total") - F.col("longest"))).alias("self_overlap"))


def part_summary(legs: DataFrame, parts: DataFrame) -> DataFrame:
    """Per component: n_features, n_legs, km, and total_km of the whole network."""
    joined = legs.withColumn("node_id", F.least("a_id", "b_id")).join(parts, "node_id")
    per_feature = joined.groupBy("component_id", "feature_ord").agg(F.count("*").alias("n"), F.sum("meters").alias("m"))
    out = per_feature.groupBy("component_id").agg(F.count("*").alias("n_features"), F.sum("n").alias("n_legs"), (F.sum("m") / 1000).alias("km"))
    return out.withColumn("total_km", F.lit(legs.agg(F.sum("meters") / 1000).first()[0]))


def viewports(points: DataFrame, group: str = "feature_ord", pad: float = 0.08, least: float = 0.002) -> DataFrame:
    """Per route the box of its sound points around its centre: at least ``least``
    degrees, ``pad`` of it more on each side, within the limits of the map."""
    sound = points.where(F.col("lat").between(-85, 85) & F.col("lon").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lon"))
    box = sound.groupBy(group).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    half = {c: F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(least)) * (0.5 + pad) for c in ("lat", "lon")}
    centre = {c: (F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2 for c in ("lat", "lon")}
    return box.select(group, F.greatest(F.lit(-85.0), centre["lat"] - half["lat"]).alias("south"), F.least(F.lit(85.0), centre["lat"] + half["lat"]).alias("north"), F.greatest(F.lit(-180.0), centre["lon"] - half["lon"]).alias("west"), F.least(F.lit(180.0), centre["lon"] + half["lon"]).alias("east"))


def turns(legs: DataFrame, group: str = "feature_ord", order: str = "leg_ord") -> DataFrame:
    """Legs with their ``bearing`` and ``delta``, the turn from the leg before (null for the first)."""
    w = Window.partitionBy(group).orderBy(order)
    out = legs.withColumn("bearing", geo.bearing("a_lat", "a_lon", "b_lat", "b_lon"))
    return out.withColumn("delta", geo.turn_delta(F.lag("bearing").over(w), "bearing"))


def reversed_legs(legs: DataFrame, group: str = "feature_ord", order: str = "leg_ord") -> DataFrame:
    """The same route the other way: ends change places, and the order is counted from the end."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    swapped = {f"{x}_{c}": F.col(f"{y}_{c}") for x, y in ("ab", "ba") for c in ("id", "lat", "lon")}
    return legs.withColumn("_back", F.row_number().over(w)).withColumns(swapped | {order: F.col("_back")}).drop("_back")


def route_keys(edges: DataFrame, group: str, edge: str) -> DataFrame:
    """(group, key): the distinct edges of a route in order with their rounded millimetres."""
    summed = edges.groupBy(group, edge).agg(F.floor(F.sum("meters") * 1000 + 0.5).cast("string").alias("mm"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(edge, "mm"))), lambda x: F.concat(x[edge], F.lit(":"), x["mm"]))
    return summed.groupBy(group).agg(F.concat(F.lit("exercise:"), F.array_join(parts, "|")).alias("key"))


def top_of(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group in order; Spark cuts each task to ``k`` before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def first_of(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group in order."""
    return top_of(rows, group, order, 1)


def path_keys(points: DataFrame, group: str = "feature_ord", order: str = "vertex_ord") -> DataFrame:
    """(group, key): the nodes of a path in order, or backwards if that sorts first."""
    ordered = points.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "node_id"))), lambda p: p["node_id"].cast("string")).alias("n"))
    return ordered.select(group, F.least(F.array_join("n", ";"), F.array_join(F.reverse("n"), ";")).alias("key"))


def interval_overlaps(a: DataFrame, b: DataFrame, group: str, cell: float) -> DataFrame:
    """Every pair of intervals (lo, hi) of one group that overlap, with ``overlap``.

    Intervals meet in cells of ``cell`` units; a pair counts in the cell where its
    overlap begins, so none is told twice and only near intervals are compared."""

    def placed(rows: DataFrame, tag: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))
        return rows.where("hi > lo").withColumn("_cell", F.explode(cells)).select(group, "_cell", F.col("lo").alias(f"{tag}_lo"), F.col("hi").alias(f"{tag}_hi"))

    both = placed(a, "a").join(placed(b, "b"), [group, "_cell"]).where("a_lo < b_hi and b_lo < a_hi")
    start = F.greatest("a_lo", "b_lo")
    return both.where(F.floor(start / cell) == F.col("_cell")).withColumn("overlap", F.least("a_hi", "b_hi") - start).drop("_cell")


def points_near(points: DataFrame, places: DataFrame, meters: float) -> DataFrame:
    """``points`` within ``meters`` of any of ``places`` (lat, lon), by grid cells."""
    row, col = geo.grid_cell("lat", "lon", meters * geo.GRID_MARGIN)
    reach = geo.columns_around("lat")
    held = places.select("lat", "lon").distinct().withColumns({"_r": row, "_c": col}).select("_r", "_c", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    spots = points.select("lat", "lon").distinct().withColumns({"_row": row, "_col": col}).withColumn("_r", F.explode(_around("_row", 1))).withColumn("_c", F.explode(F.sequence(F.col("_col") - reach, F.col("_col") + reach)))
    # Sizes are guessed before places are copied to the cells around them, so that side must not be broadcast.
    near = spots.hint("merge").join(held, ["_r", "_c"]).where(geo.haversine("lat", "lon", "p_lat", "p_lon") <= meters).select("lat", "lon").distinct()
    return points.join(near, ["lat", "lon"], "left_semi").select(*points.columns).distinct()


def project_to_polylines(legs: DataFrame, lat: Column, lon: Column, group: str = "feature_ord", order: str = "leg_ord") -> DataFrame:
    """Per polyline the nearest place to a point: distance, along and left; the first leg wins ties (1e-6 m)."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum("meters").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = legs.withColumns({"_at": before, "_whole": F.sum("meters").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_p": geo.project_to_segment(lat, lon, *SEGMENT)})
    along = F.least(F.col("_whole"), F.col("_at") + F.col("_p.t") * F.col("meters"))
    best = rows.groupBy(group).agg(F.min(F.struct(F.round("_p.distance", 6).alias("near"), order, F.col("_p.distance").alias("distance"), along.alias("along"), F.col("_whole").alias("whole"))).alias("x"))
    return best.select(group, "x.distance", "x.along", (F.col("x.whole") - F.col("x.along")).alias("left"))


def within_loop_radius(starts: DataFrame, roads: DataFrame) -> DataFrame:
    """(request, feature_ord): the roads that a loop of each start (request, lat, lon, target)
    can use: within 2 km or four fifths of its target, whichever is more."""
    asked = starts.where("lat is not null and lon is not null").withColumn("radius", F.greatest(F.lit(2000.0), F.col("target") * 0.8))
    most = asked.agg(F.max("radius")).first()[0] or 0.0
    near = segments_in_reach(asked.select("request", "lat", "lon", "radius"), roads.select("feature_ord", *SEGMENT).distinct(), max(most, 1.0))
    return near.where(F.col("p.distance") <= F.col("radius")).select("request", "feature_ord").distinct()


#: Places whose roads are counted in one pass at most and at least, and bytes of their bits that are sent to all tasks.
SPOTS, FEW_SPOTS, SPOT_BYTES = 4096, 512, 64_000_000


def count_within_loop_radius(starts: DataFrame, roads: DataFrame) -> DataFrame:
    """(request, n_roads): how many roads ``within_loop_radius`` finds for each start that has any.

    Each distinct segment holds a bit for every place and radius that it is within; the
    bits of a road are those of its segments, and are counted where the road lies. So
    no pair of a start and a road is a row. Places are taken in passes of up to
    ``SPOTS``, so the bits are bounded."""
    spark = starts.sparkSession
    asked = starts.where("lat is not null and lon is not null").select("request", "lat", "lon", F.greatest(F.lit(2000.0), F.col("target") * 0.8).alias("radius"))
    asked = materialise(asked, "loop-starts")
    drawn = materialise(roads.select("feature_ord", *SEGMENT).distinct(), "road-segments")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = materialise(drawn.select(*SEGMENT).distinct().repartition(tasks), "road-lines")
    n, most = asked.select("lat", "lon", "radius").distinct().agg(F.count("*"), F.max("radius")).first()
    size = max(FEW_SPOTS, min(SPOTS, SPOT_BYTES * 8 // max(lines.count(), 1)))
    passes = max(1, -(-n // size))
    at = ["lat", "lon", "radius"]
    spots = asked.select(*at).distinct().withColumn("pass", F.pmod(F.xxhash64(*at), F.lit(passes)))
    spots = materialise(spots.withColumn("slot", F.row_number().over(Window.partitionBy("pass").orderBy(*at)) - 1), "spots")
    counts = None
    for k in range(passes):
        own = spots.where(F.col("pass") == k)
        width = 8 * (-(-((own.agg(F.max("slot")).first()[0] or 0) + 1) // 8))
        near = segments_in_reach(own.select("slot", *at), lines, max(most or 0.0, 1.0)).where(F.col("p.distance") <= F.col("radius"))
        # What lies too far north or south is left out before it is projected.
        off = F.degrees(F.col("radius") / 6_000_000)
        near = near.where((F.col("lat") >= F.least("a_lat", "b_lat") - off) & (F.col("lat") <= F.greatest("a_lat", "b_lat") + off))
        held = materialise(_bits(near.groupBy(*SEGMENT).agg(F.collect_set("slot").alias("slots")), width), "road-bits")
        held = F.broadcast(held) if lines.count() * width // 8 <= SPOT_BYTES else held
        found = _counted(drawn.join(held, SEGMENT).groupBy("feature_ord").agg(F.collect_list("bits").alias("bits")), width)
        found = materialise(found.groupBy("slot").agg(F.sum("n").alias("n_roads")).withColumn("pass", F.lit(k).cast("long")), "road-counts")
        counts = found if counts is None else counts.unionByName(found)
    told = spots.join(counts, ["pass", "slot"]).select(*at, "n_roads")
    return asked.join(told, at).select("request", "n_roads")


def _bits(rows: DataFrame, width: int) -> DataFrame:
    """Segments with ``slots`` as bits."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for slots in batch["slots"]:
                row = np.zeros(width, np.uint8)
                row[np.asarray(slots, np.int64)] = 1
                held.append(np.packbits(row).tobytes())
            yield batch[SEGMENT].assign(bits=held)

    return rows.mapInPandas(pack, ", ".join(f"{c} double" for c in SEGMENT) + ", bits binary")


def _counted(roads: DataFrame, width: int) -> DataFrame:
    """Per task (slot, n): of the roads with the ``bits`` of their segments, those that hold the slot."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            sizes = np.array([len(b) for b in batch["bits"]], np.int64)
            for a in range(0, len(sizes), 1024):
                own = batch["bits"].iloc[a : a + 1024]
                rows = np.frombuffer(b"".join(b for bits in own for b in bits), np.uint8).reshape(-1, width // 8)
                first = np.concatenate(([0], np.cumsum(sizes[a : a + 1024])[:-1]))
                total += np.unpackbits(np.bitwise_or.reduceat(rows, first, axis=0), axis=1).sum(0, dtype=np.int64)
        slots = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slots.astype(np.int32), "n": total[slots]})

    return roads.select("bits").mapInPandas(count, "slot int, n long")
