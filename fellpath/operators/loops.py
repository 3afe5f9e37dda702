"""Loops: routes from a start back to it whose length comes near a target.

Trails and roads are tables as in ``planning``; trails may have a ``hazard`` (cost of
a leg that enters one). All requests are planned together: a search outward from every entry into
the trails, anchors of each, a search back from every anchor on which what was ridden
is dearer, then candidates by way of further nodes, scored as they would be ridden.

Defined results: requests without a position, with a target out of range, or
with no way back have no row; repeated requests are one; ties (1e-6) go to the
smaller entry, then to the route whose nodes sort first; empty tables give
empty results. Nodes are joined by one edge, the cheapest of their legs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellpath.functions import geo
from fellpath.operators import network, planning, rules, sequence
from fellpath.plans.staging import materialise

#: Bearings and distance bands of anchors; anchors of a search and further nodes of an anchor;
#: the share of the target between which anchors lie, and how far the searches out and back go.
BEARINGS, BANDS, ANCHORS, VIAS = 8, 4.0, 10, 6
NEAREST, FURTHEST, OUT, BACK = 0.08, 0.55, 0.85, 1.0
#: Times the cost that ridden edges cost more, on the way back and by earlier rides; share of overlap from which on a route is no circuit.
REUSE, HISTORY, CIRCUIT = 2.0, 2.0, 0.40
#: Entries that are always searched and metres to one without roads; shortest and longest target.
PRIMARY, DIRECT = 2, 800.0
SHORTEST, LONGEST = 804.672, 160_934.4
SLOTS = 16


def graph(trails: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The edges of a search: u, v, meters, safety, hazard, past, cost.

    ``history`` (u, v, weight) tells how often an edge was ridden, by age; ``past`` is
    that times its metres. No edge is free, so that ways to cheaper nodes end."""
    hazard = (F.col("hazard") if "hazard" in trails.columns else F.lit(0.0)).alias("hazard")
    safety = geo.edge_cost("meters", "facility", "comfort", "roles", hazard=hazard).alias("safety")
    legs = trails.where("a_id <> b_id and meters is not null").select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), F.struct(safety, "meters", hazard).alias("x"))
    edges = legs.groupBy("u", "v").agg(F.min("x").alias("x")).select("u", "v", "x.*")
    if history is None:
        edges = edges.withColumn("past", F.lit(0.0))
    else:
        ridden = history.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("weight").alias("_w"))
        edges = edges.join(ridden, ["u", "v"], "left").withColumn("past", F.coalesce("_w", F.lit(0.0)) * F.col("meters")).drop("_w")
    return edges.withColumn("cost", F.greatest(F.col("safety") + F.col("past") * HISTORY, F.lit(0.001)))


def entries(asked: DataFrame, trails: DataFrame, roads: DataFrame | None, parts: DataFrame) -> DataFrame:
    """Where each request (request, lat, lon) can enter the trails: request, entry, feature_ord,
    leg_ord, t, p_lat, p_lon, routed, estimated, primary.

    By roads where some lead there, else straight; the first two, and of the others (eight at
    most in all) those that lie first in a component (``parts``) not entered before."""
    kept = ["request", "feature_ord", "leg_ord", "t", "p_lat", "p_lon", "routed", "estimated"]
    found = None
    if roads is not None:
        by_road = planning.endpoint_access(asked.withColumnRenamed("request", "endpoint"), trails, roads).withColumnRenamed("endpoint", "request")
        found = by_road.select(*kept, F.col("entry").alias("rank"))
        asked = asked.join(by_road.select("request").distinct(), "request", "left_anti")
    near = network.nearest_legs(asked, trails, planning.ENTRIES, DIRECT).join(trails.select("feature_ord", "leg_ord", *network.SEGMENT), ["feature_ord", "leg_ord"])
    at = geo.project_to_segment("lat", "lon", *network.SEGMENT)
    straight = near.withColumns({"p_lat": at["lat"], "p_lon": at["lon"], "routed": F.lit(0.0), "estimated": F.col("distance")}).select(*kept, "rank")
    found = straight if found is None else found.unionByName(straight)
    placed = found.join(trails.where("a_id <> b_id").select("feature_ord", "leg_ord", "a_id"), ["feature_ord", "leg_ord"]).join(parts.withColumnRenamed("node_id", "a_id"), "a_id")
    placed = materialise(network.top_of(placed, ["request"], [F.col("rank"), F.col("feature_ord"), F.col("leg_ord")], planning.ENTRIES), "loop-entries")
    first = network.top_of(placed, ["request"], [F.col("rank"), F.col("feature_ord"), F.col("leg_ord")], PRIMARY).withColumn("primary", F.lit(True))
    rest = placed.join(first.select("request", "component_id"), ["request", "component_id"], "left_anti")
    other = network.first_of(rest, ["request", "component_id"], [F.col("rank"), F.col("feature_ord"), F.col("leg_ord")]).withColumn("primary", F.lit(False))
    return materialise(first.unionByName(other).withColumn("entry", F.col("rank").cast("long")).select("entry", "primary", *kept), "loop-entries")


def roots(asked: DataFrame, found: DataFrame, trails: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each request and entry, with ``start`` (the key of its searches), the edge
    it lies on (u, v), how far (``along``, 0 at u), its lengths and costs, and ``access`` one way."""
    legs = trails.select("feature_ord", "leg_ord", F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), (F.col("a_id") > F.col("b_id")).alias("_back"))
    on = found.join(legs, ["feature_ord", "leg_ord"]).join(edges, ["u", "v"]).join(asked, "request")
    start = F.col("request") * SLOTS + F.col("entry")
    along = F.when(F.col("_back"), 1 - F.col("t")).otherwise(F.col("t"))
    return on.select(start.alias("start"), "request", "entry", "lat", "lon", "target", "p_lat", "p_lon", "u", "v", along.alias("along"), "meters", "safety", "hazard", "past", "cost", (F.col("routed") + F.col("estimated")).alias("access"), geo.access_cost("routed", "estimated").alias("access_cost"))


def halves(root: DataFrame, key: str = "start") -> DataFrame:
    """Both ways from a root to the ends of its edge: ``key``, node, share, and lengths and costs in proportion."""
    parts = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("along").alias("share")), F.struct(F.col("v").alias("node"), (1 - F.col("along")).alias("share")))).alias("e")
    rows = root.select(key, "target", "access", "access_cost", *(F.col(c).alias(f"_{c}") for c in ("meters", "safety", "hazard", "past", "cost")), parts)
    return rows.select(key, "target", "access", "access_cost", "e.node", "e.share", *((F.col(f"_{c}") * F.col("e.share")).alias(c) for c in ("meters", "safety", "hazard", "past", "cost")))


def bearing_bucket(lat: str, lon: str, to_lat: str, to_lon: str) -> Column:
    """One of eight directions in the plane of degrees, 0 from north on clockwise."""
    turn = F.pmod(F.atan2(F.col(to_lon) - F.col(lon), F.col(to_lat) - F.col(lat)) / (2 * F.pi()) + 1, F.lit(1.0))
    return F.floor(turn * BEARINGS).cast("int")


def anchors(tree: DataFrame, starts: DataFrame, places: DataFrame) -> DataFrame:
    """Up to ten turning points of every search: start, anchor (from 1, in order of choice), node, meters, id.

    ``tree`` (start, node, meters, id) holds cheapest labels; ``starts`` start, lat, lon, target. Nodes near half the target
    come first, if any those between ``NEAREST`` and ``FURTHEST`` of it alone: at first one for every new
    bearing and distance band at once, then for either, then any. Of a bearing and
    band only the first node can be taken in the first two turns, and the third takes the first
    that are left, so some eighty rows of a search decide."""
    rows = tree.where("meters > 0").join(starts.select("start", "lat", "lon", "target"), "start").join(places.select("node", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")), "node")
    inside = F.col("meters").between(F.col("target") * NEAREST, F.col("target") * FURTHEST)
    rows = rows.select("start", "node", "meters", "id", F.round(F.abs(F.col("meters") - F.col("target") / 2), 6).alias("off"), bearing_bucket("lat", "lon", "n_lat", "n_lon").alias("bearing"), F.floor(F.col("meters") / F.greatest(F.lit(1.0), F.col("target") / 2) * BANDS).cast("int").alias("band"), inside.alias("inside"))
    rows = materialise(rows, "reachable")
    ranked = rows.join(rows.groupBy("start").agg(F.max("inside").alias("some")), "start").where("inside or not some")
    order = [F.col("off"), F.col("node")]
    few = network.first_of(ranked, ["start", "bearing", "band"], order).unionByName(network.top_of(ranked, ["start"], order, ANCHORS)).distinct()
    sorted_rows = F.array_sort(F.collect_list(F.struct("off", "node", "bearing", "band", "meters", "id"))).alias("rows")
    taken = few.groupBy("start").agg(sorted_rows).select("start", _in_turns(F.col("rows"))["taken"].alias("taken"))
    return taken.select("start", F.posexplode("taken").alias("place", "x")).select("start", (F.col("place") + 1).cast("long").alias("anchor"), "x.node", "x.meters", "x.id")


def _in_turns(rows: Column) -> Column:
    """The greedy choice of ``anchors`` over sorted rows."""
    none = F.array().cast("array<int>")
    state = F.struct(F.slice(rows, 1, 0).alias("taken"), none.alias("bearings"), none.alias("bands"))
    for need in (2, 1, 0):
        state = F.aggregate(rows, state, _turn(need))
    return state


def _turn(need: int) -> Callable[[Column, Column], Column]:
    """One row of a turn that takes rows with ``need`` new ones of bearing and band."""

    def step(s: Column, r: Column) -> Column:
        fresh = (~F.array_contains(s["bearings"], r["bearing"])).cast("int") + (~F.array_contains(s["bands"], r["band"])).cast("int")
        room = (F.size(s["taken"]) < ANCHORS) & ~F.exists(s["taken"], lambda x: x["node"] == r["node"])
        more = F.struct(F.concat(s["taken"], F.array(r)).alias("taken"), F.concat(s["bearings"], F.array(r["bearing"])).alias("bearings"), F.concat(s["bands"], F.array(r["band"])).alias("bands"))
        return F.when(room & (fresh >= need), more).otherwise(s)

    return step


def befores(labels: DataFrame, log: DataFrame) -> DataFrame:
    """Labels (start, node, id) with ``before``, the node before on their way (null where it enters)."""
    log = log.dropDuplicates(["id"])
    held = labels.join(log.select("start", "id", "prev", "via"), ["start", "id"])
    ends = log.select("start", F.col("id").alias("prev"), F.col("node").alias("_at"))
    before = F.when(F.size("via") > 1, F.try_element_at("via", F.lit(-2))).when(F.size("via") == 1, F.col("_at"))
    return held.join(ends, ["start", "prev"], "left").withColumn("before", before).drop("prev", "via", "_at")


def along_pointers(rows: DataFrame) -> DataFrame:
    """(part, node, gain): the sum of ``gain`` from each node along its pointers ``up`` (part, node, up, gain).

    Pointers double their length each round, so long ways need few; they must not run in circles."""
    rows = materialise(rows.select("part", "node", "up", "gain"), "pointers")
    while not rows.where("up is not null").isEmpty():
        far = rows.select("part", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("gain").alias("_gain"))
        rows = materialise(rows.join(far, ["part", "up"], "left").select("part", "node", F.col("_up").alias("up"), (F.col("gain") + F.coalesce("_gain", F.lit(0.0))).alias("gain")), "pointers")
    return rows.select("part", "node", "gain")


def retraced(out: DataFrame, back: DataFrame, branches: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, node, retraced): metres that a loop out to an anchor, on to ``node`` and home by the outward tree rides twice.

    ``out`` (start, node, meters, before) and ``back`` (key, start, node, before) are the trees; ``branches`` (key, start, node) the
    nodes on the way to the anchor. The stem is how far the way to the node runs along
    that to the anchor; the spur, how far both trees reach the node over the same edges.
    Nodes stand for their cheapest labels."""
    keys = branches.select("key", "start").distinct()
    on = branches.select("key", "node", F.lit(True).alias("_on")).distinct()
    stem = out.join(keys, "start").join(on, ["key", "node"], "left").select(F.struct("key", F.lit("stem").alias("kind")).alias("part"), "node", F.when(F.col("_on").isNull(), F.col("before")).alias("up"), F.when(F.col("_on"), F.col("meters")).otherwise(0.0).alias("gain"))
    both = back.select("key", "start", "node", "before").join(out.select("start", "node", F.col("before").alias("_before")), ["start", "node"])
    same = both.withColumn("up", F.when(F.col("before") == F.col("_before"), F.col("before"))).withColumns({"u": F.least("node", "up"), "v": F.greatest("node", "up")})
    spur = same.withColumns({"u": F.when(F.col("up").isNotNull(), F.col("u")), "v": F.when(F.col("up").isNotNull(), F.col("v"))}).join(edges.select("u", "v", "meters"), ["u", "v"], "left").select(F.struct("key", F.lit("spur").alias("kind")).alias("part"), "node", "up", F.coalesce("meters", F.lit(0.0)).alias("gain"))
    return along_pointers(stem.unionByName(spur)).groupBy("part.key", "node").agg(F.sum("gain").alias("retraced"))


def vias(out: DataFrame, back: DataFrame, chosen: DataFrame, again: DataFrame, places: DataFrame) -> DataFrame:
    """Up to six further nodes of every anchor: key, via, node, id (of the way from the anchor), root_id.

    ``chosen`` (key, start, node, meters, lat, lon, target) holds the anchors, ``again`` what ``retraced`` gives. Nodes in another
    direction than the anchor come first, then by error and overlap of the whole loop."""
    at = places.select("node", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    to = chosen.join(at, "node").select("key", "lat", "lon", "target", F.col("node").alias("_anchor"), F.col("meters").alias("_out"), bearing_bucket("lat", "lon", "n_lat", "n_lon").alias("_bearing"))
    rows = back.select("key", "start", "node", F.col("meters").alias("_on"), "id").join(to, "key").where(F.col("node") != F.col("_anchor"))
    rows = rows.join(out.select("start", "node", F.col("meters").alias("_home"), F.col("id").alias("root_id")), ["start", "node"]).join(again, ["key", "node"], "left").join(at, "node")
    total = F.col("_out") + F.col("_on") + F.col("_home")
    score = F.abs(total - F.col("target")) * 6.0 + rules.overlap_penalty(total, F.coalesce("retraced", F.lit(0.0))) * 5.0
    rows = rows.select("key", "node", "id", "root_id", (bearing_bucket("lat", "lon", "n_lat", "n_lon") == F.col("_bearing")).alias("same"), F.round(score, 6).alias("score"))
    order = [F.col("same"), F.col("score"), F.col("node")]
    return network.top_of(rows, ["key"], order, VIAS).select("key", F.col("node").alias("via"), "id", "root_id")


def candidates(root: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """The loops that are tried from every root: start, key, via (null: straight home), nodes (array)."""
    search = edges.select("u", "v", "cost", "meters")
    begin = halves(root).select("start", "node", (F.col("access_cost") + F.col("cost")).alias("cost"), (F.col("access") + F.col("meters")).alias("meters"), (F.col("target") * OUT + F.col("access") * 2).alias("cap"))
    labels, log = planning.two_label_search(search, begin, F.col("cap"))
    log = materialise(log.dropDuplicates(["id"]), "log")
    out = materialise(befores(labels.where("cheapest"), log), "outward")
    chosen = anchors(out, root, places).withColumn("key", F.col("start") * SLOTS + F.col("anchor"))
    chosen = materialise(chosen.join(root.select("start", "lat", "lon", "target", "access"), "start"), "anchors")
    ways = materialise(planning.label_ways(log, chosen.select("start", "id")).join(chosen.select("start", "id", "key"), ["start", "id"]).select("key", "start", "nodes"), "ways-out")
    step = ways.select("key", "start", F.posexplode("nodes").alias("place", "node"), F.col("nodes").alias("_all")).withColumn("_next", F.try_element_at("_all", (F.col("place") + 2).cast("int"))).drop("_all")
    step = materialise(step, "steps-out")
    ridden = step.where("_next is not null").select("key", F.least("node", "_next").alias("u"), F.greatest("node", "_next").alias("v")).distinct()
    ends = materialise(halves(root), "halves")
    # A half that holds access is not dearer on the way back, nor is the edge it lies on for its sake.
    first = step.where("place = 0").join(ends.where("access = 0").select("start", "node", "share"), ["start", "node"]).join(root.select("start", "u", "v", F.col("cost").alias("_cost")), "start")
    dearer = ridden.join(edges.select("u", "v", "cost"), ["u", "v"]).select(F.col("key").alias("start"), "u", "v", (F.col("cost") * REUSE).alias("extra"))
    dearer = dearer.unionByName(first.select(F.col("key").alias("start"), "u", "v", (F.col("_cost") * REUSE * F.col("share")).alias("extra")))
    again = chosen.select(F.col("key").alias("start"), "node", (F.col("target") * BACK + F.col("access") * 2).alias("cap"))
    back_labels, back_log = planning.two_label_search(search, again, F.col("cap"), overlay=dearer)
    back_log = materialise(back_log.dropDuplicates(["id"]), "log")
    keys = chosen.select("key", "start")
    back_labels = materialise(back_labels.withColumnRenamed("start", "key").join(keys, "key"), "homeward")
    over = root.select("start", "u", "v").join(keys, "start").join(ridden, ["key", "u", "v"], "left_semi").select("key", F.lit(True).alias("_over"))
    home = back_labels.join(ends.select("start", "node", "share", "target", "access", "access_cost", F.col("cost").alias("_cost"), F.col("meters").alias("_meters")), ["start", "node"])
    home = home.join(step.where("place = 0").select("key", F.col("node").alias("_first")), "key").join(over, "key", "left")
    reused = ((F.col("node") == F.col("_first")) | F.coalesce("_over", F.lit(False))) & (F.col("access") == 0)
    home = home.withColumns({"_c": F.col("cost") + F.col("access_cost") + F.col("_cost") * F.when(reused, 1 + REUSE).otherwise(1.0), "_m": F.col("meters") + F.col("access") + F.col("_meters")})
    home = home.where(F.col("_m") <= F.col("target") * BACK + F.col("access") * 2)
    straight = network.first_of(home, ["key"], [F.round("_c", 6), F.round("_m", 6), F.col("node"), F.col("id")]).select("key", "start", F.lit(None).cast(places.schema["node"].dataType).alias("via"), "id", F.lit(None).cast("long").alias("root_id"))
    back = materialise(befores(back_labels.where("cheapest").drop("start").withColumnRenamed("key", "start"), back_log).withColumnRenamed("start", "key").join(keys, "key"), "homeward")
    twice = retraced(out, back, step.select("key", "start", "node"), edges)
    further = vias(out, back, chosen, twice, places).join(keys, "key")
    tried = materialise(straight.unionByName(further.select(*straight.columns)), "tried")
    onward = planning.label_ways(back_log, tried.select(F.col("key").alias("start"), "id")).select(F.col("start").alias("key"), "id", F.col("nodes").alias("_on"))
    homeward = planning.label_ways(log, tried.where("root_id is not null").select("start", F.col("root_id").alias("id"))).select("start", F.col("id").alias("root_id"), F.col("nodes").alias("_home"))
    whole = tried.join(ways.select("key", "nodes"), "key").join(onward, ["key", "id"]).join(homeward, ["start", "root_id"], "left")
    rest = F.when(F.col("_home").isNull(), F.slice("nodes", 1, 0)).otherwise(_after_first(F.reverse("_home")))
    return whole.select("start", "key", "via", F.concat("nodes", _after_first(F.col("_on")), rest).alias("nodes"))


def _after_first(nodes: Column) -> Column:
    return F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0)))


def scored(tried: DataFrame, root: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates as they would be ridden: request, entry, meters, access, overlap, history, error, circuit, within, hazard, score, route."""
    text = F.transform(F.col("nodes"), lambda n: n.cast("string"))
    route = F.least(F.array_join(text, ";"), F.array_join(F.reverse(text), ";"))
    tried = network.first_of(tried.withColumn("route", route), ["start", "route"], [F.col("key"), F.col("via").asc_nulls_first()])
    tried = materialise(tried.withColumn("candidate", F.concat_ws(":", "key", F.coalesce(F.col("via").cast("string"), F.lit("-")))), "candidates")
    kind, last = places.schema["node"].dataType, F.size("nodes")
    pairs = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * 2).alias("leg_ord"), F.when(k > 0, F.get("nodes", k - 1)).alias("a"), F.when(k < last, F.get("nodes", k)).alias("b")))
    steps = tried.select("candidate", "start", F.explode(pairs).alias("s")).select("candidate", "start", "s.*")
    inner = steps.where("a is not null and b is not null").withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})
    own = root.select("start", "u", "v")
    # Who rides past the start rides both halves of its edge.
    past = inner.join(own, ["start", "u", "v"], "left_semi").select("candidate", "start", F.explode(F.array(F.struct("leg_ord", "a", F.lit(None).cast(kind).alias("b")), F.struct((F.col("leg_ord") + 1).alias("leg_ord"), F.lit(None).cast(kind).alias("a"), "b"))).alias("s")).select("candidate", "start", "s.*")
    inner = inner.join(own, ["start", "u", "v"], "left_anti").join(edges, ["u", "v"])
    ends = halves(root).select("start", F.col("node").alias("u"), "meters", "safety", "hazard", "past", "access", "access_cost")
    outer = steps.where("a is null or b is null").withColumn("_end", F.lit(1.0)).unionByName(past.withColumn("_end", F.lit(0.0)))
    outer = outer.withColumns({"u": F.coalesce("a", "b"), "v": F.lit(None).cast(kind)}).join(ends, ["start", "u"])
    outer = outer.withColumns({"meters": F.col("meters") + F.col("access") * F.col("_end"), "safety": F.col("safety") + F.col("access_cost") * F.col("_end")})
    kept = ["candidate", "start", "leg_ord", "a", "b", "u", "v", "meters", "safety", "hazard", "past"]
    legs = materialise(inner.select(*kept).unionByName(outer.select(*kept)), "candidate-legs")
    named = legs.withColumns({"a_id": F.coalesce(F.col("a").cast("string"), F.lit("")), "b_id": F.coalesce(F.col("b").cast("string"), F.lit(""))})
    shaped = sequence.traversal_shape(named, "candidate")
    sums = shaped.groupBy("candidate").agg(F.sum("meters").alias("meters"), F.sum("safety").alias("safety"), F.max(F.col("hazard") > 0).alias("hazard"), F.sum(F.when(F.col("repeats"), 0.0).otherwise(F.col("past"))).alias("history"), F.sum(F.col("u_turn").cast("int")).alias("turns"))
    overlap = network.self_overlap(sequence.without_stems(legs.select("candidate", "leg_ord", "u", "v", "meters"), "candidate"), "candidate")
    spots = legs.join(root.select("start", "lat", "lon", "target", "p_lat", "p_lon"), "start").join(places.select(F.col("node").alias("b"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")), "b", "left")
    far = geo.haversine("lat", "lon", F.coalesce("n_lat", "p_lat"), F.coalesce("n_lon", "p_lon"))
    shape = sequence.excursions(spots.select("candidate", "leg_ord", "target", far.alias("d")), "d", F.col("target"), "candidate", "leg_ord")
    rows = tried.join(root.select("start", "request", "entry", "target", (F.col("access") * 2).alias("access")), "start").join(sums, "candidate").join(overlap, "candidate", "left").join(shape, "candidate")
    rows = rows.withColumns({"overlap": F.coalesce("self_overlap", F.lit(0.0)), "error": F.abs(F.col("meters") - F.col("target"))})
    penalty = rules.shape_penalty("reach", "excursions", "turns", "target")
    rows = rows.withColumns({"circuit": F.coalesce(F.col("overlap") / F.when(F.col("meters") > 0, F.col("meters")) < CIRCUIT, F.lit(False)), "within": F.col("error") <= geo.loop_tolerance("target"), "score": rules.candidate_score("error", "safety", "history", "meters", "overlap", penalty)})
    return materialise(rows.select("request", "entry", "target", "meters", "access", "overlap", "history", "error", "circuit", "within", "hazard", "score", "route", "nodes"), "scored")


def best_loops(rows: DataFrame) -> DataFrame:
    """Of each request the loop to ride, with ``status``: no hazard first, then a circuit within
    the tolerance, then any route within it, then the least score."""
    order = [F.col("hazard"), ~(F.col("circuit") & F.col("within")), ~F.col("within"), F.round("score", 6), F.col("entry"), F.col("route")]
    return network.first_of(rows, ["request"], order).withColumn("status", F.when(F.col("circuit") & F.col("within"), "Exact").otherwise("Closest"))


def loops(requests: DataFrame, trails: DataFrame, roads: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """The loop of each request (request, lat, lon, target): request, entry, meters, access, overlap,
    history, error, circuit, within, hazard, score, status, nodes (the way, without the start).

    The first two entries are searched for all; entries in other components only for requests
    that these leave without a sound circuit of about the target."""
    asked = requests.select("request", "lat", "lon", "target").dropna().where(F.col("target").between(SHORTEST, LONGEST)).dropDuplicates(["request"])
    asked = materialise(asked, "loop-requests")
    edges = materialise(graph(trails, history), "loop-edges")
    places = materialise(network.node_places(trails), "loop-places")
    parts = materialise(network.components(edges), "loop-parts")
    found = entries(asked.select("request", "lat", "lon"), trails, roads, parts)
    root = materialise(roots(asked, found.where("primary"), trails, edges), "roots")
    rows = scored(candidates(root, edges, places), root, edges, places)
    sound = rows.where("circuit and within and not hazard").select("request").distinct()
    more = materialise(roots(asked, found.where("not primary").join(sound, "request", "left_anti"), trails, edges), "roots")
    if not more.isEmpty():
        rows = rows.unionByName(scored(candidates(more, edges, places), more, edges, places))
    return best_loops(rows).drop("route", "target")
