"""What a route rides of closed sections, and whether that blocks it.

A section is the line between two bounds on a feature. A leg of a route is on it
when it belongs to that feature, both its ends lie within ``ACROSS`` metres of the
line and it runs along it; what counts is the overlap summed over a maximal run
of such legs, so that vertices in between change nothing, and crossing a
section, or touching a bound, is no ride.

Defined results: sections without length and legs without position ride
nothing; repeated sections count once; a section nobody rides has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import geo

#: Metres beside the line, least cosine between leg and line, metres that are more than noise, metres between legs that meet.
ACROSS, COSINE, NOISE, JOINED = 0.5, 0.9, 0.01, 1.0
BOUNDS = ["from_lat", "from_lon", "to_lat", "to_lon"]


def ridden_sections(legs: DataFrame, sections: DataFrame, route: str = "route", order: str = "leg_ord") -> DataFrame:
    """(route, closure_id, meters): the longest run of each section (closure_id, feature_ord and
    bounds) that each route rides; ``legs``: route, order, feature_ord and both ends."""
    lines = sections.select("closure_id", "feature_ord", *BOUNDS).where("from_lat <> to_lat or from_lon <> to_lon").dropDuplicates(["closure_id", "feature_ord"])
    rows = legs.select(route, order, "feature_ord", "a_lat", "a_lon", "b_lat", "b_lon").join(lines, "feature_ord")
    rows = rows.withColumns({f"_{e}": geo.source_frame(f"{e}_lat", f"{e}_lon", *BOUNDS) for e in "ab"} | {"_to": geo.source_frame("to_lat", "to_lon", *BOUNDS)["along"]})
    ahead, aside = F.col("_b.along") - F.col("_a.along"), F.col("_b.side") - F.col("_a.side")
    length = F.sqrt(ahead * ahead + aside * aside)
    # A repeated vertex has no direction: it neither continues nor breaks a run.
    rows = rows.where(length > 0)
    on = F.coalesce((F.col("_a.across") <= ACROSS) & (F.col("_b.across") <= ACROSS) & (F.abs(ahead) >= COSINE * length), F.lit(False))
    low, high = F.least("_a.along", "_b.along"), F.greatest("_a.along", "_b.along")
    shared = F.greatest(F.lit(0.0), F.least(high, F.col("_to")) - F.greatest(low, F.lit(0.0)))
    w = Window.partitionBy(route, "closure_id").orderBy(order)
    apart = geo.haversine(F.lag("b_lat").over(w), F.lag("b_lon").over(w), "a_lat", "a_lon") > JOINED
    rows = rows.withColumns({"_on": on, "_shared": shared}).withColumn("_new", (~F.col("_on") | F.coalesce(~F.lag("_on").over(w), F.lit(True)) | F.coalesce(apart, F.lit(True))).cast("int"))
    runs = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on").groupBy(route, "closure_id", "_run").agg(F.sum("_shared").alias("meters"))
    return runs.where(F.col("meters") > NOISE).groupBy(route, "closure_id").agg(F.max("meters").alias("meters"))


def gate(routes: DataFrame, legs: DataFrame, closures: DataFrame, now_ms: int, route: str = "route", order: str = "leg_ord") -> DataFrame:
    """``routes`` with ``blocked_by``: the closures in force that each rides, in order; empty where it may start."""
    held = ridden_sections(legs, closures.where((F.col("active_ms") <= now_ms) & ~F.col("crossing")), route, order)
    named = held.groupBy(route).agg(F.array_sort(F.collect_set("closure_id")).alias("blocked_by"))
    return routes.join(named, route, "left").withColumn("blocked_by", F.coalesce("blocked_by", F.array().cast(named.schema["blocked_by"].dataType)))
