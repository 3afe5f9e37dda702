"""Queries over records: candidates, carried rides, generations of searches, checks of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.operators import network, records, rules
from fellpath.plans.network_queries import MEASURED, measured_legs
from fellpath.plans.projection import view
from fellpath.plans.registry import query
from fellpath.plans.source_queries import paths
from fellpath.sources import formats


@query("top02_access_candidates", """
, s AS (SELECT rider, ride_id, round((shared_m + access_m * CASE WHEN shared_m > 0.01 THEN 8 ELSE 50 END + greatest(0, access_m - 125) * 400) * CASE WHEN kind = 'Navigation' THEN 0.75::DOUBLE ELSE 1 END, 6) AS score FROM rides)
SELECT rider, ride_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY score, ride_id) AS n FROM s) WHERE n <= 8""")
def access_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight cheapest accesses of each rider, each once."""
    roles = F.when(F.col("kind") == "Navigation", F.array(F.lit("SharedRoadways"))).otherwise(F.array().cast("array<string>"))
    scored = view(spark, sf_dir, "rides").select("rider", "ride_id", F.round(rules.access_score("shared_m", "access_m", roles), 6).alias("score"))
    best = network.top_of(scored.distinct(), ["rider"], ["score", "ride_id"], 8)
    return best.select("rider", "ride_id", F.round("score", 3).alias("score"))


@query("str11_carried_ride", MEASURED + """
, at AS (SELECT feature_ord, leg_ord, meters, coalesce(sum(meters) OVER (PARTITION BY feature_ord ORDER BY leg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM measured)
SELECT ride, count(*) AS n_legs, round(sum(m), 3) AS meters FROM (
  SELECT feature_ord // 2 AS ride, least(meters, 300 - s) AS m FROM at WHERE feature_ord % 2 = 0 AND 300 - s > 1e-6 UNION ALL SELECT feature_ord // 2, meters FROM at WHERE feature_ord % 2 = 1) GROUP BY ride""".replace(", at AS", ", placed AS").replace("FROM at ", "FROM placed "))
def carried_ride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 m of every even feature carried into the odd one after it."""
    legs = measured_legs(spark, sf_dir)
    out = records.carried(legs.where("feature_ord % 2 = 0"), F.lit(300.0), legs.where("feature_ord % 2 = 1"))
    return out.groupBy(F.floor(F.col("feature_ord") / 2).alias("ride")).agg(F.count("*").alias("n_legs"), F.round(F.sum("meters"), 3).alias("meters"))


@query("str09_generations", "SELECT ride_id, CASE WHEN n > 1 THEN 'superseded' WHEN access_m > 100 THEN 'stale' ELSE 'adopted' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY used_ms DESC, ride_id DESC) AS n FROM rides)")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as searches: only a rider's newest is adopted, unless the rider has drifted 100 m since."""
    return records.adopted(view(spark, sf_dir, "rides"), "rider", [F.desc("used_ms"), F.desc("ride_id")], F.col("access_m")).select("ride_id", "outcome")


@query("cdc18_record_rules", """SELECT ride_id, unnest(list_filter([CASE WHEN meters > 30000 THEN 'meters' END, CASE WHEN shared_m + access_m > 500 THEN 'access' END, CASE WHEN length(title) > 6 AND kind = 'Navigation' THEN 'title' END], lambda x: x IS NOT NULL)) AS field FROM rides""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of rides that break their rule."""
    checks = {"meters": F.col("meters") <= 30_000, "access": F.col("shared_m") + F.col("access_m") <= 500, "title": (F.length("title") <= 6) | (F.col("kind") != "Navigation")}
    return records.violations(view(spark, sf_dir, "rides"), "ride_id", checks)


@query("cdc17_geometry_agreement", "SELECT feature_ord, count(*) AS n, feature_ord % 10 <> 0 AS agrees FROM points GROUP BY feature_ord")
def geometry_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features against what their encoded geometry decodes to; every tenth is moved."""
    held = paths(spark, sf_dir)
    moved = F.when(F.col("feature_ord") % 10 == 0, 0.001).otherwise(0.0)
    coded = held.select("feature_ord", formats.decode_path(formats.encode_path(F.transform("points.lat", lambda x: x + moved), F.col("points.lon"))).alias("d"))
    other = coded.select("feature_ord", F.transform(F.arrays_zip("d.lats", "d.lons"), lambda p: F.struct(p["lats"].alias("lat"), p["lons"].alias("lon"))).alias("points"))
    return records.geometry_agreement(held, other, "feature_ord", 1e-7).select("feature_ord", "n", "agrees")


@query("cdc08_dataset_checks", "SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (name IS NULL) AS unnamed, count(*) FILTER (price < 0) AS negative FROM parts_after")
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by which a data set is accepted."""
    return view(spark, sf_dir, "parts_after").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.count_if(F.col("price") < 0).alias("negative"))


@query("api14_error_envelope", "SELECT ride_id, meters <= 40000 AS ok, CASE WHEN meters > 40000 THEN left('Too long: ' || repeat(title, 100), 400) END AS message FROM rides")
def error_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with whether they are answered, and a message of 400 characters at most where not."""
    error = F.when(F.col("meters") > 40_000, F.concat(F.lit("Too long: "), F.repeat("title", 100)))
    return records.enveloped(view(spark, sf_dir, "rides"), error).select("ride_id", "ok", "message")


@query("grf06_component_candidates", "SELECT rider, kind, ride_id FROM (SELECT *, row_number() OVER (PARTITION BY rider, kind ORDER BY meters, ride_id) AS n FROM rides WHERE title <> 'Ride 1') WHERE n = 1")
def component_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest candidate of each component that is not searched yet (kinds stand for components)."""
    left = view(spark, sf_dir, "rides").where("title <> 'Ride 1'")
    return network.first_of(left, ["rider", "kind"], ["meters", "ride_id"]).select("rider", "kind", "ride_id")
