"""Queries over formats: what is written and read back, and what a source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.plans.projection import view
from fellpath.plans.registry import query
from fellpath.plans.staging import fresh_path
from fellpath.sources import formats, tiles


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_ord, points): the vertices of every feature in order."""
    points = view(spark, sf_dir, "points").groupBy("feature_ord").agg(F.array_sort(F.collect_list(F.struct("vertex_ord", "lat", "lon"))).alias("p"))
    return points.select("feature_ord", F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per feature, as a source sends it: roles as a list or one text."""
    features = view(spark, sf_dir, "features").join(paths(spark, sf_dir), "feature_ord", "left")
    roles = F.when(F.col("feature_ord") % 2 == 0, F.to_json(F.array("role", F.lit("ProposedTrails")))).otherwise(F.to_json(F.struct(F.col("role").alias("r"))))
    coordinates = F.to_json(F.array(F.transform("points", lambda p: F.array(p["lon"], p["lat"]))))
    role = F.when(F.col("feature_ord") % 2 == 0, roles).otherwise(F.concat(F.lit('"'), "role", F.lit('"')))
    body = F.concat(F.lit('﻿{"layers":[{"id":"'), F.when(F.col("feature_ord") % 5 == 0, "osm-service").otherwise("trails"), F.lit('","features":[{"id":"'), "feature_id", F.lit('","name":"'), F.coalesce("name", F.lit("  ")), F.lit('","status":"'), "status", F.lit('","routeRoles":'), role, F.lit(',"facilityType":"Bike Lane","comfortLevel":"?","mtfcc":"S1400","ord":'), F.col("feature_ord").cast("string"), F.lit(',"paths":'), F.coalesce(coordinates, F.lit("[]")), F.lit("}]}]}"))
    return features.select(body.alias("value"))


COUNTS = ", n AS (SELECT feature_ord, count(*) AS n FROM points GROUP BY feature_ord HAVING count(*) >= 2)"


@query("src01_trail_json", COUNTS + """SELECT feature_id AS id, name, status, CASE WHEN f.feature_ord % 2 = 0 THEN array_to_string(list_sort([role, 'ProposedTrails']), ',') ELSE role END AS roles, 'BikeLane' AS facility, 'Unknown' AS comfort, CAST(n AS BIGINT) AS n_points
FROM features f JOIN n ON n.feature_ord = f.feature_ord""")
def trail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features read from their JSON."""
    rows = formats.trail_features(documents(spark, sf_dir))
    return rows.select("id", "name", "status", F.array_join("roles", ",").alias("roles"), "facility", "comfort", F.size(F.col("paths")[0]).cast("long").alias("n_points"))


@query("src02_road_json", COUNTS + "SELECT feature_id AS id, 'S1400' AS road_class, f.feature_ord % 5 = 0 AS is_local, f.feature_ord AS ord FROM features f JOIN n ON n.feature_ord = f.feature_ord")
def road_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.road_features(documents(spark, sf_dir)).select("id", "road_class", "is_local", "ord")


@query("src10_notices")
def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a notice: its title, the digest of its text, whether it passes for one.

    No SQL: HTML is parsed; tests hold it against hand-made pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return formats.notices(pages, "html", ["the", "de"]).select("page_id", "title", "sha", "verified")


@query("src14_tile_window", """
, box AS (SELECT feature_ord, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM points GROUP BY feature_ord),
asked AS (SELECT DISTINCT CAST(floor(lat * 100) AS BIGINT) AS r, CAST(floor(lon * 100) AS BIGINT) AS c FROM query_points WHERE point_id % 100 = 0)
SELECT DISTINCT feature_ord FROM box, asked WHERE floor(north * 100) >= r - 1 AND floor(south * 100) <= r + 1 AND floor(east * 100) >= c - 1 AND floor(west * 100) <= c + 1""")
def tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written in tiles and read back around every hundredth query point."""
    box = view(spark, sf_dir, "points").groupBy("feature_ord").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    path = fresh_path(spark, "tiles")
    tiles.write(box, "feature_ord", path)
    return tiles.window(spark, path, view(spark, sf_dir, "query_points").where("point_id % 100 = 0"), "feature_ord", schema=box.schema).select("feature_ord")


@query("cdc09_tile_audit", "SELECT feature_ord, 'repeated' AS fault FROM features WHERE feature_ord % 40 = 0 AND feature_ord IN (SELECT feature_ord FROM points) UNION ALL SELECT feature_ord, 'outside' FROM features WHERE feature_ord % 40 = 1 AND feature_ord IN (SELECT feature_ord FROM points)")
def tile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of tiles in which some features are doubled and some put far off."""
    box = view(spark, sf_dir, "points").groupBy("feature_ord").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    held = tiles.placed(box, "feature_ord")
    bad = held.unionByName(held.where("feature_ord % 40 = 0")).withColumn("tile_row", F.when(F.col("feature_ord") % 40 == 1, F.col("tile_row") + 500).otherwise(F.col("tile_row")))
    return tiles.audit(bad, "feature_ord").select("feature_ord", "fault").distinct()


@query("src18_geojson", "SELECT feature_ord, count(*) AS n_points, 'LineString' AS type, round(sum(lat), 4) AS lats, round(sum(lon * vertex_ord), 4) AS lons FROM points GROUP BY feature_ord HAVING count(*) >= 2")
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as GeoJSON, and what a reader finds in it."""
    told = formats.geojson(paths(spark, sf_dir).withColumns({"type": F.lit("Trail"), "routed": F.lit(True), "place": F.lit(0)}), "feature_ord", "place")
    back = F.from_json("geojson", "features array<struct<geometry:struct<type:string, coordinates:array<array<double>>>>>")["features"][0]["geometry"]
    found = told.select("feature_ord", back.alias("g")).select("feature_ord", F.size("g.coordinates").cast("long").alias("n_points"), "g.type", F.posexplode("g.coordinates").alias("k", "xy"))
    return found.groupBy("feature_ord", "n_points", "type").agg(F.round(F.sum(F.col("xy")[1]), 4).alias("lats"), F.round(F.sum(F.col("xy")[0] * (F.col("k") + 1)), 4).alias("lons"))


@query("src19_polyline", "SELECT feature_ord, count(*) AS n, round(sum(lat), 5) AS lats, round(sum(lon), 5) AS lons FROM points GROUP BY feature_ord")
def polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as encoded polylines and back."""
    coded = paths(spark, sf_dir).select("feature_ord", formats.decode_path(formats.encode_path("points.lat", "points.lon")).alias("d"))

    def total(name: str) -> F.Column:
        return F.round(F.aggregate(F.col(f"d.{name}"), F.lit(0.0), lambda a, x: a + x), 5)

    return coded.select("feature_ord", F.size("d.lats").cast("long").alias("n"), total("lats").alias("lats"), total("lons").alias("lons"))


@query("src20_route_geometry", COUNTS + """, s AS (SELECT p.feature_ord, sum(lat) AS lats, sum(lon * vertex_ord) AS lons, min(lat) AS south, max(lon) AS east FROM points p GROUP BY p.feature_ord)
SELECT rider, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_paths, CAST(count(*) FILTER (f.feature_ord % 3 = 0) AS BIGINT) AS unmapped, round(sum(lats), 4) AS lats, round(sum(lons), 4) AS lons, round(min(south) - 0.0000001::DOUBLE, 8) AS south, round(max(east) + 0.0000001::DOUBLE, 8) AS east
FROM features f JOIN n ON n.feature_ord = f.feature_ord JOIN s ON s.feature_ord = f.feature_ord GROUP BY rider""")
def route_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rider's features as one geometry text, and the paths and places a reader finds in it."""
    rows = paths(spark, sf_dir).join(view(spark, sf_dir, "features").select("feature_ord", "rider"), "feature_ord").withColumns({"type": F.lit("Trail"), "routed": F.col("feature_ord") % 3 != 0})
    told = formats.route_geometry(rows, "rider", "feature_ord")
    parts = told.select("*", F.explode(F.split("geometry", ";")).alias("part"))
    read = parts.withColumn("d", formats.decode_path(F.substring("part", 3, 1_000_000_000)))

    def total(value: F.Column) -> F.Column:
        return F.round(F.sum(F.aggregate(value, F.lit(0.0), lambda a, x: a + x)), 4)

    weighed = F.transform("d.lons", lambda x, i: x * (i + 1))
    out = read.groupBy("rider", "n_points", "south", "east").agg(F.count("*").alias("n_paths"), F.count_if(F.col("part").startswith("t:")).alias("unmapped"), total(F.col("d.lats")).alias("lats"), total(weighed).alias("lons"))
    return out.select("rider", "n_points", "n_paths", "unmapped", "lats", "lons", F.round("south", 8).alias("south"), F.round("east", 8).alias("east"))


@query("src21_payload", "SELECT ride_id, kind || ':' || title AS body FROM rides")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides packed as gzip and back."""
    packed = view(spark, sf_dir, "rides").select("ride_id", formats.pack_payload(F.concat("kind", F.lit(":"), "title")).alias("b"))
    return packed.select("ride_id", formats.unpack_payload()("b").alias("body"))


@query("src22_persistence", "SELECT ride_id, CASE WHEN ride_id % 5 = 0 THEN NULL ELSE title END AS title, CASE WHEN ride_id % 5 = 0 THEN NULL WHEN ride_id % 5 = 1 THEN 'Navigation' ELSE kind END AS kind FROM rides")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as JSON and back: broken records are null, and a missing kind has its default."""
    n = F.col("ride_id") % 5
    body = F.when(n == 0, "{broken").when(n == 1, F.to_json(F.struct("title"))).otherwise(F.to_json(F.struct("title", "kind")))
    back = F.from_json(body, "title string, kind string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = view(spark, sf_dir, "rides").select("ride_id", back.alias("r"))
    good = F.col("r._corrupt_record").isNull()
    return rows.select("ride_id", F.when(good, F.col("r.title")).alias("title"), F.when(good, F.coalesce("r.kind", F.lit("Navigation"))).alias("kind"))
