"""Queries over snapshots, manifests, addresses and typed searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellpath.functions import text
from fellpath.operators import address, changes, network, records
from fellpath.plans.network_queries import EDGES, edges
from fellpath.plans.projection import view
from fellpath.plans.registry import query, sql_haversine
from fellpath.plans.text_queries import NOW_MS, SQL_TOKENS

DAY = 86_400_000


def digests(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = view(spark, sf_dir, name)
    return parts.withColumn("sha", changes.record_digest({"id": F.col("id"), "name": F.col("name"), "cents": text.half_up(F.col("price") * 100)}))


SHA = "sha256('{\"cents\":' || CAST(floor(price * 100 + 0.5) AS BIGINT) || ',\"id\":' || id || ',\"name\":\"' || name || '\"}')"
DIFF = f", b AS (SELECT *, {SHA} AS sha FROM parts_before), a AS (SELECT *, {SHA} AS sha FROM parts_after)"


@query("set03_snapshot_diff", "SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM parts_before b FULL JOIN parts_after a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.price <> b.price")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_diff(view(spark, sf_dir, "parts_before"), view(spark, sf_dir, "parts_after"), "id", "price")


@query("set04_package_changes", DIFF + "SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.id = b.id WHERE b.sha IS DISTINCT FROM a.sha")
def package_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same told by digests."""
    return changes.snapshot_diff(digests(spark, sf_dir, "parts_before"), digests(spark, sf_dir, "parts_after"), "id", "sha")


@query("set05_extract_comparison", """SELECT id, change FROM (SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN b.price <> a.price AND a.id % 4 = 0 THEN 'both' WHEN b.price <> a.price THEN 'geometry' WHEN a.id % 4 = 0 THEN 'attributes' END AS change
  FROM parts_before b FULL JOIN parts_after a ON a.id = b.id) WHERE change IS NOT NULL""")
def extract_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices stand for geometry; every fourth name is written anew."""
    after = view(spark, sf_dir, "parts_after").withColumn("name", F.when(F.col("id") % 4 == 0, F.upper("name")).otherwise(F.col("name")))
    return changes.extract_comparison(view(spark, sf_dir, "parts_before"), after, "id", ["price"], ["name"])


@query("set06_subset", "SELECT id FROM parts_after EXCEPT SELECT id FROM parts_before")
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.subset_violations(view(spark, sf_dir, "parts_after"), view(spark, sf_dir, "parts_before"), "id")


@query("set01_union_distinct", "SELECT rider, min(ride_id) AS ride_id, title FROM rides WHERE ride_id % 2 = 0 OR meters > 20000 GROUP BY rider, title")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of candidates as one, each rider's title once."""
    rides = view(spark, sf_dir, "rides").select("rider", "title", "ride_id", "meters")
    both = rides.where("ride_id % 2 = 0").unionByName(rides.where("meters > 20000"))
    return network.first_of(both, ["rider", "title"], ["ride_id"]).select("rider", "ride_id", "title")


@query("set02_union_layers", "SELECT 'base' AS layer, id, price, NULL::VARCHAR AS name FROM parts_before UNION ALL SELECT 'proposed', id, NULL, name FROM parts_after WHERE id % 3 = 0")
def union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with different columns, one after the other."""
    base = view(spark, sf_dir, "parts_before").select(F.lit("base").alias("layer"), "id", "price")
    return base.unionByName(view(spark, sf_dir, "parts_after").where("id % 3 = 0").select(F.lit("proposed").alias("layer"), "id", "name"), allowMissingColumns=True)


@query("set07_role_sets", "SELECT feature_ord, CASE WHEN role = 'ParkConnectors' THEN 'ParkConnectors,ProposedTrails' WHEN role = 'SharedRoadways' THEN 'ProposedTrails,SharedRoadways' ELSE 'ProposedTrails,TrailBranches' END AS roles, role = 'ParkConnectors' AS connects FROM features WHERE status = 'Proposed'")
def role_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of proposed features joined with the proposed role."""
    roles = F.array_union(F.array("role"), F.array(F.lit("ProposedTrails")))
    return view(spark, sf_dir, "features").where("status = 'Proposed'").select("feature_ord", F.array_join(F.array_sort(roles), ",").alias("roles"), F.array_contains(roles, "ParkConnectors").alias("connects"))


@query("jon11_admission", """SELECT id, CASE WHEN id % 50 = 3 THEN 'duplicate' WHEN NOT listed THEN 'unexpected' WHEN NOT found THEN 'missing' WHEN id % 10 = 2 THEN 'changed' ELSE 'admitted' END AS status
  FROM (SELECT coalesce(b.id, a.id) AS id, b.id IS NOT NULL AS listed, a.id IS NOT NULL AS found FROM parts_before b FULL JOIN parts_after a ON a.id = b.id)""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot as manifest of the second, in which some ids repeat."""
    found = digests(spark, sf_dir, "parts_after")
    return changes.admission(digests(spark, sf_dir, "parts_before"), found.unionByName(found.where("id % 50 = 3")), "id", "sha")


@query("jon13_coded_domain", "SELECT feature_ord, CASE facility WHEN 'BikeLane' THEN 'Bike lane' WHEN 'UrbanTrail' THEN 'Urban trail' WHEN 'Other' THEN 'Other' END AS label, facility IN ('BikeLane', 'UrbanTrail', 'Other') AS known FROM features")
def coded_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = spark.createDataFrame([("BikeLane", "Bike lane"), ("UrbanTrail", "Urban trail"), ("Other", "Other")], "code string, label string")
    return changes.coded(view(spark, sf_dir, "features"), "facility", F.broadcast(domain)).select("feature_ord", "label", "known")


@query("jon16_revalidation", """SELECT rider, feature_ord, issue FROM (SELECT rider, feature_ord, unnest(CASE WHEN feature_ord % 9 = 0 THEN ['removed'] ELSE list_filter([CASE WHEN feature_ord % 4 = 0 THEN 'status' END, CASE WHEN feature_ord % 6 = 1 THEN 'geometry' END], lambda x: x IS NOT NULL) END) AS issue FROM features)""")
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of saved routes (one per rider) against a network in which some are gone, closed or redrawn."""
    saved = view(spark, sf_dir, "features").select("rider", "feature_ord", "status", F.col("feature_id").alias("shape"))
    now = saved.where("feature_ord % 9 <> 0").select("feature_ord", F.when(F.col("feature_ord") % 4 == 0, "Closed").otherwise(F.col("status")).alias("status"), F.when(F.col("feature_ord") % 6 == 1, "new").otherwise(F.col("shape")).alias("shape"))
    return changes.revalidation(saved, now, "rider", "feature_ord")


@query("jon18_recent_anti_saved", f"""
, keys AS (SELECT feature_ord, list_sort([string_agg(node_id::VARCHAR, ';' ORDER BY vertex_ord), string_agg(node_id::VARCHAR, ';' ORDER BY vertex_ord DESC)])[1] AS key FROM points GROUP BY feature_ord)
SELECT k.feature_ord FROM keys k WHERE feature_ord % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM keys s WHERE s.feature_ord % 10 = 0 AND s.key = k.key)""")
def recent_anti_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose path, in either direction, is not that of a saved one (every tenth)."""
    keys = network.path_keys(view(spark, sf_dir, "points"))
    return keys.where("feature_ord % 10 <> 0").join(keys.where("feature_ord % 10 = 0").select("key"), "key", "left_anti").select("feature_ord")


@query("rte26_same_ride", """
, keys AS (SELECT feature_ord, list_sort([string_agg(node_id::VARCHAR, ';' ORDER BY vertex_ord), string_agg(node_id::VARCHAR, ';' ORDER BY vertex_ord DESC)])[1] AS key FROM points GROUP BY feature_ord)
SELECT feature_ord, min(feature_ord) OVER (PARTITION BY key) AS same_as FROM keys""")
def same_ride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feature with the same path in either direction."""
    keys = network.path_keys(view(spark, sf_dir, "points"))
    first = keys.groupBy("key").agg(F.min("feature_ord").alias("same_as"))
    return keys.join(first, "key").select("feature_ord", "same_as")


@query("jon21_zip", "SELECT a.rider, a.ride_id, b.ride_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY meters, ride_id) AS n FROM rides) a JOIN (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY target_m, ride_id) AS n FROM rides) b ON b.rider = a.rider AND b.n = a.n")
def zip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rider's rides by length beside the same by target, place by place."""
    rides = view(spark, sf_dir, "rides")
    ranked = {c: rides.select("rider", F.row_number().over(Window.partitionBy("rider").orderBy(c, "ride_id")).alias("n"), "ride_id") for c in ("meters", "target_m")}
    return ranked["meters"].join(ranked["target_m"].withColumnRenamed("ride_id", "other"), ["rider", "n"]).select("rider", "ride_id", "other")


@query("jon20_candidate_product", """
, a AS (SELECT * FROM (SELECT rider, ride_id AS s, meters AS s_m, row_number() OVER (PARTITION BY rider ORDER BY meters, ride_id) AS n FROM rides WHERE kind = 'Navigation') WHERE n <= 8),
b AS (SELECT * FROM (SELECT rider, ride_id AS g, access_m AS g_m, target_m AS g_t, row_number() OVER (PARTITION BY rider ORDER BY access_m, ride_id) AS n FROM rides WHERE kind = 'ExerciseLoop') WHERE n <= 8)
SELECT rider, s, g, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY round(score, 6), s, g) AS k FROM (SELECT a.rider, s, g, abs(s_m * 2 - g_t) + g_m * 8 AS score FROM a JOIN b ON b.rider = a.rider)) WHERE k = 1""")
def candidate_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of each rider's eight first starts and destinations, under a score of both together."""
    rides = view(spark, sf_dir, "rides")
    starts = rides.where("kind = 'Navigation'").select("rider", F.col("ride_id").alias("s"), F.col("meters").alias("s_m"))
    goals = rides.where("kind = 'ExerciseLoop'").select("rider", F.col("ride_id").alias("g"), F.col("access_m").alias("g_m"), F.col("target_m").alias("g_t"))
    score = F.abs(F.col("s_m") * 2 - F.col("g_t")) + F.col("g_m") * 8
    best = records.best_pairs(starts, goals, "rider", score, [F.col("s"), F.col("g")], start_order=["s_m", "s"], goal_order=["g_m", "g"])
    return best.select("rider", "s", "g", F.round("score", 3).alias("score"))


@query("jon24_interval_overlap", """SELECT a.rider, count(*) AS n, round(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)), 3) AS shared FROM (SELECT rider, ride_id, access_m AS lo, access_m + shared_m AS hi FROM rides) a
  JOIN (SELECT rider, ride_id, meters / 100 AS lo, meters / 100 + 90 AS hi FROM rides) b ON b.rider = a.rider AND a.lo < b.hi AND b.lo < a.hi AND a.hi > a.lo GROUP BY a.rider""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far stretches of one rider's rides overlap others of the same rider."""
    rides = view(spark, sf_dir, "rides")
    a = rides.select("rider", F.col("access_m").alias("lo"), (F.col("access_m") + F.col("shared_m")).alias("hi"))
    b = rides.select("rider", (F.col("meters") / 100).alias("lo"), (F.col("meters") / 100 + 90).alias("hi"))
    out = network.interval_overlaps(a, b, "rider", 180.0)
    return out.groupBy("rider").agg(F.count("*").alias("n"), F.round(F.sum("overlap"), 3).alias("shared"))


@query("cdc01_identity", DIFF + "SELECT id, sha FROM b")
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, sf_dir, "parts_before").select("id", "sha")


@query("cdc03_change_kind", """SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'initial' WHEN a.price = b.price AND a.id % 5 > 1 THEN 'no-change' WHEN a.price <> b.price THEN 'records' WHEN a.id % 5 = 0 THEN 'contract' ELSE 'provenance-only' END AS kind FROM parts_after a LEFT JOIN parts_before b ON b.id = a.id""")
def change_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of change each record of the second snapshot is."""
    before = view(spark, sf_dir, "parts_before").select("id", F.col("price").alias("was"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("parent"))
    both = view(spark, sf_dir, "parts_after").join(before, "id", "left")
    differs = F.coalesce(F.col("price") != F.col("was"), F.lit(False))
    named = both.withColumn("candidate", F.when(differs | (F.col("id") % 5 <= 1), F.concat(F.lit("c"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))))
    return named.select("id", changes.change_kind("candidate", "parent", differs, F.col("id") % 5 == 0).alias("kind"))


@query("cdc04_journal", """
, w AS (SELECT rider, ride_id, title, lag(title) OVER (PARTITION BY rider ORDER BY ride_id) AS parent FROM rides)
SELECT rider, ride_id, parent, sha256('{"candidate":"' || title || '","parent":' || coalesce('"' || parent || '"', 'null') || ',"source":"' || rider || '"}') AS link FROM w""")
def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as a chained journal of each rider."""
    return changes.journal(view(spark, sf_dir, "rides").select("rider", "ride_id", "title"), "rider", "ride_id", "title").select("rider", "ride_id", "parent", "link")


@query("cdc05_quota", "SELECT rider, ride_id FROM (SELECT *, count(*) OVER w AS n, sum(CAST(meters AS BIGINT)) OVER w AS b FROM rides WINDOW w AS (PARTITION BY rider ORDER BY used_ms DESC, ride_id ROWS UNBOUNDED PRECEDING)) WHERE n <= 4 AND b <= 90000".replace("CAST(meters AS BIGINT)", "CAST(floor(meters) AS BIGINT)"))
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rides of each rider within four rows and 90 km."""
    rides = view(spark, sf_dir, "rides").withColumn("size", F.floor("meters"))
    return changes.within_quota(rides, "rider", [F.desc("used_ms"), F.asc("ride_id")], "size", 4, 90_000).select("rider", "ride_id")


@query("cdc06_unsafe_closures", "SELECT id AS closure_id FROM (SELECT b.id, a.id IS NULL OR a.price <> b.price AS differs FROM parts_before b LEFT JOIN parts_after a ON a.id = b.id) WHERE differs AND id % 3 <> 0")
def unsafe_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as closures: those that changed or went; every third has a review."""
    before = view(spark, sf_dir, "parts_before").select(F.col("id").alias("closure_id"), F.col("price").cast("string").alias("sha"), F.lit(10).cast("long").alias("released_ms"))
    after = view(spark, sf_dir, "parts_after").select(F.col("id").alias("closure_id"), F.col("price").cast("string").alias("sha"), F.lit(20).cast("long").alias("released_ms"))
    reviews = before.join(after.select("closure_id", F.col("sha").alias("to_sha")), "closure_id", "left").where("closure_id % 3 = 0").select("closure_id", F.col("sha").alias("from_sha"), "to_sha", F.lit(15).cast("long").alias("reviewed_ms"))
    return changes.unsafe_closures(before, after, reviews)


@query("cdc11_add_or_conflict", "SELECT a.id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.price = b.price THEN 'same' ELSE 'conflict' END AS outcome FROM parts_after a LEFT JOIN parts_before b ON b.id = a.id")
def add_or_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.add_or_conflict(digests(spark, sf_dir, "parts_before"), digests(spark, sf_dir, "parts_after"), "id", "sha")


@query("cdc12_equivalence", "SELECT side, count(*) AS n FROM (SELECT *, 'left' AS side FROM (SELECT id, price FROM parts_before EXCEPT ALL SELECT id, price FROM parts_after) UNION ALL SELECT *, 'right' FROM (SELECT id, price FROM parts_after EXCEPT ALL SELECT id, price FROM parts_before)) GROUP BY side")
def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two results that the other lacks."""
    a, b = (view(spark, sf_dir, n).select("id", "price") for n in ("parts_before", "parts_after"))
    return changes.multiset_difference(a, b).groupBy("side").agg(F.count("*").alias("n"))


@query("cdc16_differing_fields", "SELECT id, unnest(CASE WHEN inn THEN ['price'] ELSE ['name', 'price'] END) AS field FROM (SELECT coalesce(b.id, a.id) AS id, a.id IS NOT NULL AND b.id IS NOT NULL AS inn, a.price, b.price AS was FROM parts_before b FULL JOIN parts_after a ON a.id = b.id) WHERE NOT inn OR price <> was")
def differing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.differing_fields(view(spark, sf_dir, "parts_before"), view(spark, sf_dir, "parts_after"), "id", ["name", "price"])


@query("str13_rate_limit", """
, e AS (SELECT event_id, rider % 7 AS network, fix_ms * 10 AS at_ms FROM fixes),
h AS (SELECT *, row_number() OVER (PARTITION BY network, at_ms // 3600000 ORDER BY at_ms, event_id) AS hr FROM e)
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY at_ms // 86400000 ORDER BY at_ms, event_id) AS dr FROM h WHERE hr <= 5) WHERE dr <= 100""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes as requests of seven networks; every request is sent twice."""
    asked = view(spark, sf_dir, "fixes").select("event_id", (F.col("rider") % 7).alias("network"), (F.col("fix_ms") * 10).alias("at_ms"))
    return changes.admitted_requests(asked.unionByName(asked), "event_id", "network", "at_ms").select("event_id")


@query("str14_retention", f"SELECT ride_id FROM rides WHERE used_ms >= {NOW_MS} - {90 * DAY}")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").where(F.col("used_ms") >= NOW_MS - 90 * DAY).select("ride_id")


@query("src27_upsert", "SELECT id, CASE WHEN in_after AND NOT (in_before AND id % 2 = 0) THEN 'after' ELSE 'before' END AS origin FROM (SELECT coalesce(b.id, a.id) AS id, b.id IS NOT NULL AS in_before, a.id IS NOT NULL AS in_after FROM parts_before b FULL JOIN parts_after a ON a.id = b.id)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the second snapshot put over the first; even ids of the first are newer."""
    held = view(spark, sf_dir, "parts_before").select("id", F.lit("before").alias("origin"), F.when(F.col("id") % 2 == 0, 3).otherwise(1).alias("at"))
    return changes.upsert(held, view(spark, sf_dir, "parts_after").select("id", F.lit("after").alias("origin"), F.lit(2).alias("at")), "id", "at").select("id", "origin")


@query("src28_quarantine", DIFF + "SELECT id FROM a WHERE id % 10 = 2 AND sha NOT IN (SELECT sha FROM a WHERE id % 20 = 2)")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsound records (last digit 2) that are not set aside yet."""
    rows = digests(spark, sf_dir, "parts_after")
    held = rows.where("id % 20 = 2").select(F.col("sha").alias("digest"))
    return changes.quarantine(rows, F.col("id") % 10 != 2, held, F.col("sha"))[1].select("id")


def address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address rows as a source sends them; some lack a point or a number."""
    rows = view(spark, sf_dir, "addresses")
    lat = F.when(F.col("oid") % 23 != 0, F.col("lat"))
    told = F.when(F.col("oid") % 29 == 0, "No number").otherwise(F.col("address"))
    return rows.select("oid", told.alias("address"), F.when(F.col("oid") % 31 == 0, "b").alias("building"), "unit", F.concat(F.lit(" town "), (F.col("city_id") % 4).cast("string")).alias("city"), F.lit("61701-1").alias("zip"), lat.alias("lat"), "lon")


ENTRIES = f"""
, raw AS (SELECT oid, CASE WHEN oid % 29 = 0 THEN 'No number' ELSE address END AS address, CASE WHEN oid % 31 = 0 THEN 'BLDG B' ELSE '' END AS building, coalesce(upper(unit), '') AS u, 'TOWN ' || (city_id % 4) AS city, CASE WHEN oid % 23 <> 0 THEN lat END AS lat, lon FROM addresses),
tok AS (SELECT *, {SQL_TOKENS} AS t FROM raw),
good AS (SELECT oid, array_to_string(t[2:], ' ') AS street, CAST(regexp_extract(t[1], '^([0-9]+)', 1) AS BIGINT) AS num, regexp_extract(t[1], '([A-Z]?)$', 1) AS suffix, trim(building || ' ' || u) AS unit, city,
  CAST(floor(lat * 1000000 + 0.5) AS BIGINT) AS lat, CAST(floor(lon * 1000000 + 0.5) AS BIGINT) AS lon FROM tok WHERE lat IS NOT NULL AND oid % 29 <> 0),
idx AS (SELECT * FROM (SELECT *, coalesce(lag(lat) OVER w = lat AND lag(lon) OVER w = lon, false) AS again FROM good WINDOW w AS (PARTITION BY street, num, suffix, unit, city ORDER BY oid)) WHERE NOT again)"""


@query("adr01_build_index", ENTRIES + "SELECT oid, street, num, suffix, unit, city, lat, lon FROM idx")
def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address.build_index(address_rows(spark, sf_dir)).drop("zip")


@query("agg15_build_report", ENTRIES + """SELECT (SELECT count(*) FROM raw) AS rows, (SELECT count(*) FROM raw WHERE lat IS NULL) AS skipped_point, (SELECT count(*) FROM raw WHERE lat IS NOT NULL AND oid % 29 = 0) AS skipped_number, (SELECT count(*) FROM good) - count(*) AS duplicates,
  count(*) AS indexed, count(DISTINCT street) AS streets, count(DISTINCT city) AS cities, count(*) FILTER (unit <> '') AS with_unit FROM idx""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address.build_report(address_rows(spark, sf_dir)).select("rows", "skipped_point", "skipped_number", "duplicates", "indexed", "streets", "cities", "with_unit")


@query("agg21_unit_labels", ENTRIES + "SELECT street, num, suffix, city, lat, lon, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units FROM idx WHERE unit <> '' GROUP BY ALL")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct units of each place in order."""
    index = address.build_index(address_rows(spark, sf_dir)).where("unit <> ''")
    return index.groupBy("street", "num", "suffix", "city", "lat", "lon").agg(F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"))


@query("top10_address_order", ENTRIES + "SELECT oid, city, CAST(row_number() OVER (PARTITION BY city ORDER BY street, num, suffix, unit, oid) AS INTEGER) AS place FROM idx")
def address_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each entry of a city in the order of the index."""
    index = address.build_index(address_rows(spark, sf_dir))
    return index.select("oid", "city", F.row_number().over(Window.partitionBy("city").orderBy("street", "num", "suffix", "unit", "oid")).alias("place"))


@query("jon06_nearest_address", ENTRIES + f"""
, d AS (SELECT point_id, i.*, sqrt(pow((i.lat - floor(q.lat * 1000000 + 0.5)) / 1000000 * 111194.93::DOUBLE, 2) + pow((i.lon - floor(q.lon * 1000000 + 0.5)) / 1000000 * 111194.93::DOUBLE * cos(radians(q.lat)), 2)) AS d
  FROM query_points q JOIN idx i ON abs(i.lat / 1000000 - q.lat) < 0.002 AND abs(i.lon / 1000000 - q.lon) < 0.002)
SELECT point_id, oid, round(d, 1) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, street, num, suffix, unit, city, oid) AS n FROM d WHERE d <= 75) WHERE n = 1""")
def nearest_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address.nearest_address(view(spark, sf_dir, "query_points"), address.build_index(address_rows(spark, sf_dir)))


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed searches of several kinds, one for every fiftieth address."""
    rows = view(spark, sf_dir, "addresses").where("oid % 50 = 0")
    n, words = F.col("oid") % 300 / 50, F.split("address", " ")
    street = F.array_join(F.slice(words, 2, 9), " ")
    told = F.when(n == 0, F.col("address")).when(n == 1, F.expr("left(address, length(address) - 3)")).when(n == 2, street).when(n == 3, F.concat(F.lit("5 "), street)).when(n == 4, F.lower(F.element_at(words, 2))).otherwise("zzz way")
    return rows.select(F.col("oid").alias("query"), told.alias("text"))


TYPED = ENTRIES + """
, q0 AS (SELECT oid AS query, CASE oid % 300 // 50 WHEN 0 THEN address WHEN 1 THEN left(address, length(address) - 3) WHEN 2 THEN array_to_string(string_split(address, ' ')[2:], ' ') WHEN 3 THEN '5 ' || array_to_string(string_split(address, ' ')[2:], ' ') WHEN 4 THEN lower(string_split(address, ' ')[2]) ELSE 'zzz way' END AS address FROM addresses WHERE oid % 50 = 0),
q1 AS (SELECT query, """ + SQL_TOKENS + """ AS t FROM q0),
q AS (SELECT query, regexp_matches(t[1], '^[0-9]+[A-Z]?$') AS numbered, CASE WHEN regexp_matches(t[1], '^[0-9]+[A-Z]?$') THEN t[2:] ELSE t END AS typed, t FROM q1),
streets AS (SELECT DISTINCT street, string_split(street, ' ') AS name FROM idx),
o AS (SELECT street, name, unnest(CASE WHEN len(name) > 1 AND name[1] IN ('N', 'S', 'E', 'W') THEN [0, 1] ELSE [0] END) AS off FROM streets),
alias(a, w) AS (VALUES ('NORTH', 'N'), ('NORTHEAST', 'NE'), ('NORTHWEST', 'NW'), ('STREET', 'ST'), ('STR', 'ST'), ('AVENUE', 'AVE'), ('AV', 'AVE'), ('SAINT', 'ST')),
m AS (SELECT query, street, min(off) AS off, arg_min(CASE WHEN len(typed) + off = len(name) AND name[off + len(typed)] = typed[-1] THEN 0 ELSE 1000 END + (len(name) - len(typed) - off) * 10 + off, off) AS rank FROM q, o
  WHERE len(typed) > 0 AND len(typed) + off <= len(name) AND (off = 0 OR typed[1] <> name[1]) AND typed[:len(typed) - 1] = name[off + 1:off + len(typed) - 1]
    AND (starts_with(name[off + len(typed)], typed[-1]) OR (length(typed[-1]) >= 2 AND EXISTS (SELECT 1 FROM alias WHERE starts_with(a, typed[-1]) AND w = name[off + len(typed)]))) GROUP BY query, street)"""


@query("adr02_match_streets", TYPED + "SELECT query, street, CAST(rank AS INTEGER) AS rank FROM m")
def match_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = address.build_index(address_rows(spark, sf_dir))
    typed = typed_texts(spark, sf_dir).withColumn("t", text.address_tokens("text"))
    parts = F.when(text.house_number(F.get("t", F.lit(0))).isNull(), F.col("t")).otherwise(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))))
    return address.match_streets(typed.select("query", parts.alias("typed")), index)


@query("top09_street_rank", TYPED + "SELECT query, street, CAST(row_number() OVER (PARTITION BY query ORDER BY rank, street) AS INTEGER) AS place FROM m")
def street_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched streets of each search in order."""
    found = match_streets(spark, sf_dir)
    return found.select("query", "street", F.row_number().over(Window.partitionBy("query").orderBy("rank", "street")).alias("place"))


@query("adr03_search", TYPED + """
, hit AS (SELECT DISTINCT m.query, i.street, i.num, i.suffix, i.city, i.lat, i.lon FROM m JOIN q ON q.query = m.query AND numbered JOIN idx i ON i.street = m.street AND i.num = CAST(regexp_extract(q.t[1], '^([0-9]+)', 1) AS BIGINT) AND i.suffix = regexp_extract(q.t[1], '([A-Z]?)$', 1)),
c AS (SELECT q.query, numbered, (SELECT count(*) FROM hit WHERE hit.query = q.query) AS n_hits, (SELECT count(*) FROM m WHERE m.query = q.query) AS n_streets FROM q)
SELECT query, CASE WHEN n_streets = 0 THEN 'none' WHEN n_hits > 0 THEN 'matches' WHEN NOT numbered OR n_streets > 1 THEN 'streets' ELSE 'nearest-numbers' END AS kind, CASE WHEN n_streets > 0 AND n_hits > 0 THEN n_hits > 1 END AS ambiguous,
  CASE WHEN n_streets = 0 THEN -1 WHEN n_hits > 0 THEN least(n_hits, 8) WHEN NOT numbered OR n_streets > 1 THEN least(n_streets, 8) ELSE 2 END AS n_found FROM c""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each typed text finds: its kind, whether it is ambiguous, how many choices it is told."""
    found = address.search(typed_texts(spark, sf_dir), address.build_index(address_rows(spark, sf_dir)))
    return found.select("query", "kind", "ambiguous", F.coalesce(F.size("found"), F.lit(-1)).cast("long").alias("n_found"))


@query("jon23_nearest_numbers", ENTRIES + """
SELECT a.oid, (SELECT max(b.num) FROM idx b WHERE b.street = a.street AND b.num < a.num) AS lower, (SELECT min(b.num) FROM idx b WHERE b.street = a.street AND b.num > a.num) AS higher FROM idx a""")
def nearest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The house numbers before and after each entry's on its street."""
    index = address.build_index(address_rows(spark, sf_dir))
    numbers = index.select("street", "num").distinct()
    w = Window.partitionBy("street").orderBy("num")
    sides = numbers.select("street", "num", F.lag("num").over(w).alias("lower"), F.lead("num").over(w).alias("higher"))
    return index.join(sides, ["street", "num"]).select("oid", "lower", "higher")


@query("top08_place_search", ENTRIES + """
, q2 AS (SELECT point_id AS query, lat AS q_lat, lon AS q_lon, CASE point_id // 100 % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'achin' WHEN 2 THEN 'st' END AS one, CASE point_id // 100 % 4 WHEN 0 THEN 'mach' WHEN 1 THEN 'city' WHEN 2 THEN '2' END AS two FROM query_points WHERE point_id % 100 = 0),
p AS (SELECT oid, oid || ' ' || street AS label, lower(oid || ' ' || street || ' city 61701') AS body, lat / 1e6::DOUBLE AS lat, lon / 1e6::DOUBLE AS lon FROM idx)
SELECT query, CAST(n AS INTEGER) AS rank, label FROM (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY round(pow(lat - q_lat, 2) + pow((lon - q_lon) * cos(radians(q_lat)), 2), 12), label) AS n FROM q2, p WHERE contains(body, one) AND contains(body, two)) WHERE n <= 8
UNION ALL SELECT query, CAST(n AS INTEGER), label FROM q2, (SELECT label, row_number() OVER (ORDER BY oid) AS n FROM p) WHERE one IS NULL AND n <= 8""")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest places of the query points with the words of four searches, one of them empty."""
    places = address.build_index(address_rows(spark, sf_dir)).select(F.col("oid").alias("place_ord"), F.concat_ws(" ", F.col("oid").cast("string"), "street").alias("label"), F.concat(F.lit("City "), "zip").alias("address"), (F.col("lat") / 1e6).alias("lat"), (F.col("lon") / 1e6).alias("lon"))
    words = F.element_at(F.array(*(F.lit(x) for x in ("N mach", "achin CITY", "st 2", " "))), (F.floor(F.col("point_id") / 100) % 4 + 1).cast("int"))
    asked = view(spark, sf_dir, "query_points").where("point_id % 100 = 0").select(F.col("point_id").alias("query"), words.alias("words"), "lat", "lon")
    return address.nearest_places(asked, places)


@query("jon07_near_junction", EDGES + f"""
, both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
j AS (SELECT u FROM both_ways GROUP BY u HAVING count(DISTINCT v) >= 3),
placed AS (SELECT DISTINCT node_id, p.lat AS j_lat, p.lon AS j_lon FROM points p JOIN j ON j.u = p.node_id)
SELECT DISTINCT point_id FROM query_points, placed WHERE abs(lat - j_lat) < 0.0005 AND abs(lon - j_lon) < 0.0006 AND {sql_haversine('lat', 'lon', 'j_lat', 'j_lon')} <= 25""")
def near_junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points within 25 m of a node where three ways meet."""
    junctions = network.degrees(edges(spark, sf_dir)).where("degree >= 3")
    places = view(spark, sf_dir, "points").select("node_id", "lat", "lon").distinct().join(junctions, "node_id", "left_semi")
    return network.points_near(view(spark, sf_dir, "query_points"), places, 25.0).select("point_id")
