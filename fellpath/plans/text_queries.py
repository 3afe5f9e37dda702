"""Queries over names, keys, labels and typed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.functions import text
from fellpath.plans.projection import view
from fellpath.plans.registry import query

NOW_MS = (2001 * 372 + 8 * 31 + 2) * 86_400_000
COORDINATES = """
, coords AS (SELECT feature_ord, string_agg(c, ';' ORDER BY vertex_ord) AS ahead, string_agg(c, ';' ORDER BY vertex_ord DESC) AS back, count(*) AS n, min(lat) FILTER (vertex_ord = 1) AS lat
  FROM (SELECT *, CAST(floor(lat * 1e7::DOUBLE + 0.5) AS BIGINT)::VARCHAR || ',' || CAST(floor(lon * 1e7::DOUBLE + 0.5) AS BIGINT)::VARCHAR AS c FROM points) GROUP BY feature_ord),
keys AS (SELECT feature_ord, 'o:' || feature_ord || '#' || least(ahead, back) AS key, n FROM coords)"""
STYLED = "CASE feature_ord % 5 WHEN 0 THEN 'Route 66' WHEN 1 THEN ' Interurban ' WHEN 2 THEN 'Route 66 & Southtown' WHEN 3 THEN 'route 66' ELSE name END"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_ord, key): the traversal key of every feature."""
    points = view(spark, sf_dir, "points").select("feature_ord", F.struct("vertex_ord", text.coordinate("lat", "lon").alias("c")).alias("p"))
    paths = points.groupBy("feature_ord").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]).alias("c"))
    return paths.select("feature_ord", text.traversal_key(F.concat(F.lit("o:"), F.col("feature_ord").cast("string")), "c").alias("key"))


@query("fun17_traversal_key", COORDINATES + "SELECT feature_ord, key FROM keys")
def traversal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir)


@query("fun18_key_identity", COORDINATES + """
SELECT feature_ord, key AS variant, CASE feature_ord % 3 WHEN 0 THEN '#' || split_part(key, '#', 2) WHEN 1 THEN 'x#unknown' ELSE 'plain' END AS identity FROM keys""")
def key_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("feature_ord") % 3
    told = F.when(kind == 0, F.col("key")).when(kind == 1, "x#unknown").otherwise("plain")
    return keys(spark, sf_dir).select("feature_ord", F.col("key").alias("variant"), text.key_identity(told).alias("identity"))


@query("fun19_key_points", COORDINATES + "SELECT feature_ord, CASE WHEN n >= 2 THEN n END AS n_points, CASE WHEN n >= 2 THEN round(CAST(split_part(split_part(least(ahead, back), ';', 1), ',', 1) AS BIGINT) / 1e7::DOUBLE, 7) END AS first_lat FROM coords")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = text.key_points("key")
    return keys(spark, sf_dir).select("feature_ord", F.when(points.isNotNull(), F.size(points)).cast("long").alias("n_points"), F.round(points[0]["lat"], 7).alias("first_lat"))


@query("fun20_names", """SELECT feature_ord, nullif(trim(CASE feature_ord % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || name ELSE name END), '') AS name_key,
  coalesce(lower(nullif(trim(CASE feature_ord % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || name ELSE name END), '')), '-') = coalesce(lower(trim(name)), '-') AS same FROM features""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names, and whether they match the plain name of the feature."""
    kind = F.col("feature_ord") % 3
    told = F.when(kind == 0, "  ").when(kind == 1, F.concat(F.lit(" "), "name")).otherwise(F.col("name"))
    return view(spark, sf_dir, "features").select("feature_ord", text.name_key(told).alias("name_key"), text.names_match(told, F.upper("name")).alias("same"))


@query("fun21_display_style", f"""SELECT feature_ord, CASE WHEN status = 'Proposed' THEN 'Proposed' WHEN trim({STYLED}) = 'Route 66' THEN 'Route66' WHEN trim({STYLED}) = 'Interurban' THEN 'Interurban'
  WHEN trim({STYLED}) = 'Route 66 & Southtown' THEN 'Route66Southtown' WHEN role = 'ParkConnectors' THEN 'ParkTrailConnectors' WHEN role = 'SharedRoadways' THEN 'SuggestedSharedRoadways' ELSE 'Route66' END AS style FROM features""")
def display_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "features").select("feature_ord", text.display_style("status", F.array("role"), F.expr(STYLED)).alias("style"))


@query("fun22_route_roles", """SELECT feature_ord, CASE WHEN feature_ord % 2 = 0 THEN 'TrailBranches' || CASE WHEN rider % 5 IN (1, 4) THEN ',SharedRoadways' ELSE '' END
  ELSE concat_ws(',', CASE WHEN rider % 5 IN (3, 4) AND rider % 3 = 2 THEN 'ParkConnectors' END, CASE WHEN rider % 5 = 4 AND rider % 3 = 1 THEN 'SharedRoadways' END) END AS roles FROM features""")
def route_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("rider") % 5).cast("string")
    layer = F.when(F.col("feature_ord") % 2 == 0, 54).otherwise(16)
    return view(spark, sf_dir, "features").select("feature_ord", F.array_join(text.route_roles(layer, code, code, (F.col("rider") % 3).cast("string")), ",").alias("roles"))


@query("fun23_duration_text", """SELECT ride_id, CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' hr ' || (m % 60) || ' min' END AS duration
  FROM (SELECT ride_id, greatest(1, CAST(floor(meters / 1609.344::DOUBLE / 8 * 60 + 0.5) AS BIGINT)) AS m FROM rides)""")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", text.duration_text("meters").alias("duration"))


@query("fun24_distance_label", """SELECT ride_id, CASE WHEN m < 1 THEN 'Now' WHEN m * 3.28084::DOUBLE < 500 THEN CAST(floor(m * 3.28084::DOUBLE / 25 + 0.5) * 25 AS BIGINT) || ' ft'
  ELSE regexp_replace(CAST(floor(m / 1609.344::DOUBLE * 10 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || ' mi' END AS label FROM (SELECT ride_id, meters * meters / 2500000 - 0.5 AS m FROM rides)""")
def distance_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", text.instruction_distance(F.col("meters") * F.col("meters") / 2500000 - 0.5).alias("label"))


@query("fun25_mileage", "SELECT ride_id, CAST(round_even(meters / 1609.344::DOUBLE * 100, 0) / 100 AS VARCHAR) AS miles, (t // 10) || '.' || (t % 10) AS tenths FROM (SELECT *, CAST(floor(meters / 1609.344::DOUBLE * 10 + 0.5) AS BIGINT) AS t FROM rides)")
def mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", text.mileage(F.col("meters") / text.METERS_PER_MILE).alias("miles"), text.miles_text("meters").alias("tenths"))


SQL_MILES = "CASE WHEN {0} / 1609.344::DOUBLE < 0.05 THEN '0.00' ELSE CAST(round_even({0} / 1609.344::DOUBLE * 100, 0) / 100 AS VARCHAR) END"


@query("fun26_route_summary", f"""SELECT ride_id, CASE WHEN kind = 'ExerciseLoop' THEN
    CASE WHEN abs(meters - target_m) <= greatest(160, target_m * 0.1::DOUBLE) THEN 'Exercise loop found' ELSE 'Closest exercise route found' END || ': ' || CAST(round_even(meters / 1609.344::DOUBLE * 100, 0) / 100 AS VARCHAR) || ' mi, about '
    || CASE WHEN mins < 60 THEN mins || ' min' ELSE (mins // 60) || ' hr ' || (mins % 60) || ' min' END || ' at 8 mph' || CASE WHEN overlap_m >= 50 THEN '; ' || CAST(round_even(overlap_m / 1609.344::DOUBLE * 100, 0) / 100 AS VARCHAR) || ' mi retraced' ELSE '' END || '.'
  ELSE 'Trail route found: ' || {SQL_MILES.format('greatest(0::DOUBLE, meters - access_m - shared_m)')} || ' trail/connector miles' || CASE WHEN shared_m > 0.01 THEN ', ' || {SQL_MILES.format('shared_m')} || ' shared-road miles' ELSE '' END
    || ', ' || {SQL_MILES.format('access_m')} || ' access miles, ' || {SQL_MILES.format('meters')} || ' total miles.' END AS summary
  FROM (SELECT *, greatest(1, CAST(floor(meters / 1609.344::DOUBLE / 8 * 60 + 0.5) AS BIGINT)) AS mins FROM rides)""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    loop = text.loop_summary("meters", "target_m", "overlap_m")
    return view(spark, sf_dir, "rides").select("ride_id", F.when(F.col("kind") == "ExerciseLoop", loop).otherwise(text.route_summary("meters", "access_m", "shared_m")).alias("summary"))


@query("fun27_elapsed_text", f"""SELECT ride_id, CASE WHEN e < 60000 THEN 'Just now' WHEN e < 3600000 THEN (e // 60000) || ' min ago' WHEN e < 86400000 THEN (e // 3600000) || ' hr ago' WHEN e < 172800000 THEN '1 day ago' ELSE (e // 86400000) || ' days ago' END AS ago
  FROM (SELECT ride_id, greatest(0, {NOW_MS} - used_ms) // (1 + ride_id % 3000) AS e FROM rides)""")
def elapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.floor(F.greatest(F.lit(0), F.lit(NOW_MS) - F.col("used_ms")) / (1 + F.col("ride_id") % 3000))
    return view(spark, sf_dir, "rides").select("ride_id", text.elapsed_text(F.lit(NOW_MS) - gone, F.lit(NOW_MS)).alias("ago"))


SQL_TOKENS = "list_transform(list_filter(string_split_regex(regexp_replace(upper(address), '[.,#]', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: coalesce(map {'NORTH': 'N', 'STREET': 'ST', 'AV': 'AVE'}[w], w))"


@query("fun28_address_tokens", f"SELECT oid, array_to_string({SQL_TOKENS}, ' ') AS tokens FROM addresses")
def address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "addresses").select("oid", F.array_join(text.address_tokens("address"), " ").alias("tokens"))


@query("fun29_alias_completions", """SELECT oid, CASE prefix WHEN 'ST' THEN 'ST' WHEN 'AV' THEN 'AVE' WHEN 'NO' THEN 'N,NE,NW' WHEN 'BO' THEN 'BLVD' WHEN 'S' THEN '' ELSE '' END AS words
  FROM (SELECT oid, CASE oid % 6 WHEN 0 THEN 'ST' WHEN 1 THEN 'AV' WHEN 2 THEN 'NO' WHEN 3 THEN 'BO' WHEN 4 THEN 'S' ELSE 'ZZ' END AS prefix FROM addresses)""")
def alias_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ("ST", "AV", "NO", "BO", "S", "ZZ"))), (F.col("oid") % 6 + 1).cast("int"))
    return view(spark, sf_dir, "addresses").select("oid", F.array_join(text.alias_completions(prefix), ",").alias("words"))


@query("fun30_house_number", """SELECT oid, CASE oid % 5 WHEN 4 THEN NULL ELSE oid END AS num, CASE oid % 5 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN '-7' WHEN 3 THEN '1/2' END AS suffix FROM addresses WHERE oid % 10 <> 1
  UNION ALL SELECT oid, oid, 'C' FROM addresses WHERE oid % 10 = 1""")
def house_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in each accepted way and in one that is none."""
    n = F.col("oid").cast("string")
    told = F.when(F.col("oid") % 10 == 1, F.concat(n, F.lit("-C"))).otherwise(F.concat(n, F.element_at(F.array(*map(F.lit, ("", "B", "-7", "1/2", "x"))), (F.col("oid") % 5 + 1).cast("int"))))
    found = text.house_number(told)
    return view(spark, sf_dir, "addresses").select("oid", found["num"].alias("num"), found["suffix"].alias("suffix"))


@query("fun31_titles", f"""SELECT oid, trim(CASE WHEN oid % 2 = 0 THEN 'BLDG ' || upper(chr(CAST(97 + oid % 26 AS INTEGER))) ELSE '' END || ' ' || upper(coalesce(unit, ''))) AS unit,
  array_to_string(list_transform({SQL_TOKENS}, lambda w: CASE WHEN w IN ('N', 'S', 'E', 'W') OR regexp_matches(w, '[0-9]') THEN w ELSE w[1] || lower(w[2:]) END), ' ') AS street FROM addresses""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    building = F.when(F.col("oid") % 2 == 0, F.char((F.col("oid") % 26 + 97).cast("int")))
    return view(spark, sf_dir, "addresses").select("oid", text.unit_text(building, "unit").alias("unit"), text.street_title(F.array_join(text.address_tokens("address"), " ")).alias("street"))


@query("fun32_canonical_json", """SELECT id, sha256('{"id":' || id || ',"name":"' || name || '","size":' || CASE WHEN id % 3 = 0 THEN 'null' ELSE CAST(id % 7 AS VARCHAR) END || '}') AS digest FROM parts_before""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"size": F.when(F.col("id") % 3 != 0, F.col("id") % 7), "name": F.col("name"), "id": F.col("id")}
    return view(spark, sf_dir, "parts_before").select("id", text.digest(text.canonical_json(fields)).alias("digest"))


@query("fun33_route_key", """SELECT ride_id, 'route-' || lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(CAST(ride_id AS VARCHAR) || kind, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS key FROM rides""")
def route_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", text.route_key(F.concat(F.col("ride_id").cast("string"), "kind")).alias("key"))


@query("fun34_utc_millis", """SELECT ride_id, CASE ride_id % 4 WHEN 3 THEN NULL ELSE 1000000000000 + (ride_id % 4) * 86400000 + ride_id % 60 * 1000 + CASE WHEN ride_id % 4 = 2 THEN 250 ELSE 0 END END AS ms FROM rides""")
def utc_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written with Z, with a zero offset, with fractions, and with another offset."""
    second = F.lpad((F.col("ride_id") % 60 + 40 - F.when(F.col("ride_id") % 60 >= 20, 60).otherwise(0)).cast("string"), 2, "0")
    minute = F.when(F.col("ride_id") % 60 >= 20, "47").otherwise("46")
    day = (F.col("ride_id") % 4 + 9).cast("string")
    told = F.concat(F.lit("2001-09-"), F.lpad(day, 2, "0"), F.lit("T01:"), minute, F.lit(":"), second, F.element_at(F.array(*map(F.lit, ("Z", "+00:00", ".250Z", "+02:00"))), (F.col("ride_id") % 4 + 1).cast("int")))
    return view(spark, sf_dir, "rides").select("ride_id", text.utc_millis(told).alias("ms"))


@query("fun35_source_time", """SELECT ride_id, strftime(make_timestamp(CAST(ms // 1000 * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ms % 1000 > 0 THEN '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '000' ELSE '' END || 'Z' AS iso
  FROM (SELECT ride_id, 1000000000000 + ride_id * 1234 AS ms FROM rides)""")
def source_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rides").select("ride_id", text.source_time(F.lit(1_000_000_000_000) + F.col("ride_id") * 1234).alias("iso"))


@query("fun36_network_prefix", """SELECT ride_id, CASE ride_id % 5 WHEN 0 THEN '10.0.' || (ride_id % 250) || '.7' WHEN 1 THEN NULL WHEN 2 THEN '2001:db8:' || lower(to_hex(ride_id % 65536)) || ':0::/64' WHEN 3 THEN '1.2.3.4' ELSE NULL END AS prefix FROM rides""")
def network_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in several notations and two that are none."""
    n, kind = F.col("ride_id"), F.col("ride_id") % 5
    told = F.when(kind == 0, F.concat(F.lit("010.0."), (n % 250).cast("string"), F.lit(".7"))).when(kind == 1, "1.2.3.256").when(kind == 2, F.concat(F.lit("2001:DB8:"), F.hex(n % 65536), F.lit("::9:1"))).when(kind == 3, "::ffff:0102:0304").otherwise("1:2:3")
    return view(spark, sf_dir, "rides").select("ride_id", text.network_prefix(told).alias("prefix"))


@query("fun37_parsed_miles", """SELECT ride_id, CASE ride_id % 4 WHEN 0 THEN (ride_id % 130)::DOUBLE WHEN 1 THEN ride_id % 7 + 0.25::DOUBLE END AS miles,
  coalesce(CASE ride_id % 4 WHEN 0 THEN (ride_id % 130) BETWEEN 1 AND 100 WHEN 1 THEN ride_id % 7 + 0.25 >= 0.5 END, false) AS valid FROM rides""")
def parsed_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("ride_id"), F.col("ride_id") % 4
    miles = text.parsed_miles(F.when(kind == 0, F.concat(F.lit(" "), (n % 130).cast("string"), F.lit(" "))).when(kind == 1, F.concat((n % 7).cast("string"), F.lit(".25"))).when(kind == 2, "NaN").otherwise("five"))
    return view(spark, sf_dir, "rides").select("ride_id", miles.alias("miles"), text.loop_target_valid(miles * text.METERS_PER_MILE).alias("valid"))


@query("fun38_first_place", "SELECT oid, CASE WHEN oid % 4 = 0 THEN NULL ELSE address END AS place FROM addresses")
def first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("oid") % 4 == 0, " , Somewhere").otherwise(F.concat(F.lit(" "), "address", F.lit(" , Somewhere, IL")))
    return view(spark, sf_dir, "addresses").select("oid", text.first_place(told).alias("place"))


@query("fun39_point_label", "SELECT point_id, 'Map point ' || printf('%.5f', floor(lat * 100000 + 0.5) / 100000) || ', -' || printf('%.5f', floor(-lon * 100000 + 0.5) / 100000) AS label FROM query_points")
def point_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "query_points").select("point_id", text.point_label("lat", "lon").alias("label"))


@query("fun40_share_text", """SELECT ride_id, title || chr(10) || kind || chr(10) || CASE ride_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1 turnaround: turn back at 325 ft.' || chr(10) ELSE '3 turnarounds: turn back at 325 ft, 1 mi and 1.5 mi.' || chr(10) END || chr(10) || 'Shared.' AS text FROM rides""")
def share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.slice(F.array(F.lit(100.0), F.lit(1609.344), F.lit(2414.0)), 1, F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (F.col("ride_id") % 3 + 1).cast("int")))
    return view(spark, sf_dir, "rides").select("ride_id", text.share_text("title", "kind", turns, "Shared.").alias("text"))
