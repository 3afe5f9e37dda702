"""Network views projected from the relational test tables.

The tables hold no trails, so features, polyline vertices, legs, GPS fixes,
query points, addresses and rides (times on a calendar of 31-day months) are
derived from them by plain SQL that Spark and DuckDB both accept. Vertices lie
on a lattice of 0.001 degree, far wider than any snap tolerance, so results do
not depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Bytes of ``lineitem`` as stored whose rows one task puts in order.
TASK_BYTES = 4_000_000
TABLES = ("orders", "lineitem", "events", "customer", "part")

CTES = """
WITH ord_v AS (
  SELECT l_orderkey, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS vertex_ord
  FROM {lineitem}),
vertices AS (
  SELECT CAST(v.l_orderkey AS BIGINT) AS feature_ord, CAST(v.vertex_ord AS BIGINT) AS vertex_ord,
         CAST(o.o_custkey % 60 + sum(v.l_partkey % 3 - 1) OVER w AS BIGINT) AS bx,
         CAST((o.o_custkey - o.o_custkey % 60) / 60 % 60 + sum(v.l_suppkey % 3 - 1) OVER w AS BIGINT) AS byy
  FROM ord_v v JOIN {orders} o ON v.l_orderkey = o.o_orderkey
  WINDOW w AS (PARTITION BY v.l_orderkey ORDER BY v.vertex_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
points AS (
  SELECT feature_ord, vertex_ord, (bx + 500) * 10000 + (byy + 500) AS node_id,
         CAST(40.4 AS DOUBLE) + CAST(byy AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lat,
         CAST(-89.2 AS DOUBLE) + CAST(bx AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lon
  FROM vertices),
features AS (
  SELECT CAST(o_orderkey AS BIGINT) AS feature_ord, concat('o:', CAST(o_orderkey AS STRING)) AS feature_id,
         CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE concat('Trail ', CAST(o_custkey % 11 AS STRING)) END AS name,
         CASE WHEN o_orderstatus = 'P' THEN 'Proposed' ELSE 'Existing' END AS status,
         CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'TrailBranches' WHEN '2' THEN 'ParkConnectors'
              WHEN '3' THEN 'SharedRoadways' ELSE 'TrailBranches' END AS role,
         CASE o_orderkey % 7 WHEN 0 THEN 'BikeLane' WHEN 1 THEN 'OffRoadTrail' WHEN 2 THEN 'SeparatedTrail' WHEN 3 THEN 'SharedLane'
              WHEN 4 THEN 'UrbanTrail' WHEN 5 THEN 'Other' ELSE 'Unknown' END AS facility,
         CASE o_custkey % 5 WHEN 0 THEN 'AllAgesAndAbilities' WHEN 1 THEN 'MostAdults' WHEN 2 THEN 'ExperiencedBicyclists'
              WHEN 3 THEN 'StrongAndFearless' ELSE 'Unknown' END AS comfort,
         CAST(o_custkey AS BIGINT) AS rider, CAST(o_orderdate AS DATE) AS ridden_on
  FROM {orders}),
legs AS (
  SELECT * FROM (
    SELECT feature_ord, vertex_ord AS leg_ord, node_id AS a_id, lat AS a_lat, lon AS a_lon,
           lead(node_id) OVER n AS b_id, lead(lat) OVER n AS b_lat, lead(lon) OVER n AS b_lon
    FROM points WINDOW n AS (PARTITION BY feature_ord ORDER BY vertex_ord)) t
  WHERE b_id IS NOT NULL AND b_id <> a_id),
fixes AS (
  SELECT rider, seq, event_id,
         CAST(sum(CASE event_type WHEN 'signup' THEN 20000 ELSE 5000 END) OVER (PARTITION BY rider ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fix_ms,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 3 END AS accuracy_m,
         CAST(CASE WHEN seq % 24 BETWEEN 10 AND 17 THEN 90 + seq % 5 ELSE seq % 30 END AS DOUBLE) AS off_m,
         CAST(-89.2 AS DOUBLE) + CAST(seq AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS lon
  FROM (SELECT user_id AS rider, event_id, event_type, value,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM {events}) e),
query_points AS (
  SELECT CAST(c_custkey AS BIGINT) AS point_id,
         CAST(40.4 AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE) * CAST(0.00025 AS DOUBLE) + CAST(0.00013 AS DOUBLE) AS lat,
         CAST(-89.2 AS DOUBLE) + CAST(c_custkey % 89 AS DOUBLE) * CAST(0.0006 AS DOUBLE) + CAST(0.00017 AS DOUBLE) AS lon
  FROM {customer}),
addresses AS (
  SELECT CAST(c_custkey AS BIGINT) AS oid,
         concat(CAST(100 + c_custkey * 7 % 900 AS STRING), CASE WHEN c_custkey % 17 = 0 THEN 'A' ELSE '' END,
                CASE WHEN c_custkey % 2 = 0 THEN ' North ' ELSE ' ' END, c_mktsegment,
                CASE WHEN c_custkey % 3 = 0 THEN ' Street' ELSE ' Ave' END) AS address,
         CASE WHEN c_custkey % 19 = 0 THEN concat('Unit ', CAST(c_custkey % 4 AS STRING)) END AS unit,
         CAST(c_nationkey AS BIGINT) AS city_id,
         CAST(40.4 AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE) * CAST(0.00025 AS DOUBLE) AS lat,
         CAST(-89.2 AS DOUBLE) + CAST(c_custkey % 83 AS DOUBLE) * CAST(0.0006 AS DOUBLE) AS lon
  FROM {customer}),
rides AS (
  SELECT CAST(o_orderkey AS BIGINT) AS ride_id, CAST(o_custkey AS BIGINT) AS rider,
         CASE WHEN o_orderkey % 3 = 0 THEN 'ExerciseLoop' ELSE 'Navigation' END AS kind,
         concat('Ride ', CAST(o_orderkey % 40 AS STRING)) AS title,
         o_totalprice / 10 AS meters, CAST(o_custkey % 10 AS DOUBLE) * 60 AS access_m, CAST(o_orderkey % 4 AS DOUBLE) * 45 AS shared_m,
         CAST(o_orderkey % 9 AS DOUBLE) * o_totalprice / 200 AS overlap_m, o_totalprice / 10 + CAST(o_orderkey % 7 AS DOUBLE) * 400 AS target_m,
         CAST(year(o_orderdate) * 372 + month(o_orderdate) * 31 + day(o_orderdate) AS BIGINT) * 86400000 + CAST(o_orderkey % 86400 AS BIGINT) * 1000 AS used_ms
  FROM {orders}),
parts_before AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CAST(p_retailprice AS DOUBLE) AS price FROM {part} WHERE p_partkey % 10 <> 0),
parts_after AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name,
         CAST(p_retailprice AS DOUBLE) + CASE WHEN p_partkey % 10 = 2 THEN 1 ELSE 0 END AS price
  FROM {part} WHERE p_partkey % 10 <> 1)
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above as a DataFrame; Catalyst drops what it does not need."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    # Vertices are ordered by feature; where the session's number of tasks is too small for that, more share the rows.
    tasks = math.ceil(_stored(spark, f"{sf_dir}/lineitem.parquet") / TASK_BYTES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        tables["lineitem"] = tables["lineitem"].repartition(tasks, "l_orderkey")
    return spark.sql(f"{CTES} SELECT * FROM {name}", **tables)


def _stored(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def oracle(sql: str) -> str:
    """DuckDB SQL over the same views; ``sql`` is a SELECT or goes on with ``, x AS (...)``."""
    return CTES.format(**{t: t for t in TABLES}) + sql
