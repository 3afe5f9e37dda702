"""The views over the test tables."""

from pyspark.sql import functions as F

from fellpath import catalog
from fellpath.operators import network
from fellpath.plans import projection

SF_DIR = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """The windows of features are dealt to tasks by the size of their table, not to a fixed number of them."""
    query = catalog.QUERIES["agg03_self_overlap"]
    want = sorted(query(spark, SF_DIR).collect())
    monkeypatch.setattr(projection, "TASK_BYTES", 1_000)
    dealt = projection.view(spark, SF_DIR, "legs").withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.groupBy("feature_ord").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()
    assert sorted(query(spark, SF_DIR).collect()) == want


def test_local_features_are_found_by_distinct_lines(spark, monkeypatch):
    """Each place meets each line once, however many features share it."""
    met = []
    monkeypatch.setattr(network, "segments_in_reach", lambda points, legs, meters, f=network.segments_in_reach: met.append((points, legs)) or f(points, legs, meters))
    found = catalog.QUERIES["flt03_endpoint_local"](spark, SF_DIR)
    (points, lines) = met[0]
    assert points.count() == points.distinct().count() and lines.count() == lines.distinct().count() == lines.select(*network.SEGMENT).distinct().count()
    assert found.count() == found.distinct().count() > 0


def test_roads_of_loops_are_counted_without_pairs(spark, monkeypatch):
    """Segments, each once, meet places; counts agree with the pairs, also over several passes."""
    points = projection.view(spark, SF_DIR, "query_points").where("point_id % 10 = 0")
    starts = points.select(F.col("point_id").alias("request"), "lat", "lon", (1000 + F.col("point_id") % 7 * 500).cast("double").alias("target"))
    roads = projection.view(spark, SF_DIR, "legs").where("feature_ord % 5 = 0")
    want = {tuple(r) for r in network.within_loop_radius(starts, roads).groupBy("request").count().collect()}
    met = []
    monkeypatch.setattr(network, "segments_in_reach", lambda points, legs, meters, f=network.segments_in_reach: met.append(legs) or f(points, legs, meters))
    for name in ("SPOTS", "FEW_SPOTS"):
        monkeypatch.setattr(network, name, 5)
    assert {tuple(r) for r in network.count_within_loop_radius(starts, roads).collect()} == want and want
    assert len(met) > 1 and all(x.count() == x.distinct().count() and x.columns == network.SEGMENT for x in met)
    assert network.count_within_loop_radius(starts.limit(0), roads).count() == 0 == network.count_within_loop_radius(starts, roads.limit(0)).count()
