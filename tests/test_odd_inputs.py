"""Every query on empty tables and on tables with nulls, repeated rows and further columns."""

import os

import pytest
from pyspark.sql import functions as F

from fellpath import catalog
from fellpath.plans import staging

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "customer", "part", "pages")


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """A few rows of each table, some twice, and for each column a row in which it is null."""
    path = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        few = rows.orderBy(*rows.columns[:1]).limit(40).cache()
        odd = few.union(few.limit(5))
        for c in rows.columns:
            odd = odd.union(few.limit(3).withColumn(c, F.lit(None).cast(rows.schema[c].dataType)).select(*rows.columns))
        odd.union(rows.limit(1).select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))).withColumns({"feature_ord": F.lit(1), "lat": F.lit("x"), "meters": F.lit(2)}).coalesce(2).write.parquet(f"{path}/{name}.parquet")
        few.unpersist()
    return str(path)


#: Sums over all rows have a row for an empty table.
ONE_ROW = {"agg15_build_report", "agg19_tile_statistics", "cdc08_dataset_checks"}
#: Layers that a manifest lists are told even where nothing is there.
MANIFEST = {"agg17_layer_counts"}


#: All queries with ALL_TESTS set; else every third, and every other.
NAMES, ALL = sorted(catalog.QUERIES), bool(os.environ.get("ALL_TESTS"))


@pytest.mark.parametrize("name", NAMES if ALL else NAMES[::3])
def test_empty_tables(spark, empty_dir, name):
    rows = catalog.QUERIES[name](spark, empty_dir).count()
    assert rows == (1 if name in ONE_ROW else 4 if name in MANIFEST else 0)


@pytest.mark.parametrize("name", NAMES if ALL else NAMES[1::2])
def test_nulls_repeats_and_clashing_columns(spark, odd_dir, name):
    catalog.QUERIES[name](spark, odd_dir).write.format("noop").mode("overwrite").save()


def test_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    held = staging.materialise(spark.range(3), "x")
    assert held.count() == 3 and len(os.listdir(tmp_path / "shared")) == 1
    staging.clear(spark)
    assert not os.listdir(tmp_path / "shared")
