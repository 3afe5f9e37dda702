"""Tables in tiles of 0.01 degree: written by tile, read by window, audited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fellpath.functions import geo
from fellpath.plans.staging import fresh_path


def placed(features: DataFrame, key: str) -> DataFrame:
    """Features (south, north, west, east) in every tile of their box, with tile_row and tile_col."""
    lo, hi = geo.tile_key("south", "west"), geo.tile_key("north", "east")
    rows = features.withColumn("tile_row", F.explode(F.sequence(lo[0], hi[0])))
    return rows.withColumn("tile_col", F.explode(F.sequence(lo[1], hi[1])))


def write(features: DataFrame, key: str, path: str) -> None:
    """Write features by the row of their tiles, sorted by column, so that a window reads
    few folders and, by the statistics of the files, little of each."""
    rows = placed(features, key)
    rows.repartition("tile_row").sortWithinPartitions("tile_row", "tile_col", key).write.partitionBy("tile_row").mode("error").parquet(path)


def publish(df: DataFrame, label: str) -> str:
    """Write a new version of a table to a path of its own and return it; readers of the
    old version are not disturbed, and a write that fails leaves nothing that is read."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return path


def window(spark: SparkSession, path: str, points: DataFrame, key: str, width: int = 1, schema: StructType | None = None) -> DataFrame:
    """Features of the (2 width + 1)^2 tiles around points, each once. With the
    ``schema`` of the features an empty table of tiles can be read too."""
    row, col = geo.tile_key("lat", "lon")
    asked = points.where("lat is not null and lon is not null").select(row.alias("r"), col.alias("c")).distinct()
    asked = asked.select(F.explode(F.sequence(F.col("r") - width, F.col("r") + width)).alias("tile_row"), "c")
    asked = asked.select("tile_row", F.explode(F.sequence(F.col("c") - width, F.col("c") + width)).alias("tile_col")).distinct()
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("tile_col", LongType()), StructField("tile_row", LongType())]))
    held = reader.parquet(path)
    found = held.join(asked.select(F.col("tile_row").cast(held.schema["tile_row"].dataType), "tile_col"), ["tile_row", "tile_col"], "left_semi")
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("tile_row", "tile_col"))).where("_n = 1")
    return first.drop("_n", "tile_row", "tile_col")


def audit(tiled: DataFrame, key: str) -> DataFrame:
    """(key, tile_row, tile_col, fault): features that repeat in a tile or do not touch it."""
    step = 0.01
    touches = (F.col("north") >= F.col("tile_row") * step) & (F.col("south") < (F.col("tile_row") + 1) * step) & (F.col("east") >= F.col("tile_col") * step) & (F.col("west") < (F.col("tile_col") + 1) * step)
    outside = tiled.where(~F.coalesce(touches, F.lit(False))).select(key, "tile_row", "tile_col", F.lit("outside").alias("fault")).distinct()
    again = tiled.groupBy(key, "tile_row", "tile_col").agg(F.count("*").alias("n")).where("n > 1").select(key, "tile_row", "tile_col", F.lit("repeated").alias("fault"))
    return outside.unionByName(again)
