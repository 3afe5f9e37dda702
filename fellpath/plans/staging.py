"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Tables of this driver lie in a folder of its own.
_OWN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and
    the session runs on this machine alone a temporary folder of it stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors and driver would each see a folder of their own")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="fellpath-")
    return _FALLBACK["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own for one intermediate table or file set."""
    return f"{shared_dir(spark)}/fellpath-{_OWN}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this driver; results that are not written yet need them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fellpath-{_OWN}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts lineage like ``checkpoint()``, survives the loss of executors, and
    gives the following joins true sizes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
