"""Tables of the benchmark schema, and sketch tables that are kept on storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sketch columns are plain structs, so that a sketch table is an ordinary Parquet table."""
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path on shared storage, below spark.checkpoint.dir or else the warehouse, for a table that goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/sketch-tables/{name}-{uuid.uuid4().hex}")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return f"{folder.toString()}/table"
