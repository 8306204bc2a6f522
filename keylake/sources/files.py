"""Inputs: the tables of a folder, and listings of numbered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.functions.sizes import file_id


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered_files(spark: SparkSession, folder: str, kind: str = "sst") -> DataFrame:
    """table_id, name and bytes of the files NNNNN.kind in a folder, listed by Spark's file source without reading contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(file_id(name).alias("table_id"), name.alias("name"), F.col("length").alias("bytes"))
