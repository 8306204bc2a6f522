"""Tables written once in the folder that a cluster shares, to cut lineage or to fix partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.errors import InvalidRequest


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Unset, a folder of this machine serves in local mode, where driver and executors are one process, and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidRequest("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keylake-core-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df with `part`: rows of a part are a range of the keys, and parts are in the keys' order. Written, so that ranges stay as they were sampled."""
    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
