"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() and bytes.strip() have it: [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WORDS_PER_SHINGLE = 5
NEAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Unset, a folder of this machine serves in local mode, where driver and executors are one process; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keylake-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/keylake-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_file(spark: SparkSession, path: str):
    """A small file's bytes, such as a vocabulary of some MB, as a broadcast, and a name for them: executors needn't have the path."""
    raw = Path(path).read_bytes()
    return spark.sparkContext.broadcast(raw), hashlib.sha1(raw).hexdigest()


def slices(batches, rows: int = 1024):
    """Arrow batches in slices of at most `rows`, so that what a task makes of one is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batch_of(columns: dict):
    """An Arrow record batch from a dict of arrays or lists with their types as (values, type)."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns))
