"""Writes: a batch is appended, and the latest row decides; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.functions.sizes import octets
from keylake.log import DEL, PUT, Options
from keylake.operators.latest import latest


def puts(rows: DataFrame, version: int, seq: Column | None = None, ttl: Column | int = 0) -> DataFrame:
    """key and value as PUT rows of one version."""
    return rows.select("key", "value", F.lit(PUT).alias("op"), (ttl if isinstance(ttl, Column) else F.lit(ttl)).cast("long").alias("ttl"), F.lit(version).cast("long").alias("version"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"))


def tombstones(keys: DataFrame, version: int) -> DataFrame:
    """Keys as DEL rows."""
    return keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(DEL).alias("op"), F.lit(0).cast("long").alias("ttl"), F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"))


def appended(base: DataFrame, *batches: DataFrame) -> DataFrame:
    out = base
    for b in batches:
        out = out.unionByName(b.select(*base.columns))
    return out


def merged(tiers: list[DataFrame]) -> DataFrame:
    """One row a key from tiers, the newest tier first: a tier hides those after it, and within a tier the latest row counts."""
    out = None
    for rank, t in enumerate(tiers):
        t = t.withColumn("age", F.lit(-rank))
        out = t if out is None else out.unionByName(t)
    return merged_by(out, "age").drop("age")


def merged_by(log: DataFrame, tier_order: str) -> DataFrame:
    """As merged, with the tier as a column that is greater for newer tiers."""
    return latest(log, newest=[tier_order, "version", "seq"])


def batch_sizes(log: DataFrame, batch: Column, options: Options) -> DataFrame:
    """Rows and estimated bytes of each batch, and whether it is too big to commit. Small values count with their bytes, others with a pointer."""
    v = F.coalesce(octets("value"), F.lit(0))
    size = F.when(v < options.value_threshold, octets("key") + v + 1).otherwise(octets("key") + 13)
    request = 21 + octets("key") + v + 4
    return log.groupBy(batch.alias("batch")).agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"), F.sum(request).alias("request_bytes")).withColumn("too_big", (F.col("n_rows") >= options.max_batch_count) | (F.col("n_bytes") >= options.max_batch_bytes))


def routed(rows: DataFrame, value: str, threshold: int) -> DataFrame:
    """rows with `size` (bytes) and `place`: inline below the threshold, else the value log."""
    return rows.withColumn("size", F.coalesce(octets(value), F.lit(0)).cast("long")).withColumn("place", F.when(F.col("size") < threshold, "inline").otherwise("value_log"))


def route_stats(rows: DataFrame, value: str, threshold: int) -> DataFrame:
    return routed(rows, value, threshold).groupBy("place").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), F.max("size").alias("largest"))


def first_seen(log: DataFrame, key: str = "key") -> DataFrame:
    """Every row with whether its key was seen before, in the order of seq: an exact test-and-set. One aggregate finds the first row of a key; a hot key is no large window."""
    first = log.groupBy(key).agg(F.min("seq").alias("first_seq"))
    return log.join(first, key).select(key, "seq", (F.col("seq") > F.col("first_seq")).alias("seen"))
