"""Reads: by key, by keys, by prefix, by range, in order, and neighbours.

Conditions on the key are put on the log before the latest row is chosen, so that they reach the scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.operators import ranges
from keylake.operators.latest import live_rows
from keylake.storage import ranged


def get(log: DataFrame, key: str, now: int) -> DataFrame:
    """The live row of a key: one row or none."""
    return live_rows(log.filter(F.col("key") == key), now)


def multi_get(log: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """The live rows of a table of keys, which may be of any size: a semi join before the aggregate."""
    return live_rows(log.join(keys.select("key").distinct(), "key", "left_semi"), now)


def scan(log: DataFrame, now: int, ascending: bool = True) -> DataFrame:
    return live_rows(log, now).orderBy(F.col("key").asc() if ascending else F.col("key").desc())


def prefix_scan(log: DataFrame, prefix: str, now: int) -> DataFrame:
    return scan(log.filter(F.col("key").startswith(prefix)), now)


def range_scan(log: DataFrame, low: str | None, high: str | None, now: int) -> DataFrame:
    """Keys from low (included) to high (not included); None is open."""
    rows = log
    if low is not None:
        rows = rows.filter(F.col("key") >= low)
    if high is not None:
        rows = rows.filter(F.col("key") < high)
    return scan(rows, now)


def neighbours(log: DataFrame, probes: DataFrame | list[str], now: int) -> DataFrame:
    """Per distinct probe (a table with the column probe, of any size, or a list) the nearest live keys: gt, ge, lt and le."""
    if not isinstance(probes, DataFrame):
        probes = log.sparkSession.createDataFrame(pa.table({"probe": pa.array(probes, pa.string())}))  # rows of the plan, no Python on the executors
    return ranges.beside(live_rows(log, now).select("key"), probes)


def with_neighbours(log: DataFrame, now: int) -> DataFrame:
    """Every live key with the previous and the next one.

    Keys are dealt to ranges; a window within each range finds the neighbours inside it, and the first and
    last keys of the ranges, one row a range, find those across. No task sees more than a range.
    """
    rows = ranged(live_rows(log, now).select("key"), "key")
    ends = rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = W.orderBy("part")  # over one row a range
    beside = ends.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    inside = W.partitionBy("part").orderBy("key")
    return rows.join(beside, "part").select("key", F.coalesce(F.lag("key").over(inside), "before").alias("prev_key"), F.coalesce(F.lead("key").over(inside), "after").alias("next_key"))


def first_last(log: DataFrame, now: int) -> DataFrame:
    return live_rows(log, now).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def top_keys(log: DataFrame, n: int, now: int) -> DataFrame:
    """The n greatest live keys, falling."""
    return live_rows(log, now).orderBy(F.col("key").desc()).limit(n)


def info(log: DataFrame, now: int) -> DataFrame:
    """Counts of rows, keys, live, deleted and expired keys: one row."""
    newest = log.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("version", "seq", "op", "ttl")).alias("last"))
    gone, out = F.col("last.op") == "DEL", (F.col("last.ttl") != 0) & (F.col("last.ttl") <= now)
    return newest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.count(F.when(~gone & ~out, 1)).alias("n_live"), F.count(F.when(gone, 1)).alias("n_deleted"), F.count(F.when(out, 1)).alias("n_expired"))
