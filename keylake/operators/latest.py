"""Which row of a key counts: the one with the greatest (version, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.log import deleted, expired, live

NEWEST = ["version", "seq"]


def latest(log: DataFrame, key: str = "key", newest: list[str] | None = None) -> DataFrame:
    """One row a key, by an aggregate that combines before it shuffles: a hot key sends one row a task."""
    newest = newest or NEWEST
    rest = [c for c in log.columns if c != key and c not in newest]
    best = F.max(F.struct(*newest, *rest)) if all(_ordered(log, c) for c in rest) else F.max_by(F.struct(*newest, *rest), F.struct(*newest))
    return log.groupBy(key).agg(best.alias("best")).select(key, "best.*").select(*log.columns)


def _ordered(log: DataFrame, column: str) -> bool:
    return not log.schema[column].dataType.simpleString().startswith(("map", "variant"))


def live_rows(log: DataFrame, now: int) -> DataFrame:
    """The latest rows that are neither deleted nor expired."""
    return latest(log).filter(live(now))


def deleted_keys(log: DataFrame) -> DataFrame:
    return latest(log).filter(deleted()).select("key", "version")


def expired_keys(log: DataFrame, now: int) -> DataFrame:
    """Keys whose latest row has expired, deleted or not."""
    return latest(log).filter(expired(now)).select("key", "ttl")


def ranked_versions(log: DataFrame) -> DataFrame:
    """All rows with their rank within the key, 1 for the newest."""
    newest_first = [F.col(c).desc() for c in NEWEST]
    return log.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*newest_first)))


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("n_versions"), F.count(F.when(deleted(), 1)).alias("n_deletes"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


def as_of(log: DataFrame, version: int, now: int) -> DataFrame:
    """An extension: what was live when only rows up to `version` were there."""
    return live_rows(log.filter(F.col("version") <= version), now)


def dead(now: int) -> Column:
    return deleted() | expired(now)
