"""The manifest: an append-only log of table changes, in sets. A change: set_seq, pos, table_id, op (CREATE, DELETE), level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ["set_seq", "pos"]
CREATE, DELETE = "CREATE", "DELETE"
#: A manifest is rewritten beyond this many deletions, if they are this many times the live tables.
DELETIONS, RATIO = 10_000, 10


def state(changes: DataFrame) -> DataFrame:
    """The tables that are there after all changes."""
    last = changes.groupBy("table_id").agg(F.max(F.struct(*ORDER, "op", "level")).alias("last"))
    return last.filter(F.col("last.op") == CREATE).select("table_id", "last.level")


def faults(changes: DataFrame) -> DataFrame:
    """Changes that can't be: a table made that is there, or dropped that isn't."""
    before = F.lag("op").over(W.partitionBy("table_id").orderBy(*ORDER))
    fault = F.when((F.col("op") == CREATE) & (F.col("before") == CREATE), "created twice").when((F.col("op") == DELETE) & (F.coalesce("before", F.lit(DELETE)) == DELETE), "deleted, not there")
    return changes.withColumn("before", before).withColumn("fault", fault).filter("fault is not null").select(*ORDER, "table_id", "op", "fault")


def reconciled(live: DataFrame, files: DataFrame) -> DataFrame:
    """table_id and action: a live table without a file is missing, a file without a live table is to be removed."""
    a, b = live.select("table_id").distinct(), files.select("table_id").distinct()
    return a.join(b, "table_id", "left_anti").select("table_id", F.lit("missing").alias("action")).unionByName(b.join(a, "table_id", "left_anti").select("table_id", F.lit("remove").alias("action")))


def rewrite_due(changes: DataFrame, deletions: int = DELETIONS, ratio: int = RATIO) -> DataFrame:
    """One row: creations, deletions, and whether a snapshot should replace the log."""
    n = changes.agg(F.count(F.when(F.col("op") == CREATE, 1)).alias("creations"), F.count(F.when(F.col("op") == DELETE, 1)).alias("deletions"))
    return n.withColumn("rewrite", (F.col("deletions") > deletions) & (F.col("deletions") > ratio * (F.col("creations") - F.col("deletions"))))


def snapshot(changes: DataFrame) -> DataFrame:
    """The state as one change set of creations."""
    return state(changes).select(F.lit(0).cast("long").alias("set_seq"), F.col("table_id").alias("pos"), "table_id", F.lit(CREATE).alias("op"), "level")


def replaced(live: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """A level's tables after a compaction: without `gone`, with `new`."""
    return live.join(gone.select("table_id"), "table_id", "left_anti").unionByName(new.select(*live.columns))


def change_set(gone: DataFrame, new: DataFrame, set_seq: int) -> DataFrame:
    """The changes that commit a compaction: creations first."""
    made = new.select(F.lit(0).alias("rank"), "table_id", F.lit(CREATE).alias("op"), "level")
    rows = made.unionByName(gone.select(F.lit(1).alias("rank"), "table_id", F.lit(DELETE).alias("op"), "level"))
    return rows.select(F.lit(set_seq).cast("long").alias("set_seq"), F.row_number().over(W.orderBy("rank", "table_id")).alias("pos"), "table_id", "op", "level")  # one compaction's tables
