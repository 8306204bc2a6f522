"""The value log: where records lie, what pointers give, and which files are worth collecting.

A record has fid, offset and len; a pointer is (fid, offset). Files are bounded, so windows by fid are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.errors import InvalidRequest
from keylake.functions.sizes import value_log_size
from keylake.operators.latest import latest
from keylake.log import live


def with_offsets(log: DataFrame, fid: Column) -> DataFrame:
    """log with fid, len and offset, in the order of seq within a file."""
    rows = log.withColumn("fid", fid.cast("long")).withColumn("len", value_log_size(F.col("key"), F.col("value"), F.col("ttl")))
    before = W.partitionBy("fid").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)))


def index_of(records: DataFrame) -> DataFrame:
    """The newest pointer of each key."""
    return latest(records.select("key", "version", "seq", "op", "ttl", "fid", "offset", "len"))


def dereferenced(index: DataFrame, records: DataFrame) -> DataFrame:
    """Each pointer's value; found is false where the log has no such record."""
    r = records.select("fid", "offset", "value", F.lit(True).alias("there"))
    return index.join(r, ["fid", "offset"], "left").select("key", "fid", "offset", "value", F.coalesce("there", F.lit(False)).alias("found"))


def with_liveness(records: DataFrame, now: int) -> DataFrame:
    """records with `alive`: the index still points at the record, and it is neither deleted nor expired."""
    current = index_of(records).filter(live(now)).select("key", "fid", "offset", F.lit(True).alias("current"))
    return records.join(current, ["key", "fid", "offset"], "left").withColumn("alive", F.coalesce("current", F.lit(False))).drop("current")


def rewritten(records: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """The rows of the collected files (fid) that a rewrite must keep: each key's newest row, if it is one of theirs.

    A dead one keeps no value, and stays only where another file has older rows of its key, which it must go on hiding.
    records: fid and the log's columns; (version, seq) tells a key's rows apart.
    """
    newest = latest(records.select("key", "op", "ttl", "version", "seq", "fid")).join(files.select("fid"), "fid", "left_semi")
    elsewhere = records.join(files.select("fid"), "fid", "left_anti").select("key", F.lit(True).alias("hides")).distinct()
    newest = newest.join(elsewhere, "key", "left").withColumn("alive", live(now)).filter("alive or hides").select("key", "version", "seq", "fid", "alive")
    rows = records.join(newest, ["key", "version", "seq", "fid"])
    return rows.withColumn("value", F.when(F.col("alive"), F.col("value"))).drop("alive")


def idle_files(files: DataFrame, pending: DataFrame) -> DataFrame:
    """The log files (fid) that no deletion is pending for (fid)."""
    return files.join(pending.select("fid"), "fid", "left_anti").select("fid")


def from_discard_json(rows: DataFrame) -> DataFrame:
    """fid and dead bytes, read back from discard_json."""
    return rows.select(F.explode(F.from_json("discards", "map<string,bigint>")).alias("fid", "discard")).select(F.col("fid").cast("long").alias("fid"), "discard")


def recovered(records: DataFrame, bad: Column, now: int) -> DataFrame:
    """What is live after a replay: the valid prefix of each log file, then the newest row of each key."""
    rows = valid_prefix(records, bad)
    return latest(rows).filter(live(now))


def discard_stats(records: DataFrame, now: int) -> DataFrame:
    """Per file: bytes, bytes of dead records and their share."""
    return dead_bytes(with_liveness(records, now))


def dead_bytes(judged: DataFrame) -> DataFrame:
    """discard_stats of records that with_liveness has judged."""
    out = judged.groupBy("fid").agg(F.sum("len").alias("total"), F.coalesce(F.sum(F.when(~F.col("alive"), F.col("len"))), F.lit(0)).alias("discard"))
    return out.withColumn("ratio", F.round(F.col("discard") / F.col("total"), 6))


def collectable(stats: DataFrame, ratio: float, head: int | None = None) -> DataFrame:
    """The files, older than head, whose dead share is ratio or more; the most dead bytes first."""
    if not 0 < ratio < 1:
        raise InvalidRequest("the ratio must be between 0 and 1")
    rows = stats if head is None else stats.filter(F.col("fid") < head)
    return rows.filter(F.col("discard") >= ratio * F.col("total")).orderBy(F.col("discard").desc(), "fid")


def picked(stats: DataFrame, head: DataFrame) -> DataFrame:
    """The file with the most dead bytes before head (one row, head); the lowest of equals. One row is the answer."""
    older = stats.join(F.broadcast(head.select("head")), F.col("fid") < F.col("head")).select(stats.columns)
    return older.orderBy(F.col("discard").desc(), "fid").limit(1)


def survivors(judged: DataFrame, files: DataFrame) -> DataFrame:
    """What a rewrite of the files puts back: their records (of with_liveness) that are alive."""
    return judged.filter("alive").join(files.select("fid"), "fid", "left_semi").select("key", "value", "op", "ttl", "version", "seq", "fid", "offset")


def newest_pointer(records: DataFrame) -> DataFrame:
    """The greatest (fid, offset, len): where the next replay begins."""
    return records.agg(F.max(F.struct("fid", "offset", "len")).alias("p")).select("p.*")


def valid_prefix(records: DataFrame, bad: Column) -> DataFrame:
    """The records of each file before its first bad one, by one aggregate and a join."""
    first = records.filter(bad).groupBy("fid").agg(F.min("offset").alias("bad_at"))
    return records.join(first, "fid", "left").filter("bad_at is null or offset < bad_at").drop("bad_at")


def valid_ends(records: DataFrame, bad: Column) -> DataFrame:
    """Per file, how many bytes and records can be replayed."""
    rows = records.withColumn("bad", bad).groupBy("fid").agg(F.min(F.when(F.col("bad"), F.col("offset"))).alias("bad_at"), F.sum("len").alias("all_bytes")).withColumn("valid_end", F.coalesce("bad_at", "all_bytes"))
    return rows.select("fid", "valid_end", F.col("bad_at").isNotNull().alias("cut"))


def discard_json(stats: DataFrame) -> DataFrame:
    """Dead bytes by file as JSON, one row a thousand files, so that no row grows with the log."""
    rows = stats.withColumn("shard", F.floor(F.col("fid") / 1000))
    return rows.groupBy("shard").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("fid").cast("string").alias("k"), "discard"))))).alias("discards"))
