"""The log: rows of key, value, op (PUT or DEL), ttl, version and seq.

A log is any DataFrame with these columns; others are carried along. `version` orders the writes of a
key and `seq` breaks ties. `ttl` is an absolute time in seconds, 0 for never; `now` is always a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.errors import EmptyKey, TxnTooBig

PUT, DEL = "PUT", "DEL"
SCHEMA = "key string, value string, op string, ttl long, version long, seq long"
#: The time that the queries take for now: 2024-01-30T00:00Z.
NOW = 1706572800


@dataclass(frozen=True)
class Options:
    """Sizes in bytes. The values of a store that is opened without options."""

    value_threshold: int = 1024
    max_batch_count: int = 10_000
    max_batch_bytes: int = 64 << 20
    memtable_bytes: int = 64 << 20
    block_bytes: int = 8 << 10
    base_level_bytes: int = 10 << 20
    base_table_bytes: int = 5 << 20
    level_multiplier: int = 10
    table_multiplier: int = 2
    level_zero_tables: int = 15
    levels: int = 7
    value_log_bytes: int = 1 << 30
    value_log_entries: int = 1_000_000
    discard_ratio: float = 0.5


def kv_log(events: DataFrame) -> DataFrame:
    """The events as a log: user and event type are the key, low values delete, two of three rows expire after a day."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.concat(F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit("/"), "event_type").alias("key"),
        F.col("props").alias("value"),
        F.when(F.col("value") < 20, DEL).otherwise(PUT).alias("op"),
        F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.floor(micros / 1_000_000) + 86_400).alias("ttl"),
        micros.alias("version"),
        F.col("event_id").alias("seq"),
    )


def order_log(lineitem: DataFrame) -> DataFrame:
    """The order lines as a log that overwrites: one key a line, the shipping day is the version, ties go by all other columns."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return lineitem.select(
        F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.col("l_linenumber").cast("string")).alias("key"),
        F.struct(*rest).alias("value"),
        F.lit(PUT).alias("op"),
        F.lit(0).cast("long").alias("ttl"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("version"),
        F.struct(*rest).alias("seq"),
    )


def expired(now: int) -> Column:
    return (F.col("ttl") != 0) & (F.col("ttl") <= now)


def deleted() -> Column:
    return F.col("op") == DEL


def live(now: int) -> Column:
    """Neither deleted nor expired. Only to be asked of a key's latest row: an earlier row must not come back."""
    return ~deleted() & ~expired(now)


def checked(batch: DataFrame, options: Options | None = None) -> DataFrame:
    """The batch, if no key is empty and it is not too big: one aggregate of three numbers."""
    options = options or Options()
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 1
    row = batch.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.when(F.coalesce(F.octet_length("key"), F.lit(0)) == 0, 1)).alias("empty")).first()
    if row["empty"]:
        raise EmptyKey(f"{row['empty']} rows have no key")
    if row["n"] >= options.max_batch_count or row["bytes"] >= options.max_batch_bytes:
        raise TxnTooBig(f"{row['n']} rows, {row['bytes']} bytes")
    return batch
