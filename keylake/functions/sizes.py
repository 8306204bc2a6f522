"""Encoded sizes, key suffixes, prefixes and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a stored key has for its version, and what record formats add.
SUFFIX, CRC, HEADER_ESTIMATE, REQUEST_HEAD = 8, 4, 21, 21
MAX_U64 = "18446744073709551615BD"


def octets(column: str | Column) -> Column:
    return F.octet_length(column)


def varint_size(x: Column) -> Column:
    """Bytes of x, not negative, as an unsigned variable-length integer: seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def stored_value_size(value: Column, ttl: Column) -> Column:
    return F.coalesce(octets(value), F.lit(0)) + 1 + varint_size(ttl)


def value_log_size(key: Column, value: Column, ttl: Column) -> Column:
    """Meta byte, three variable-length integers, key with suffix, value, checksum."""
    k, v = octets(key) + SUFFIX, F.coalesce(octets(value), F.lit(0))
    return (1 + varint_size(k) + varint_size(v) + varint_size(ttl) + k + v + CRC).cast("long")


def wal_size(key: Column, value: Column, ttl: Column) -> Column:
    """As value_log_size: the meta byte is an integer of one byte there."""
    return value_log_size(key, value, ttl)


def wal_estimate(key: Column, value: Column) -> Column:
    return (octets(key) + SUFFIX + F.coalesce(octets(value), F.lit(0)) + 8 + CRC + HEADER_ESTIMATE).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)).cast("long")


def with_suffix(key: Column, version: Column) -> Column:
    """The stored form of a key, as hex: its bytes and 8 bytes that fall as the version rises."""
    inverted = F.expr(MAX_U64) - version.cast("decimal(20,0)")
    high = F.floor(inverted / F.lit(4294967296)).cast("long")
    low = (inverted - high.cast("decimal(20,0)") * F.lit(4294967296)).cast("long")
    return F.concat(F.hex(F.encode(key, "UTF-8")), F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))


def parsed_key(stored: Column) -> Column:
    return F.decode(F.unhex(F.substring(stored, F.lit(1), F.length(stored) - 2 * SUFFIX)), "UTF-8")


def parsed_version(stored: Column) -> Column:
    high = F.conv(F.substring(stored, F.length(stored) - 15, F.lit(8)), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(stored, F.length(stored) - 7, F.lit(8)), 16, 10).cast("decimal(20,0)")
    return (F.expr(MAX_U64) - high * F.lit(4294967296) - low).cast("long")


def file_name(fid: Column, kind: str) -> Column:
    return F.format_string(f"%05d.{kind}", fid)


def file_id(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)\.(?:sst|vlog|wal)$", 1).cast("long")


def next_power_of_two(x: Column) -> Column:
    """The least power of two that isn't less than x, for x of 1 or more."""
    return F.when(x <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1)).cast("int"))).cast("long")
