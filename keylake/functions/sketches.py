"""Hashes, checksums, Bloom filters and frequencies over columns.

Byte-exact hashes that Spark lacks are computed in numpy over Arrow batches, all rows of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash, the filter and the checksum.
SEED, MULTIPLIER = 0xBC9F1D34, 0xC6A4A793
LN2 = 0.69314718056
CASTAGNOLI = 0x82F63B78
COUNTER_MAX = 15

U32 = np.uint32


def _padded(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Values as rows of a zero-padded byte matrix, and their lengths."""
    lengths = np.array([len(v) for v in values], np.int64)
    width = int(lengths.max()) + 4 if len(values) else 4
    out = np.zeros((len(values), width - width % 4 + 4), np.uint8)
    for i, v in enumerate(values):
        out[i, : len(v)] = np.frombuffer(v, np.uint8)
    return out, lengths


#: Bytes of a padded matrix, or of one longer value.
MATRIX_BYTES = 1 << 24


def _by_length(values: list[bytes], f) -> np.ndarray:
    """f over groups of values of like length, so that a long value doesn't widen the matrix of short ones."""
    out = np.zeros(len(values), U32)
    order = sorted(range(len(values)), key=lambda i: len(values[i]))
    first = 0
    for at in range(1, len(order) + 1):
        longest = len(values[order[at]]) + 8 if at < len(order) else 0
        if at == len(order) or (at + 1 - first) * longest > MATRIX_BYTES or longest > 64 + 2 * len(values[order[first]]):
            out[order[first:at]] = f([values[i] for i in order[first:at]])
            first = at
    return out


def hash_bytes(values: list[bytes]) -> np.ndarray:
    """The 32-bit hash of each value: whole little-endian words first, then the bytes that are left, rows of like length side by side."""
    return _by_length(values, _hash_rows)


def _hash_rows(values: list[bytes]) -> np.ndarray:
    rows, n = _padded(values)
    words, m = rows.view("<u4"), U32(MULTIPLIER)
    with np.errstate(over="ignore"):
        h = U32(SEED) ^ (n.astype(U32) * m)
        whole = n // 4
        for j in range(int(whole.max())):
            on = whole > j
            step = (h[on] + words[on, j]) * m
            h[on] = step ^ (step >> U32(16))
        rest = n % 4
        on = np.flatnonzero(rest)
        if len(on):
            tail = words[on, whole[on]] & ((U32(1) << (8 * rest[on]).astype(U32)) - U32(1))
            step = (h[on] + tail) * m
            h[on] = step ^ (step >> U32(24))
    return h


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & 1, (t >> U32(1)) ^ U32(CASTAGNOLI), t >> U32(1))
    return t


_CRC = _crc_table()


def crc32c_bytes(values: list[bytes]) -> np.ndarray:
    return _by_length(values, _crc_rows)


def _crc_rows(values: list[bytes]) -> np.ndarray:
    rows, n = _padded(values)
    c = np.full(len(values), 0xFFFFFFFF, U32)
    for j in range(int(n.max())):
        on = n > j
        c[on] = _CRC[(c[on] ^ rows[on, j]) & U32(255)] ^ (c[on] >> U32(8))
    return ~c


def _bytes_of(s: pd.Series) -> list[bytes]:
    return [b"" if v is None else v if isinstance(v, bytes) else bytes(v) for v in s]


def _long_udf(f):
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(f(_bytes_of(s)).astype(np.int64))

    return run


def key_hash(column: str) -> Column:
    """The hash as a long from 0 to 2**32 - 1; null is hashed as empty."""
    return _long_udf(hash_bytes)(F.col(column).cast("binary"))


def crc32c(column: str) -> Column:
    return _long_udf(crc32c_bytes)(F.col(column).cast("binary"))


def bits_per_key(n: int, false_positives: float) -> int:
    return math.ceil(-math.log(false_positives) / LN2**2)


def filter_shape(n: int, per_key: int) -> tuple[int, int]:
    """Bits (whole bytes, 64 at least) and probes of a filter for n keys."""
    bits = max(64, n * per_key)
    return (bits + 7) // 8 * 8, min(30, max(1, int(per_key * 0.69)))


def probe_bits(h: Column, bits: int | Column, probes: int) -> Column:
    """The bits of a hashed key: steps by the hash turned 15 bits, modulo 2**32 and then the filter's bits. In Spark's own arithmetic."""
    word = F.lit(1 << 32).cast("long")
    turned = (h * (1 << 15)) % word + F.floor(h / (1 << 17))
    bits = bits if isinstance(bits, Column) else F.lit(bits).cast("long")
    return F.array(*[((h + j * turned) % word) % bits for j in range(probes)])


def bloom_bits(keys: DataFrame, column: str, n: int, per_key: int = 10) -> tuple[DataFrame, int, int]:
    """The set bits of a filter as a table, packed in words of 32: (word, mask), and the filter's bits and probes."""
    bits, probes = filter_shape(n, per_key)
    at = keys.select(key_hash(column).alias("h")).select(F.explode(probe_bits(F.col("h"), bits, probes)).alias("bit"))
    words = at.select(F.floor(F.col("bit") / 32).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int")).alias("mask"))
    return words.groupBy("word").agg(F.bit_or("mask").alias("mask")), bits, probes


def may_contain(rows: DataFrame, column: str, words: DataFrame, bits: int, probes: int) -> DataFrame:
    """rows with `maybe`: false only if the key can't be in the filter. Probes and filter words meet by an exchange; nothing that grows is broadcast."""
    keys = rows.select(column).distinct().withColumn("h", key_hash(column))
    probed = keys.select(column, F.explode(probe_bits(F.col("h"), bits, probes)).alias("bit")).withColumn("word", F.floor(F.col("bit") / 32))
    hit = F.call_function("shiftright", F.coalesce("mask", F.lit(0)), (F.col("bit") % 32).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    found = probed.join(words, "word", "left").groupBy(column).agg((F.min(hit) == 1).alias("maybe"))
    return rows.join(found, column)


def capped_frequency(log: DataFrame, key: str = "key", most: int = COUNTER_MAX) -> DataFrame:
    """How often each key occurs, exactly and as a four-bit counter that stays at its top; and the counter after it is halved."""
    n = F.count("*")
    return log.groupBy(key).agg(n.alias("n"), F.least(n, F.lit(most)).alias("counter")).withColumn("halved", F.call_function("shiftright", F.col("counter"), F.lit(1)))


def count_min(log: DataFrame, key: str = "key", counters: int = 1 << 16, rows: int = 4) -> DataFrame:
    """A count-min sketch as a table (row, cell, n): each key adds to one cell a row. The estimate of a key is its least cell."""
    cells = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(counters).cast("long")).alias("cell")) for i in range(rows)])
    counted = log.groupBy(key).agg(F.count("*").alias("n"))  # a hot key adds once
    return counted.select("n", F.inline(cells)).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def estimated(keys: DataFrame, sketch: DataFrame, key: str = "key", counters: int = 1 << 16, rows: int = 4) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(counters).cast("long")).alias("cell")) for i in range(rows)])
    return keys.select(key, F.inline(cells)).join(sketch, ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
