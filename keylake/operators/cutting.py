"""Greedy cutting of ordered rows into blocks, write buffers or log files.

A cut depends on all rows since the last one, which no window can express: the rows of one group (a table, a
log shard) are cut in its task. Groups are bounded by the table or shard size, which the caller sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_by_size(sizes: np.ndarray, limit: int, most: int | None = None, before: bool = True) -> np.ndarray:
    """The number of each row's piece. before: a row that would pass the limit opens a piece; else the row that passes it closes one."""
    out = np.zeros(len(sizes), np.int64)
    piece, total, count = 0, 0, 0
    for i, size in enumerate(sizes.tolist()):
        if before and count and (total + size > limit or most is not None and count >= most):
            piece, total, count = piece + 1, 0, 0
        out[i] = piece
        total, count = total + size, count + 1
        if not before and (total > limit or most is not None and count >= most):
            piece, total, count = piece + 1, 0, 0
    return out


def cut(rows: DataFrame, group: str, order: list[str], size: str, limit: int, most: int | None = None, before: bool = True) -> DataFrame:
    """group, seq, size and `piece` of all rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(piece=cut_by_size(pdf[size].to_numpy(), limit, most, before))[[group, "seq", size, "piece"]]

    cols = list(dict.fromkeys([group, *order, "seq", size]))
    return rows.select(*cols).groupBy(group).applyInPandas(run, f"{group} long, seq long, {size} long, piece long")


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def block_numbers(keys: list[str], values: np.ndarray, ttl_sizes: np.ndarray, block_bytes: int) -> tuple[list[int], list[int]]:
    """Per row its block, and the bytes it adds there: keys but a block's first store only what follows the prefix shared with the first."""
    blocks, added = [], []
    block, n, end, base = -1, 0, 0, ""
    for key, v, t in zip(keys, values.tolist(), ttl_sizes.tolist()):
        k = len(key.encode()) + 8
        if block < 0 or n and end + 6 + k + v + t + 1 + 4 * (n + 1) + 16 > block_bytes:
            block, n, end, base = block + 1, 0, 0, key
        kept = k if n == 0 else k - _shared(base, key)
        blocks.append(block)
        added.append(4 + kept + v + 1 + t)
        end, n = end + added[-1], n + 1
    return blocks, added


def blocks(rows: DataFrame, table: str, block_bytes: int) -> DataFrame:
    """table, block, n_rows, n_bytes (with the block's own index and checksum), first_key. rows: key, value_bytes, ttl_bytes, seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "seq"], kind="stable")
        b, a = block_numbers(pdf["key"].tolist(), pdf["value_bytes"].to_numpy(), pdf["ttl_bytes"].to_numpy(), block_bytes)
        out = pdf.assign(block=b, added=a).groupby("block", sort=True).agg(n_rows=("key", "size"), n_bytes=("added", "sum"), first_key=("key", "first")).reset_index()
        out["n_bytes"] += 4 * out["n_rows"] + 16
        return out.assign(**{table: pdf[table].iloc[0]})[[table, "block", "n_rows", "n_bytes", "first_key"]]

    return rows.select(table, "key", "seq", "value_bytes", "ttl_bytes").groupBy(table).applyInPandas(run, f"{table} long, block long, n_rows long, n_bytes long, first_key string")
