"""Document fingerprints: one-permutation MinHash with optimal densification, in packed b-bit form.

Each shingle is hashed once; the hash's place among `bins` equal intervals is its bin, and a bin keeps
its smallest hash. An empty bin takes over the value of a full bin that a hash of (bin, attempt)
picks. The low `bits` bits of all bins are packed and written as hex. The likeness of two fingerprints
is their share of equal values, corrected for values that agree by chance (2**-bits).

Defined cases: a null or empty text has one empty shingle; a text of less than five words is one
shingle; rows are ordered by doc_id (null first) and then a hash of the text, so repeated rows are
neighbours; a single row is its own next document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.llm.common import WORDS_PER_SHINGLE, batch_of, stored, text_or_empty
from keylake.llm.words import groups, mixed, shingles

BINS = 512
BITS = 4


def _picks(bins: int, first: int, attempts: int) -> np.ndarray:
    """The bins that empty bin i asks in attempts first, first + 1, ...: a row for each bin."""
    i, a = np.arange(bins, dtype=np.uint64)[:, None], np.arange(first, first + attempts, dtype=np.uint64)[None, :]
    return (mixed((i << np.uint64(32)) + a + np.uint64(0x1234567)) % np.uint64(bins)).astype(np.int32)


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WORDS_PER_SHINGLE):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.width = bins, bits, width
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self._tables: list[np.ndarray] = []

    def _attempt(self, k: int) -> np.ndarray:
        """Which bin each bin asks at attempt k."""
        if k >= 4096:
            return _picks(self.bins, k, 1)[:, 0]
        while len(self._tables) * 64 <= k:
            self._tables.append(_picks(self.bins, len(self._tables) * 64, 64))
        return self._tables[k // 64][:, k % 64]

    def values(self, texts: list[bytes]) -> np.ndarray:
        """The low bits of each bin, a row of bytes for each text."""
        if not texts:
            return np.zeros((0, self.bins), np.uint8)
        return np.concatenate([self._values(texts[g]) for g in groups(texts)])

    def _values(self, texts: list[bytes]) -> np.ndarray:
        h, counts = shingles(texts, self.width)
        doc = np.repeat(np.arange(len(texts)), counts)
        least = np.full(len(texts) * self.bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, doc * self.bins + (h >> self.shift).astype(np.int64), h)
        full = np.zeros(len(least), bool)
        full[doc * self.bins + (h >> self.shift).astype(np.int64)] = True
        low = (mixed(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        out = low.copy()
        empty, k = np.flatnonzero(~full).astype(np.int32), 0
        own = empty & np.int32(self.bins - 1)
        text = empty - own
        while len(own):
            ask = text + self._attempt(k)[own]
            hit = full[ask]
            out[text[hit] + own[hit]] = low[ask[hit]]
            miss = ~hit
            text, own, k = text[miss], own[miss], k + 1
        return out.reshape(len(texts), self.bins)

    def packed(self, values: np.ndarray) -> str:
        per = 8 // self.bits
        out = np.zeros(self.bins // per, np.uint8)
        for k in range(per):
            out |= values[k::per] << np.uint8(k * self.bits)
        return out.tobytes().hex()

    def unpacked(self, fingerprint: str) -> np.ndarray:
        raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
        return np.stack([raw >> np.uint8(k * self.bits) & np.uint8((1 << self.bits) - 1) for k in range(8 // self.bits)], axis=1).reshape(-1)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / self.bins - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = {"kind": pa.int32(), "part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "text": pa.string()}
SCHEMA = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
#: Rows of the stored table: a document with its following one; the first and the last of a partition, with their texts.
DONE, HEAD, TAIL = 0, 1, 2


def _compared(f: Fingerprinter, ids: list, texts: list[str], own: np.ndarray, following: list[str], after: np.ndarray) -> list[list]:
    new = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    other = f.values(new)
    return [[i, len(t), hashlib.sha256(n).hexdigest(), f.packed(a), f.packed(b), f.likeness(a, b), f.likeness(a, c)] for i, t, n, a, b, c in zip(ids, texts, new, own, other, after, strict=True)]


def with_following(documents: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """Each document compared with its edited text and with the next document by doc_id.

    The texts are range-partitioned by doc_id once; within a partition each meets its successor. The
    first and last texts of the partitions are stored with the results and joined by partition number.
    """
    f = Fingerprinter(bins, bits, width)
    text = text_or_empty()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def compare(it):
        part, last = TaskContext.get().partitionId(), None
        for b in it:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            if not ids:
                continue
            own = f.values([x.encode() for x in texts])
            if last is None:
                yield _batch([[HEAD, part, *[None] * 7, texts[0]]])
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
            if len(ids) > 1:
                yield _batch([[DONE, part, *x, None] for x in _compared(f, ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:])])
            last = ids[-1], texts[-1], own[-1:]
        if last is not None:
            yield _batch([[TAIL, part, last[0], *[None] * 6, last[1]]])

    table = stored(ordered.mapInArrow(compare, SCHEMA))
    tails = table.filter(F.col("kind") == TAIL).select("part", "doc_id", F.col("text").alias("own"))
    heads = table.filter(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    # One row a partition: which partition with rows comes next; after the last, the first.
    parts = tails.select("part")
    order = parts.select("part", F.lead("part").over(W.orderBy("part")).alias("later"), F.min("part").over(W.orderBy("part")).alias("first"))
    pairs = tails.join(order.select("part", F.coalesce("later", "first").alias("next_part")), "part").join(heads, "next_part")

    def compare_pairs(it):
        for b in it:
            parts, ids, texts, following = (b.column(c).to_pylist() for c in ("part", "doc_id", "own", "following"))
            if ids:
                own, after = f.values([x.encode() for x in texts]), f.values([x.encode() for x in following])
                yield _batch([[DONE, p, *x, None] for p, x in zip(parts, _compared(f, ids, texts, own, following, after), strict=True)])

    rest = pairs.select("part", "doc_id", "own", "following").mapInArrow(compare_pairs, SCHEMA)
    return table.filter(F.col("kind") == DONE).unionByName(rest).drop("kind", "part", "text")


def _batch(rows: list[list]) -> pa.RecordBatch:
    return batch_of({name: (list(col), kind) for (name, kind), col in zip(FIELDS.items(), zip(*rows), strict=True)})


def op7(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return with_following(documents)
