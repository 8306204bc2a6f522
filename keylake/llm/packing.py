"""Packing of tokenised documents into sequences: best-fit packing bettered by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens; their lengths, not their tokens, are packed.
Pieces are dealt to shards of about `shard_pieces`, each a bin-packing problem of its own. A shard has
`islands` populations; an individual is an assignment of pieces to bins, packed best-fit by falling length,
the lengths blurred; only the first of the first island isn't blurred, so that no result is worse than plain best-fit.
Crossover injects whole well-filled bins of one parent into the other, drops the bins that hold the same pieces,
breaks up badly filled ones, and places the displaced pieces best-fit, longest first. After each epoch an island
sends its elite to the next island, over a shuffle keyed by (shard, island). A population whose best individual
has as few bins as the total length allows is done, as nothing better exists.

Defined cases: a null or empty text is the closing token alone; a table of no rows gives no pieces; rows
that repeat are packed each; a document as long as the capacity or shorter is never cut; other columns
are ignored.
"""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import batch_of, shared_file, stored, text_or_empty
from keylake.llm.words import groups

CAPACITY = 2048
CLOSING_ID = 0
SHARD_PIECES = 4096
ISLANDS = 2
POPULATION = 5
EPOCHS = 3
GENERATIONS = 12
#: The greatest blur of a founder, as a share of the length.
BLUR = 0.3
CACHED = 1_000_000

PIECE = "deal long, doc_id long, piece int, start long, length long, ids_crc32 long"
ISLAND = "shard long, island int, lengths binary, population binary, capacity int"


class _WordIds(dict):
    """A word's ids as little-endian unsigned 32-bit bytes, kept for a bounded number of words."""

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)

    def ids_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are encoded each by itself, many in one call."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            e = self.tokenizer.encode([w.decode("utf-8", "surrogatepass") for w in some], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1))).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(some, ends, ends[1:]))
        return out


_words: dict[str, _WordIds] = {}


def _known(name: str, file) -> _WordIds:
    """The words that this worker knows of a tokenizer; file: its broadcast bytes."""
    if name not in _words:
        _words[name] = _WordIds(file.value)
    return _words[name]


def token_bytes(texts: list[str], known: _WordIds, closing: int | None = CLOSING_ID) -> list[bytes]:
    """Each text's ids and the closing id, as little-endian unsigned 32-bit bytes.

    The tokenizer turns white space into word ends before it splits, so words between ASCII white
    space have their ids whatever stands beside them. Words that aren't known yet are encoded once for all texts.
    """
    split = [text.encode().split() for text in texts]
    ids = known.ids_of(list(set().union(*split).difference(known)))
    end = b"" if closing is None else np.array([closing], "<u4").tobytes()
    if len(known) < CACHED:
        known.update(ids)
        return [b"".join(map(known.__getitem__, words)) + end for words in split]
    parts = (zip(words, map(known.get, words)) for words in split)
    return [b"".join([ids[w] if p is None else p for w, p in pairs]) + end for pairs in parts]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: deal (a running number that differs for all rows), doc_id, piece, start, length, ids_crc32."""

    file, name = shared_file(documents.sparkSession, tokenizer_path)

    def cut(it):
        number, known = TaskContext.get().partitionId() << 33, _known(name, file)
        for b in it:
            out = []
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lot in groups(texts):
                for doc_id, ids in zip(doc_ids[lot], token_bytes(texts[lot], known), strict=True):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((number, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                        number += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*out)) or [[]] * 6
            yield batch_of({f.split()[0]: (list(c), k) for f, c, k in zip(PIECE.split(", "), cols, kinds, strict=True)})

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(cut, PIECE)


class Packer:
    """Bin packing of one shard: an individual is an array with each piece's bin number, pieces sorted by falling length."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.random = random.Random(seed)
        self.bound = -(-int(self.lengths.sum()) // capacity)

    def best_fit(self, items: list[int], bins: np.ndarray, fills: list[int]) -> None:
        """Places items, in this order, each into the fullest bin that still has room; opens bins as needed."""
        room: dict[int, list[int]] = {}
        mask = 0
        for b, fill in enumerate(fills):
            if fill < self.capacity:
                room.setdefault(self.capacity - fill, []).append(b)
                mask |= 1 << (self.capacity - fill)
        lengths = self.lengths
        for i in items:
            n = int(lengths[i])
            fits = mask >> n
            if fits:
                free = n + (fits & -fits).bit_length() - 1
                holders = room[free]
                b = holders.pop()
                if not holders:
                    del room[free]
                    mask &= ~(1 << free)
            else:
                b, free = len(fills), self.capacity
                fills.append(0)
            bins[i] = b
            fills[b] += n
            if free > n:
                room.setdefault(free - n, []).append(b)
                mask |= 1 << (free - n)

    def first(self, noise: float) -> np.ndarray:
        """Best-fit by falling length, the lengths first blurred by up to `noise` of themselves."""
        blur = 1 + noise * np.array([self.random.random() for _ in self.lengths])
        order = np.argsort(-self.lengths * blur, kind="stable")
        bins = np.empty(len(self.lengths), np.int32)
        self.best_fit(order.tolist(), bins, [])
        return bins

    def score(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the mean square of the fill."""
        fill = np.bincount(bins, self.lengths)
        fill = fill[fill > 0]
        return -len(fill), float(np.mean((fill / self.capacity) ** 2)) if len(fill) else 0.0

    def cross(self, into: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """Injects well-filled bins of donor into a copy of `into`; what loses its bin is placed best-fit."""
        fill = np.bincount(donor, self.lengths)
        good = np.flatnonzero(fill >= 0.995 * self.capacity)
        share = self.random.uniform(0.02, 0.4)
        chosen = good[np.array([self.random.random() for _ in good]) < share] if len(good) else good
        flag = np.zeros(len(fill), bool)
        flag[chosen] = True
        given = flag[donor]
        hit = np.zeros(int(into.max()) + 1, bool)
        hit[into[given]] = True
        worst = np.bincount(into, self.lengths)
        hit |= worst < (1 - 10 ** -self.random.uniform(0.3, 3)) * self.capacity  # badly filled bins are broken up too
        displaced = hit[into] & ~given
        kept = ~hit[into] & ~given
        out = np.empty_like(into)
        names, out[given] = np.unique(donor[given], return_inverse=True)
        rest, inverse = np.unique(into[kept], return_inverse=True)
        out[kept] = inverse + len(names)
        settled = given | kept
        fills = np.bincount(out[settled], self.lengths[settled], len(names) + len(rest)).astype(np.int64).tolist() if settled.any() else []
        self.best_fit(np.flatnonzero(displaced).tolist(), out, fills)
        return out

    def evolve(self, population: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """Each generation's child of two parents replaces the worst, if better; best first."""
        scored = sorted(((self.score(p), p) for p in population), key=lambda x: x[0], reverse=True)
        for _ in range(generations):
            if -scored[0][0][0] <= self.bound:
                break
            a, b = (min(self.random.randrange(len(scored)) for _ in range(2)) for _ in range(2))
            child = self.cross(scored[a][1], scored[b][1] if a != b else scored[-1][1])
            s = self.score(child)
            if s > scored[-1][0] and all(s != x[0] for x in scored):
                scored[-1] = (s, child)
                scored.sort(key=lambda x: x[0], reverse=True)
        return [p for _, p in scored]


def _pack(population: list[np.ndarray]) -> bytes:
    return np.concatenate(population).astype("<i4").tobytes() if population else b""


def _unpack(raw: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(raw, "<i4")
    return [flat[i : i + n].copy() for i in range(0, len(flat), n)] if n else []


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "deal"], ascending=[False, True], kind="stable", ignore_index=True)


def _founded(capacity: int, islands: int, population: int):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, lengths = int(pdf["shard"].iloc[0]), _sorted(pdf)["length"].to_numpy()
        rows = []
        for island in range(islands):
            p = Packer(lengths, capacity, shard * 1009 + island)
            own = [p.first(BLUR * (k + 0.5 * (island % 2)) / population) for k in range(population)]
            rows.append((shard, island, lengths.astype("<i4").tobytes(), _pack(own), capacity))
        return pd.DataFrame(rows, columns=["shard", "island", "lengths", "population", "capacity"])

    return found


def _epoch(islands: int, population: int, generations: int, number: int, migrate: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island, capacity = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0]), int(pdf["capacity"].iloc[0])
        raw = pdf["lengths"].iloc[0]
        lengths = np.frombuffer(raw, "<i4")
        p = Packer(lengths, capacity, (shard * 1009 + island) * 31 + number)
        everyone = [x for part in pdf["population"] for x in _unpack(part, len(lengths))]
        everyone = sorted(everyone, key=p.score, reverse=True)[:population]
        out = p.evolve(everyone, generations)
        rows = [(shard, island, raw, _pack(out if migrate else out[:1]), capacity)]
        if migrate and islands > 1:
            rows.append((shard, (island + 1) % islands, raw, _pack(out[:1]), capacity))
        return pd.DataFrame(rows, columns=["shard", "island", "lengths", "population", "capacity"])

    return run


def _settled(own: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a shard with the best island's bins."""
    pdf = _sorted(own)
    lengths, capacity = pdf["length"].to_numpy(), int(best["capacity"].iloc[0])
    p = Packer(lengths, capacity, 0)
    bins = max((x for part in best["population"] for x in _unpack(part, len(lengths))), key=p.score)
    pdf["sequence_id"] = (pdf["shard"].to_numpy(np.int64) << 32) + bins
    order = np.lexsort((np.arange(len(bins)), bins))
    run = np.cumsum(lengths[order]) - lengths[order]
    start = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
    run -= np.maximum.accumulate(np.where(start, run, 0))
    pdf.loc[order, "offset"] = run
    pdf["offset"] = pdf["offset"].astype("int64")
    return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "deal"]]


def packed(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """items (of pieces(), stored) with sequence_id and offset."""
    n_shards = max(1, -(-items.count() // shard_pieces))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(n_shards).cast("long")))
    state = dealt.groupBy("shard").applyInPandas(_founded(capacity, islands, population), ISLAND)
    for k in range(epochs):
        state = state.groupBy("shard", "island").applyInPandas(_epoch(islands, population, generations, k, k < epochs - 1), ISLAND)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, deal long"
    return dealt.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(_settled, schema)


def op8(spark: SparkSession, documents: DataFrame, tokenizer_path: str) -> DataFrame:
    return packed(stored(pieces(documents, tokenizer_path))).drop("deal")
