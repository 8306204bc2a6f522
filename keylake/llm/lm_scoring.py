"""Language-model scores of documents by stupid backoff, from n-gram counts of the whole corpus.

The score of a word is the relative frequency of its trigram after its bigram where the trigram is
known, else 0.4 times the score one order lower; a word unknown to the rest of the corpus counts as
1/N after all three backoffs. A document's own n-grams are taken off the counts before it is scored,
so that no document vouches for itself. Scores are sums of logarithms over a document's words.

The work is relational at the grain of blocks: documents are dealt to blocks of about `block_bytes` by a
hash; a block is exploded into its distinct n-gram hashes with counts, dealt out by ranges of the
hash ("parts"). Each part adds up its own slice of the count table and joins it to the n-grams that
the blocks asked for; the totals return to the blocks, where they are summed per document. Rows of
single n-grams would need about three times the shuffle, so a row holds a block's n-grams of one range.

A block asks at most `fan` ranges. If more parts than that are needed (beyond some 32 GB), the counts of
`fan` blocks are added up by range first, and each sum asks `fan` narrower ranges, and so on; totals
return the same way. So the rows exchanged are at most `fan` for each block and level, and grow with the
corpus, not with its square; a level more repeats the exchange of counts. A hot word or word pair is
one entry a block. No part or block grows with the corpus, only their numbers do.

Defined cases: words are runs of bytes other than ASCII white space, as written; a null or empty text has
no words and scores 0.0 with a mean of null; repeated rows are documents of their own, each scored, and
a row repeated very often is dealt to a block by each partition of the input;
an empty table gives an empty result; n-grams are compared by 64-bit hashes; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import batch_of, text_or_empty
from keylake.llm.words import window_hashes, word_hashes

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
PART_GRAMS = 1 << 21
#: Of a text's bytes, so many make up one n-gram of all orders: for the number of parts.
BYTES_PER_GRAM = 2
#: Ranges that a block asks: about 500 n-grams in each.
FAN = 8192

#: Texts gathered in a task before they are dealt out.
GATHER_BYTES = 16 << 20

BLOCKS = "block int, doc_ids array<long>, sizes binary, texts binary"
COUNTS = "block int, part long, n long, grams binary, counts binary"
TOTALS = "block int, part long, totals binary"
SCORES = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, n_unknown long, log_score double"


def _zip(a: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def _unzip(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _zip_counts(a: np.ndarray) -> bytes:
    """Counts, at the least width that holds the largest."""
    width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w - 1))
    return bytes([width]) + _zip(a.astype(f"<i{width}"), 3)


def _unzip_counts(raw: bytes) -> np.ndarray:
    return _unzip(raw[1:], f"<i{raw[0]}").astype(np.int64)


def packed_grams(sorted_hashes: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as differences, byte by byte of rising significance, so that the upper bytes compress away."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return _zip(steps.view(np.uint8).reshape(-1, 8).T)


def unpacked_grams(raw: bytes) -> np.ndarray:
    planes = _unzip(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def gathered(documents: DataFrame, blocks: int) -> DataFrame:
    """A block's documents in compressed lots: what a task has gathered of it in GATHER_BYTES of texts."""
    text = text_or_empty()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64("doc_id", text, F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block"))

    def gather(it):
        lots: dict[int, tuple[list, list]] = {}
        total = 0

        def lots_out():
            keys = list(lots)
            texts = [b"".join(lots[k][1]) for k in keys]
            sizes = [np.array([len(x) for x in lots[k][1]], np.int64) for k in keys]
            return batch_of({"block": (keys, pa.int32()), "doc_ids": ([lots[k][0] for k in keys], pa.list_(pa.int64())), "sizes": ([_zip(x) for x in sizes], pa.binary()), "texts": ([_zip(np.frombuffer(x, np.uint8), 6) for x in texts], pa.binary())})

        for b in it:
            for i, k, text in zip(b.column("doc_id").to_pylist(), b.column("block").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                lot = lots.setdefault(k, ([], []))
                lot[0].append(i)
                lot[1].append(text)
                total += len(text)
                if total >= GATHER_BYTES:
                    yield lots_out()
                    lots, total = {}, 0
        if lots:
            yield lots_out()

    return rows.mapInArrow(gather, BLOCKS)


class Grams:
    """The n-grams of some texts: per order, hashes and how many each text has."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.words, self.n_words = word_hashes(texts)
        self.orders = [window_hashes(self.words, self.n_words, k) for k in range(1, order + 1)]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([h for h, _ in self.orders]), return_counts=True)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the hash's upper half, so that parts in order hold sorted hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cut(block: int, hashes: np.ndarray, counts: np.ndarray, first: int, last: int, ranges: int) -> pa.Table:
    """Rows of a block's sorted n-grams, one for each of the ranges from first to last that has any."""
    edges = np.searchsorted(part_of(hashes, ranges), np.arange(first, last + 1))
    rows = [(block, first + p, b - a, packed_grams(hashes[a:b]), _zip_counts(counts[a:b])) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in COUNTS.split(", ")])


def asked(rows: DataFrame, ranges: int, order: int = ORDER) -> DataFrame:
    """What the blocks (of gathered) have: COUNTS, a row for each block and range."""

    def ask(table: pa.Table) -> pa.Table:
        hashes, counts = Grams(_bytes(table), order).distinct()
        return _cut(table.column("block")[0].as_py(), hashes, counts, 0, ranges, ranges)

    return rows.groupBy("block").applyInArrow(ask, COUNTS)


def _union(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of each row, and of all rows together with their counts added up."""
    each = [unpacked_grams(x) for x in table.column("grams").to_pylist()]
    every, at = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.concatenate([_unzip_counts(x) for x in table.column("counts").to_pylist()])
    return each, every, np.bincount(at, counts, len(every)).astype(np.int64)


def narrowed(rows: DataFrame, ranges: int, split: int) -> DataFrame:
    """COUNTS with the column up: rows of one range and `up` added up, and cut into `split` narrower ranges."""

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, hashes, counts = _union(table)
        return _cut(table.column("up")[0].as_py(), hashes, counts, part * split, (part + 1) * split, ranges * split)

    return rows.groupBy("up", "part").applyInArrow(add, COUNTS)


def _returned(own: pa.Table, totals: pa.Table) -> pa.Table:
    """Totals of the narrower ranges, given back to the rows that asked."""
    each, every, _ = _union(own)
    parts = sorted(zip(totals.column("part").to_pylist(), totals.column("totals").to_pylist()))
    found = np.concatenate([_unzip_counts(x) for _, x in parts])
    blobs = [_zip_counts(found[np.searchsorted(every, g)]) for g in each]
    return pa.Table.from_arrays([own.column("block"), own.column("part"), pa.array(blobs, pa.binary())], names=["block", "part", "totals"])


def totals_of(rows: DataFrame, ranges: int, parts: int, fan: int = FAN) -> DataFrame:
    """TOTALS over the corpus for each row of COUNTS, which are cut into `ranges`; sums are made in `parts` ranges at least."""
    if ranges >= parts:
        return rows.groupBy("part").applyInArrow(_added, TOTALS)
    split = min(fan, -(-parts // ranges))
    rows = rows.withColumn("up", F.floor(F.col("block") / fan).cast("int"))
    totals = totals_of(narrowed(rows, ranges, split), ranges * split, parts, fan)
    totals = totals.select(F.col("block").alias("up"), F.floor(F.col("part") / split).cast("long").alias("part"), F.col("part").alias("narrow"), "totals")

    def back(own: pa.Table, found: pa.Table) -> pa.Table:
        return _returned(own, pa.table({"part": found.column("narrow"), "totals": found.column("totals")}))

    return rows.groupBy("up", "part").cogroup(totals.groupBy("up", "part")).applyInArrow(back, TOTALS)


def _bytes(table: pa.Table) -> list[bytes]:
    out = []
    for sizes, texts in zip(table.column("sizes").to_pylist(), table.column("texts").to_pylist(), strict=True):
        ends, raw = np.cumsum(_unzip(sizes, np.int64)).tolist(), _unzip(texts, np.uint8).tobytes()
        out += [raw[a:b] for a, b in zip([0, *ends], ends)]
    return out


def _added(table: pa.Table) -> pa.Table:
    """One part: its slice of the count table, joined to what each block asked for."""
    grams = [unpacked_grams(x) for x in table.column("grams").to_pylist()]
    sizes = [len(g) for g in grams]
    counts = np.concatenate([_unzip_counts(x) for x in table.column("counts").to_pylist()])
    every = np.concatenate(grams)
    del grams
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    sums = np.add.reduceat(counts[order], first)
    totals = np.empty(len(every), np.int64)
    totals[order] = np.repeat(sums, np.diff(np.append(first, len(every))))
    blobs = [_zip_counts(x) for x in np.split(totals, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([table.column("block"), table.column("part"), pa.array(blobs, pa.binary())], names=["block", "part", "totals"])


def _of_others(grams: np.ndarray, n: np.ndarray, counts_of) -> np.ndarray:
    """For each n-gram of each text, how often the rest of the corpus has it. counts_of: sorted distinct hashes -> counts over the corpus."""
    if not len(grams):
        return np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")  # equal n-grams stay in the order of their texts
    g, d = grams[order], np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    total = np.repeat(counts_of(g[new]), np.diff(np.append(np.flatnonzero(new), len(g))))
    own = np.flatnonzero(new | np.concatenate(([True], d[1:] != d[:-1])))
    times = np.diff(np.append(own, len(g)))
    out = np.empty(len(g), np.int64)
    out[order] = total - np.repeat(times, times)
    return out


def score_texts(g: Grams, counts_of, corpus_words: int, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, words by the order that scored them (column 0: unknown), sum of log scores."""
    n, order = g.n_words, len(g.orders)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    left = [_of_others(h, k, counts_of) for h, k in g.orders]
    rest = np.maximum(corpus_words - n, 1)[doc].astype(np.float64)
    log = order * np.log(backoff) - np.log(rest)
    # Backing off starts at the highest order that a place has, so early words aren't punished for having no history.
    log -= np.maximum(order - 1 - place, 0) * np.log(backoff)
    by = np.zeros(len(doc), np.int64)
    for k in range(1, order + 1):
        at = np.flatnonzero(place >= k - 1)  # the k-gram that ends here
        known = left[k - 1] > 0
        at, count = at[known], left[k - 1][known]
        history = rest[at] if k == 1 else left[k - 2][_before(g.orders[k - 2][1])][known]
        log[at] = np.log(count / history) + np.maximum(np.minimum(order - 1, place[at]) - (k - 1), 0) * np.log(backoff)
        by[at] = k
    used = np.bincount(doc * (order + 1) + by, minlength=len(n) * (order + 1)).reshape(len(n), order + 1)
    return n, used, np.bincount(doc, log, minlength=len(n))


def _before(n: np.ndarray) -> np.ndarray:
    """Places of the (k-1)-grams with which k-grams begin: all but each text's last one."""
    last = np.cumsum(n)[n > 0] - 1
    keep = np.ones(int(n.sum()), bool)
    keep[last] = False
    return np.flatnonzero(keep)


def _scored(corpus_words: int, order: int, backoff: float):
    def score(lots: pa.Table, totals: pa.Table) -> pa.Table:
        g = Grams(_bytes(lots), order)
        hashes, _ = g.distinct()
        parts = sorted(zip(totals.column("part").to_pylist(), totals.column("totals").to_pylist()))
        counts = np.concatenate([np.zeros(0, np.int64), *[_unzip_counts(x) for _, x in parts]])
        if len(counts) != len(hashes):
            raise ValueError("the totals don't match the block's n-grams")
        n, used, log = score_texts(g, lambda h: counts[np.searchsorted(hashes, h)], corpus_words, backoff)
        ids = lots.column("doc_ids").combine_chunks().flatten()
        cols = [ids, n, used[:, 3], used[:, 2], used[:, 1], used[:, 0], log]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in SCORES.split(", ")])

    return score


def lm_scores(documents: DataFrame, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, words scored as trigram, bigram, unigram or unknown, log_score (sum) and mean_log_score of each document."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-size["bytes"] // block_bytes))
    parts = max(1, -(-size["bytes"] // (BYTES_PER_GRAM * part_grams)))
    rows = gathered(documents, blocks)
    ranges = min(parts, fan)
    totals = totals_of(asked(rows, ranges), ranges, parts, fan)
    out = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scored(size["words"], ORDER, backoff), SCORES)
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op1(spark: SparkSession, documents: DataFrame) -> DataFrame:
    out = lm_scores(documents)
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, w,
         lag(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS v,
         lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u
  FROM w
), own1 AS (SELECT doc_id, w, count(*) AS c FROM g GROUP BY ALL),
all1 AS (SELECT w, sum(c) AS c FROM own1 GROUP BY ALL),
own2 AS (SELECT doc_id, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY ALL),
all2 AS (SELECT v, w, sum(c) AS c FROM own2 GROUP BY ALL),
own3 AS (SELECT doc_id, u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY ALL),
all3 AS (SELECT u, v, w, sum(c) AS c FROM own3 GROUP BY ALL),
n AS (SELECT count(*) AS n FROM w),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY ALL),
c AS (
  SELECT g.doc_id, g.i, greatest(n.n - size.n, 1) AS rest,
         a1.c - o1.c AS c1, coalesce(a2.c - o2.c, 0) AS c2, coalesce(a3.c - o3.c, 0) AS c3,
         b1.c - p1.c AS h1, b2.c - p2.c AS h2
  FROM g JOIN size USING (doc_id) CROSS JOIN n
  JOIN own1 o1 ON o1.doc_id = g.doc_id AND o1.w = g.w JOIN all1 a1 ON a1.w = g.w
  LEFT JOIN own2 o2 ON o2.doc_id = g.doc_id AND o2.v = g.v AND o2.w = g.w LEFT JOIN all2 a2 ON a2.v = g.v AND a2.w = g.w
  LEFT JOIN own3 o3 ON o3.doc_id = g.doc_id AND o3.u = g.u AND o3.v = g.v AND o3.w = g.w LEFT JOIN all3 a3 ON a3.u = g.u AND a3.v = g.v AND a3.w = g.w
  LEFT JOIN own1 p1 ON p1.doc_id = g.doc_id AND p1.w = g.v LEFT JOIN all1 b1 ON b1.w = g.v
  LEFT JOIN own2 p2 ON p2.doc_id = g.doc_id AND p2.v = g.u AND p2.w = g.v LEFT JOIN all2 b2 ON b2.v = g.u AND b2.w = g.v
), s AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k,
         CASE WHEN c3 > 0 THEN ln(c3 / h2)
              WHEN c2 > 0 THEN ln(c2 / h1) + greatest(least(2, i - 1) - 1, 0) * ln(0.4)
              WHEN c1 > 0 THEN ln(c1 / rest) + least(2, i - 1) * ln(0.4)
              ELSE (1 + least(2, i - 1)) * ln(0.4) - ln(rest) END AS l
  FROM c
), t AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE k = 3) AS n3, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 0) AS n0, sum(l) AS l
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram, coalesce(n1, 0) AS n_unigram, coalesce(n0, 0) AS n_unknown,
       round(coalesce(l, 0), 4) AS log_score, round(l / n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN t USING (doc_id)
"""
