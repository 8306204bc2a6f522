"""Near-duplicate documents by DartMinHash signatures of word shingles, banded joining and exact checks.

A text is the multiset of its word shingles: an element's weight is how often it occurs. The weight axis
of an element is cut into regions of weight 1; darts fall on region x rank like a Poisson process whose
randomness is a hash of the element, so that equal regions get equal darts in every text. A text throws
only the darts below a rank at which it has about `DARTS` in all, each dart hits one of `coordinates`,
and the earliest per coordinate is the signature: two texts agree at a coordinate with a chance that is
their weighted Jaccard similarity. Texts with a coordinate not hit throw on to a higher rank.

Signatures are cut into bands, and texts with an equal band are candidates. Equal texts are one node from the
start. Each bucket's nodes are first held against one node of it, and then, where a bucket still has nodes
of different components, against a hub that overlapping buckets share, and against the node next to the centre of
the hub's group. What these leave open is settled without loss by what nodes add to the centre's shingles and lack
of them (see `postings`): two nodes not linked yet can only be linked if they share enough of these differences, so
only the rarest of them are indexed, and a pair comes up only where its places in both lists leave room for enough. A group of any size costs a few
comparisons a node, and no candidate pair of different components stays unchecked. A pair is linked if
the weighted Jaccard similarity of its shingles, compared by 40-bit hashes, is `near` or more. Classes are the
connected components, grown by label propagation over what is not merged yet.

Hot hubs: the shingles of a hub with many nodes are repeated for every `SLOT_NODES` of them, so its comparisons
are dealt over many tasks; differences are dealt by (hub, shingle) or (hub, node); joins on labels are
plain exchanges of stored tables, which Spark's adaptive execution splits where one key is hot.

Defined cases: a text of fewer words than a shingle is one shingle of all its words; null, empty and blank
texts are equal; texts that differ in ASCII white space alone are equal; rows with a null doc_id take part
as others, but another id represents their class if there is one; repeated rows share a class; an empty table
gives an empty result; other columns are ignored by near_classes and kept by deduplicated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.llm.common import NEAR, WORDS_PER_SHINGLE, batch_of, slices, stored, text_or_empty
from keylake.llm.words import groups, mixed, shingle_hashes, word_hashes

COORDINATES = 128
BANDS = 32
DARTS = 1200
#: So many nodes share one copy of their hub's shingles.
SLOT_NODES = 512

U = np.uint64
#: Rank cells below 1; from there on cells have length 1.
_FINE = [0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0]


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson variable."""
    return np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(24)])


_CDF = {a: _poisson(b - a) for a, b in zip(_FINE, _FINE[1:])} | {1.0: _poisson(1.0)}


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def _darts(regions: np.ndarray, start, length: float, cdf: np.ndarray):
    """Of regions (hashes of region and cell): which has a dart, the darts' ranks and hashes."""
    n = np.searchsorted(cdf, _uniform(regions), side="right")
    which, ranks, hashes = [], [], []
    for k in range(int(n.max()) if len(n) else 0):
        at = np.flatnonzero(n > k)
        h = mixed(regions[at] + U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        which.append(at)
        ranks.append((start[at] if isinstance(start, np.ndarray) else start) + length * _uniform(h))
        hashes.append(h)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(which, np.int64), cat(ranks, np.float64), cat(hashes, U)


def _thrown(region: np.ndarray, doc: np.ndarray, share: np.ndarray, top: np.ndarray):
    """All darts of the regions below each document's top rank: document, rank, hash. share: how much of a region's unit of weight is filled."""
    found = []
    limit = top[doc]
    for c, (a, b) in enumerate(zip(_FINE, _FINE[1:])):
        at = np.flatnonzero(limit > a)
        which, rank, h = _darts(mixed(region[at] + U(0xD1B54A32D192ED03 * (c + 1) & (1 << 64) - 1)), a, b - a, _CDF[a])
        found.append((at[which], rank, h))
    cells = np.maximum(np.ceil(limit - 1), 0).astype(np.int64)
    at = np.repeat(np.arange(len(region)), cells)
    k = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + 1
    which, rank, h = _darts(mixed(mixed(region[at] + U(0x8CB92BA72F3D8DD7)) + k.astype(U)), k.astype(np.float64), 1.0, _CDF[1.0])
    found.append((at[which], rank, h))
    at, rank, h = (np.concatenate(x) for x in zip(*found))
    keep = rank < limit[at]
    if (share < 1).any():
        keep &= _uniform(mixed(h ^ U(0xA0761D6478BD642F))) < share[at]
    return doc[at[keep]], rank[keep], h[keep]


def dart_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, coordinates: int = COORDINATES, darts: int = DARTS) -> np.ndarray:
    """Signatures (n_docs x coordinates) of weighted sets: elements are hashes, weights positive, doc says whose they are; each document has one at least."""
    layers = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    region = mixed(elements[at] + layer.astype(U) * U(0xE7037ED1A0B428DB))
    share = np.minimum(weights[at] - layer, 1.0)
    whose = doc[at]
    total = np.bincount(doc, weights, n_docs)
    out = np.zeros((n_docs, coordinates), U)
    open_docs, factor = np.arange(n_docs), 1.0
    while len(open_docs):
        number = np.full(n_docs, -1)
        number[open_docs] = np.arange(len(open_docs))
        mine = np.flatnonzero(number[whose] >= 0)
        d, rank, h = _thrown(region[mine], number[whose[mine]], share[mine], factor * darts / total[open_docs])
        slot = d * coordinates + (mixed(h + U(0x589965CC75374CC3)) % U(coordinates)).astype(np.int64)
        first = np.full(len(open_docs) * coordinates, np.inf)
        np.minimum.at(first, slot, rank)
        value = np.zeros(len(first), U)
        won = rank == first[slot]
        value[slot[won]] = h[won]
        full = np.isfinite(first).reshape(-1, coordinates).all(axis=1)
        out[open_docs[full]] = value.reshape(-1, coordinates)[full]
        open_docs, factor = open_docs[~full], factor * 2
    return out


def bands_of(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band."""
    n, coordinates = signatures.shape
    cut = signatures.reshape(n, bands, coordinates // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x2545F4914F6CDD1D), (n, bands)).copy()
    for k in range(cut.shape[2]):
        key = mixed(key ^ cut[:, :, k]) + U(0x9E3779B97F4A7C15)
    return key


def weighted_shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts with how often each occurs: hashes, weights, text number."""
    h, n = shingle_hashes(words, counts, width)
    doc = np.repeat(np.arange(len(counts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    return h[first], np.diff(np.append(first, len(h))), doc[first]


def _nodes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    each = mixed(words ^ mixed(place.astype(U) + U(0x1F83D9ABFB41BD6B)))
    total = np.concatenate(([U(0)], np.cumsum(each, dtype=U)))
    ends = np.cumsum(counts)
    return mixed(total[ends] - total[ends - counts] + counts.astype(U))


def keyed(documents: DataFrame) -> DataFrame:
    text = text_or_empty()
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def signed(rows: DataFrame, bands: int = BANDS, coordinates: int = COORDINATES, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, t, node (hash of the text's words) and band keys of rows (of keyed)."""

    def sign(it):
        for b in it:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            nodes, keys = [np.zeros(0, U)], [np.zeros((0, bands), U)]
            for g in groups(texts):
                words, counts = word_hashes(texts[g])
                nodes.append(_nodes(words, counts))
                h, weight, doc = weighted_shingles(words, counts, width)
                keys.append(bands_of(dart_minhash(h, weight.astype(np.float64), doc, len(counts), coordinates), bands))
            node, key = np.concatenate(nodes).view(np.int64), np.concatenate(keys).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.ravel()))
            yield batch_of({"doc_id": (b.column("doc_id"), None), "t": (b.column("t"), None), "node": (pa.array(node), None), "bands": (lists, None)})

    return rows.mapInArrow(sign, "doc_id long, t long, node long, bands array<long>")


def _units(words: np.ndarray, counts: np.ndarray, width: int) -> list[bytes]:
    """Each text's shingle occurrences as sorted distinct 40-bit hashes of (shingle, how often before), five bytes each."""
    h, weight, doc = weighted_shingles(words, counts, width)
    at = np.repeat(np.arange(len(h)), weight)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    unit = mixed(h[at] + layer.astype(U) * U(0xE7037ED1A0B428DB)) >> U(24)
    d = doc[at]
    order = np.lexsort((unit, d))
    unit, d = unit[order], d[order]
    first = np.concatenate(([True], (unit[1:] != unit[:-1]) | (d[1:] != d[:-1])))
    unit, d = unit[first], d[first]
    raw = np.ascontiguousarray(unit.view(np.uint8).reshape(-1, 8)[:, :5])
    ends = np.searchsorted(d, np.arange(len(counts) + 1))
    return [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def _unit_hashes(raw: bytes) -> np.ndarray:
    five = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view(U).ravel()


def shingled(rows: DataFrame, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """node, units and their number, of rows (of keyed)."""

    def cut(it):
        for b in it:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            nodes, units = [np.zeros(0, U)], []
            for g in groups(texts):
                words, counts = word_hashes(texts[g])
                nodes.append(_nodes(words, counts))
                units += _units(words, counts, width)
            size = [len(u) // 5 for u in units]
            yield batch_of({"node": (pa.array(np.concatenate(nodes).view(np.int64)), None), "units": (units, pa.binary()), "size": (size, pa.int64())})

    return rows.mapInArrow(cut, "node long, units binary, size long")


def linked(pairs: DataFrame, shingles: DataFrame, near: float = NEAR) -> DataFrame:
    """The pairs (a, b), stored, whose similarity is near or more. shingles: node, units, size, one row a node."""
    s = shingles.alias("s")
    with_a = pairs.join(s, F.col("a") == F.col("s.node")).select("a", "b", F.col("s.units").alias("ua"))
    both = with_a.join(s, F.col("b") == F.col("s.node")).select("a", "b", "ua", F.col("s.units").alias("ub"))

    def check(it):
        last, ub = None, None
        for batch in slices(it):
            out: tuple[list, list] = ([], [])
            for a, b, ra, rb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != last:
                    last, ub = b, _unit_hashes(rb)
                small, large = sorted((len(ra) // 5, len(ub)))
                if small < near * large:
                    continue
                common = len(np.intersect1d(_unit_hashes(ra), ub, assume_unique=True))
                if common >= near * (small + large - common):
                    out[0].append(a)
                    out[1].append(b)
            yield batch_of({"a": (out[0], pa.int64()), "b": (out[1], pa.int64())})

    return both.mapInArrow(check, "a long, b long")


DIFFERENCES = "node long, hub long, slot int, members long, hub_size long, added array<long>, lacks array<long>"


def differences(groups: DataFrame, shingles: DataFrame) -> DataFrame:
    """Of groups (hub, node; hubs are nodes of their groups): how many members the group has, what the node adds to the hub's units and lacks of them. A hub has a slot for about every SLOT_NODES members."""
    of_group = stored(groups.groupBy("hub").agg(F.count("*").alias("members")))
    slotted = groups.join(of_group, "hub").select("hub", "node", "members", F.pmod(F.xxhash64("node"), slots()).cast("int").alias("slot"))
    hubs = of_group.join(shingles.select(F.col("node").alias("hub"), F.col("units").alias("uc")), "hub")
    both = by_hub(slotted.join(shingles.select("node", "units"), "node"), hubs).select("node", "hub", "slot", "members", "units", "uc")

    def compare(it):
        for batch in slices(it):
            out: list[list] = [[], [], []]
            for ra, rc in zip(batch.column("units").to_pylist(), batch.column("uc").to_pylist(), strict=True):
                a, c = _unit_hashes(ra), _unit_hashes(rc)
                added, lacks = np.setdiff1d(a, c, assume_unique=True), np.setdiff1d(c, a, assume_unique=True)
                for x, v in zip(out, (len(c), added.view(np.int64), lacks.view(np.int64)), strict=True):
                    x.append(v)
            yield batch_of({n: (batch.column(n), None) for n in ("node", "hub", "slot", "members")} | {"hub_size": (out[0], pa.int64()), "added": (out[1], pa.list_(pa.int64())), "lacks": (out[2], pa.list_(pa.int64()))})

    return both.mapInArrow(compare, DIFFERENCES)


def slots():
    return F.floor(F.col("members") / SLOT_NODES).cast("int") + 1


def by_hub(rows: DataFrame, of_hub: DataFrame) -> DataFrame:
    """rows (hub, slot, ...) joined with of_hub (hub, members, ...), whose rows are repeated for each slot: a hub's nodes are dealt over its slots."""
    return rows.join(of_hub.withColumn("slot", F.explode(F.sequence(F.lit(0), slots() - 1))).drop("members"), ["hub", "slot"])


def is_linked(near: float = NEAR):
    """Whether a row of differences is near its hub."""
    common = F.col("hub_size") - F.size("lacks")
    return common >= near * (F.col("hub_size") + F.size("added"))


def centred(d: DataFrame, near: float = NEAR) -> DataFrame:
    """Differences from the group's centre instead of its hub: the centre has the units that more than half of the group have.

    Each row gets n_added, n_lacks, delta (how much larger than the centre it is), cost (n_lacks + near * n_added), and excess:
    cost less the cost at which a text is as near as `near` to the centre.
    """
    n = d.groupBy("hub").agg(F.max("members").alias("members"))
    each = d.select("hub", "members", F.lit("+").alias("kind"), F.explode("added").alias("unit")).unionByName(d.select("hub", "members", F.lit("-").alias("kind"), F.explode("lacks").alias("unit")))
    often = each.groupBy("hub", "kind", "unit").agg(F.count("*").alias("seen"), F.max("members").alias("members")).filter("2 * seen > members")
    # At most twice what a node of the group differs by on average.
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("unit")))
    none = F.array().cast("array<long>")
    flips = n.join(often.groupBy("hub").agg(of("+").alias("in_"), of("-").alias("out_")), "hub", "left").select("hub", "members", F.coalesce("in_", none).alias("in_"), F.coalesce("out_", none).alias("out_"))
    new = lambda mine, gone, other, back: F.concat(F.array_except(mine, gone), F.array_except(back, other))
    rows = by_hub(d, flips).select("hub", "slot", "members", "node", (F.col("hub_size") + F.size("in_") - F.size("out_")).alias("size"), new("added", "in_", "lacks", "out_").alias("added"), new("lacks", "out_", "added", "in_").alias("lacks"))
    rows = rows.withColumns({"n_added": F.size("added"), "n_lacks": F.size("lacks")})
    rows = rows.withColumns({"delta": F.col("n_added") - F.col("n_lacks"), "cost": F.col("n_lacks") + near * F.col("n_added")})
    return rows.withColumn("excess", F.col("cost") - (1 - near) * F.col("size"))


def _up(x):
    """The integer at x or above, forgiving the rounding of floats."""
    return F.ceil(x - 1e-6)


def postings(rows: DataFrame, of_hub: DataFrame, labels: DataFrame, near: float = NEAR) -> DataFrame:
    """The differences by which nodes of different labels can be linked: hub, kind, unit, node, label, and what `candidates` asks of them.

    rows: of centred; of_hub: hub, members, least (the smallest cost of the group), most (how much smaller than
    the centre its smallest node is), and the label of the node with the smallest cost, with which all others have been compared.

    Let y lack A of the units of the group's centre c and add B, z lack A' and add B', and let them share r of what they
    lack and s of what they add. With E = A + near B, E' alike, they are linked if and only if

        (1 + near) (r + s) >= E + E' - (1 - near) |c|.

    With the excess x = E - (1 - near) |c| and r <= A' and r <= A, that needs (1 + near) s >= x + near (B' - A') and
    (1 + near) s >= x' + near (B - A). So either s is at least 1 and that much (kind +), or s is 0, neither of the two
    bounds is positive, and r is (x + E') / (1 + near) or more (kind -). It can't be that r and s are 0: one of the two isn't
    linked to the node of least cost, but would be, as E + least <= E + E' <= (1 - near) |c|. That one, y, asks; x > -least.
    An overlap of k or more with a list of n shows among its n - k + 1 rarest units: only these are kept, with their
    places in the list. Units that only one label has come first in every list, and aren't rows.
    """
    at_hub = by_hub(rows, of_hub).join(labels, "node").withColumn("asks", F.col("label") != F.col("centre_label"))
    bound = F.col("excess") - near * F.greatest("most", F.lit(0))
    at_hub = at_hub.withColumn("minus_asks", F.col("asks") & (bound <= 1e-6)).withColumn("minus_asked", near * F.col("delta") <= F.col("least") + 1e-6)
    need = lambda x: F.greatest(F.lit(1), _up(x)).cast("int")
    same = ["hub", "node", "label", "delta", "cost", "excess"]
    # Least overlaps, as far as one node tells: of the one that asks, and of the one that is asked.
    plus = at_hub.select(*same, F.col("asks").alias("loose"), "asks", F.lit(True).alias("asked"), F.lit("+").alias("kind"), F.col("n_added").alias("n"), need(bound / (1 + near)).alias("ask_need"), need((near * F.col("delta") - F.col("least")) / (1 + near)).alias("asked_need"), F.explode("added").alias("unit"))
    minus = at_hub.filter("minus_asks or minus_asked").select(*same, F.col("asks").alias("loose"), F.col("minus_asks").alias("asks"), F.col("minus_asked").alias("asked"), F.lit("-").alias("kind"), F.col("n_lacks").alias("n"), need((F.col("excess") + F.greatest(F.col("least"), F.col("excess") / near)) / (1 + near)).alias("ask_need"), need((F.col("cost") - F.col("least")) / (1 + near)).alias("asked_need"), F.explode("lacks").alias("unit"))
    every = plus.unionByName(minus)
    key = ["hub", "kind", "unit"]
    seen = every.groupBy(*key).agg(F.count("*").alias("seen"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("asks").alias("some")).filter("x <> y and some").select(*key, "seen")
    kept = every.join(seen, key)
    own = W.partitionBy("hub", "node", "kind")  # at most a text's shingles
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("seen", "unit")) - 1
    kept = kept.withColumn("left", F.col("n") - at)
    kept = kept.withColumns({"asks": F.col("asks") & (F.col("left") >= F.col("ask_need")), "asked": F.col("asked") & (F.col("left") >= F.col("asked_need"))})
    return kept.filter("asks or asked").select(*key, "node", "label", *ROLES)


#: What candidates need to know of a node.
ROLES = ["delta", "cost", "excess", "left", "loose", "asks", "asked"]


def candidates(rows: DataFrame, others: DataFrame, near: float = NEAR) -> DataFrame:
    """Pairs (a, b) of nodes of different labels, one from each of two tables of postings, that can be linked as far as lists and places tell."""
    y, z = rows.alias("y"), others.alias("z")
    of = lambda c: (F.col(f"y.{c}"), F.col(f"z.{c}"))
    (dy, dz), (xy, xz), (ly, lz), (n, m) = of("delta"), of("excess"), of("left"), of("node")
    by_added = F.greatest(xy + near * dz, xz + near * dy)
    by_kind = F.when(F.col("y.kind") == "+", by_added).otherwise(xy + F.col("z.cost"))
    fits = (F.col("y.kind") == "+") | (by_added <= 1e-6)
    same = (F.col("y.hub") == F.col("z.hub")) & (F.col("y.kind") == F.col("z.kind")) & (F.col("y.unit") == F.col("z.unit"))
    # Of two that could ask the one with the greater excess does.
    first = F.col("y.asks") & F.col("z.asked") & (~F.col("z.loose") | (xy > xz) | ((xy == xz) & (n > m)))
    enough = F.least(ly, lz) >= F.greatest(F.lit(1), _up(by_kind / (1 + near)))
    met = y.join(z, same & (F.col("y.label") != F.col("z.label")) & first & fits & enough)
    return met.select(F.greatest(n, m).alias("a"), F.least(n, m).alias("b")).distinct()


def stars(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """Candidates of each posting list's nodes with the one of least excess: families of many nodes, far from their hub, are linked by it."""
    key = ["hub", "kind", "unit"]
    centre = rows.groupBy(*key).agg(F.min_by(F.struct("node", "label", *ROLES), F.struct("excess", "node")).alias("c")).select(*key, "c.*")
    return candidates(rows, centre, near)


def _hubs(buckets: DataFrame) -> DataFrame:
    """Each bucket's node of the greatest weight."""
    return buckets.groupBy("key").agg(F.max(F.struct("w", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))


def _far_hubs(buckets: DataFrame) -> DataFrame:
    """Each bucket's hub, taken from all bucket mates of its nodes: buckets that overlap mostly get the same one."""
    top = buckets.groupBy("key").agg(F.max(F.struct("w", "node")).alias("h"))
    best = buckets.join(top, "key").groupBy("node").agg(F.max("h").alias("h"))
    return buckets.select("key", "node").join(best, "node").groupBy("key").agg(F.max("h").alias("h")).select("key", F.col("h.node").alias("hub"))


def collapsed(buckets: DataFrame) -> DataFrame:
    """Of buckets (key, node) with the same nodes one, named by its nodes."""
    h = F.xxhash64("node")
    name = buckets.groupBy("key").agg(F.xxhash64(F.bit_xor(h), F.sum(F.shiftright(h, 20)), F.count("*")).alias("name"))
    return buckets.join(name, "key").select(F.col("name").alias("key"), "node").distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """Keys whose nodes have different labels."""
    return rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b), stored: label is the smallest node of its component."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        l, g = labels.alias("l"), labels.alias("g")
        # The smallest label next to each node, and then that label's own label.
        beside = both.join(l, F.col("b") == F.col("l.node")).groupBy("a").agg(F.min("label").alias("m"))
        best = labels.join(beside, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("best"))
        new = stored(best.join(g, F.col("best") == F.col("g.node")).select(best["node"], "old", F.col("g.label").alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose nodes have different labels, with these as x and y."""
    a, b = (labels.select(F.col("node").alias(n), F.col("label").alias(m)) for n, m in (("a", "x"), ("b", "y")))
    return pairs.distinct().join(a, "a").join(b, "b").filter("x <> y")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label), stored, after new edges (a, b): only edges between different labels are looked at."""
    between = stored(apart(edges, labels).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if between.isEmpty():
        return labels
    of_label = components(between).withColumnRenamed("node", "was").withColumnRenamed("label", "now")
    return stored(labels.join(of_label, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")))


def classes_of(buckets: DataFrame, shingles: DataFrame, near: float = NEAR) -> DataFrame:
    """node and label: components of the links among nodes that share a bucket. buckets: key, node, w (how many mates, for the choice of hubs)."""
    labels = stored(buckets.select("node", F.col("node").alias("label")).distinct())
    around = buckets.join(_hubs(buckets), "key").filter("node <> hub")
    pairs = stored(around.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())
    labels = merged(labels, linked(pairs, shingles, near))
    known = buckets.join(labels, "node")
    left = stored(known.join(_mixed(known), "key", "left_semi").select("key", "node", "w"))
    if left.isEmpty():
        return labels
    hubs = _far_hubs(left)
    groups = left.join(hubs, "key").select("hub", "node").unionByName(hubs.select("hub", F.col("hub").alias("node")))
    d = stored(differences(stored(groups.distinct()), shingles))
    labels = merged(labels, d.filter(is_linked(near) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    rows = stored(centred(d, near))
    of_hub = stored(rows.groupBy("hub").agg(F.max("members").alias("members"), F.min("cost").alias("least"), F.max(-F.col("delta")).alias("most"), F.min_by("node", F.struct("cost", "node")).alias("centre")))
    near_centre = by_hub(rows.select("hub", "slot", "node"), of_hub.select("hub", "members", "centre")).select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
    labels = merged(labels, linked(stored(apart(near_centre, labels)), shingles, near))
    of_hub = of_hub.join(labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label")), "centre").drop("centre")
    found = stored(postings(rows, of_hub, labels, near))
    labels = merged(labels, linked(stored(stars(found, near)), shingles, near))
    found = stored(found.drop("label").join(labels, "node"))
    return merged(labels, linked(stored(candidates(found, found, near)), shingles, near))


def near_classes(documents: DataFrame, near: float = NEAR, bands: int = BANDS, coordinates: int = COORDINATES, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, t (xxhash64 of the text), class_id, class_t: of the document that stands for the class."""
    rows = keyed(documents)
    prints = stored(signed(rows, bands, coordinates, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    nodes = stored(prints.groupBy("node").agg(first, F.min("bands").alias("bands")))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(keys.join(shared, "key"))
    weights = buckets.groupBy("node").agg(F.sum("n").alias("w"))
    buckets = stored(collapsed(buckets.select("key", "node")).join(weights, "node"))
    firsts = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("first.doc_id").alias("i"), F.col("first.t").alias("u"))
    texts = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left_semi")
    shingles = stored(shingled(texts, width).groupBy("node").agg(F.first("units").alias("units"), F.first("size").alias("size")))

    labels = classes_of(buckets, shingles, near)
    member = nodes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    heads = member.groupBy("label").agg(F.min("first").alias("head"))
    class_of = member.join(heads, "label").select("node", F.col("head.doc_id").alias("class_id"), F.col("head.t").alias("class_t"))
    return prints.select("doc_id", "t", "node").join(class_of, "node").select("doc_id", "t", "class_id", "class_t")


def deduplicated(documents: DataFrame, near: float = NEAR) -> DataFrame:
    """The documents with all their columns, one row of each class."""
    heads = near_classes(documents, near).select(F.col("class_id").alias("i"), F.col("class_t").alias("u")).distinct()
    t = F.xxhash64(text_or_empty())
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), t.alias("u"))
    h, r = heads.alias("h"), rows.alias("r")
    kept = r.join(h, F.col("r.i").eqNullSafe(F.col("h.i")) & (F.col("r.u") == F.col("h.u")), "left_semi")
    return kept.groupBy("i", "u").agg(F.first("row").alias("row")).select("row.*")


def op4(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return near_classes(documents).select("doc_id", "class_id")
