"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams, of its longer beginnings and
ends, and of itself; a linear softmax turns a mean of vectors into the chance of label 1. Embeddings and
softmax are trained jointly in numpy. A document counts as toxic as the bag of its `TOP` worst words: first
the mean of the whole document is trained, then the worst word of each toxic document against all words of
the others. As misspelt words share most n-grams with the words seen in training, they share their vectors.
The bag's logit becomes a chance by a logistic fit on a fifth of the training rows.

The bag that is averaged is not the whole document: by cross-validation inside the rows that may be learnt from,
the mean over all words separates far worse (the README has the figures), as a document is toxic by few words.

Training takes at most `max_labelled` rows of each class, those with the smallest hashes of doc_id, with their whole
texts; it runs in one task over that bounded sample. Scoring takes whole texts, wherever Spark has dealt them:
the model is one number per n-gram bucket.

Defined cases: a null or empty text has an empty bag and gets the chance of words that say nothing; rows
with a null label, or one other than 0 and 1, teach nothing; labels that repeat or disagree all count; without
labels of both kinds every score is 0.0; repeated rows are scored each; an empty table gives an empty
result. Other columns are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylake.llm.common import stored, text_or_empty
from keylake.llm.words import mixed, powers

MAX_LABELLED = 2_500
BUCKETS = 1 << 17
DIM = 8
#: A document's score is of this many of its words, the worst; fewer are filled up with empty words.
TOP = 2
GRAMS = (3, 5)
#: Lengths of the beginnings and ends of a marked word, beside its n-grams.
EDGES = (6, 10)
THRESHOLD = 0.7
STEPS_MEAN, STEPS_WORST = 10, 70
RATE, DECAY = 0.05, 1e-3
#: In training, each step leaves out this share of every word's n-grams, so that no single one stands for the word.
DROPPED = 0.5
#: Characters of words whose values a task keeps, and of texts scored at once.
CACHED, AT_ONCE = 10_000_000, 500_000

U = np.uint64
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    """Lower-cased, without punctuation at its ends."""
    return _EDGE.sub("", word).lower()


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, edges and of themselves, and the number of the word each belongs to. Empty words have none."""
    sizes = np.fromiter((len(w) + 2 if w else 0 for w in words), np.int64, len(words))
    joined = "".join(f"<{w}>" for w in words if w)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # A stretch's hash comes from running sums of the characters times powers of an odd number.
    up, down = powers(len(chars))
    total = np.concatenate(([U(0)], np.cumsum(chars * up[: len(chars)], dtype=U)))
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars))
    left = ends[word] - place
    found, owners = [], []

    def add(start: np.ndarray, n) -> None:
        h = mixed((total[start + n] - total[start]) * down[start] + (U(0) + n).astype(U))
        found.append((h % U(buckets)).astype(np.int32))
        owners.append(word[start].astype(np.int32))

    some = np.flatnonzero(sizes)
    first = ends[some] - sizes[some]
    add(first, sizes[some])
    for n in range(GRAMS[0], GRAMS[1] + 1):
        add(np.flatnonzero(left >= n), n)
    for n in range(EDGES[0], EDGES[1] + 1):
        long = sizes[some] > n
        add(first[long], n)
        add(ends[some][long] - n, n)
    return np.concatenate(found), np.concatenate(owners)


def bag(values: np.ndarray) -> float:
    """The mean of the TOP greatest word values."""
    if len(values) > TOP:
        values = np.partition(values, len(values) - TOP)[-TOP:]
    return float(values.sum()) / TOP


def _lots(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in turn, in lots of AT_ONCE characters or of one longer text."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end] or "") <= AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        yield texts[start:end]
        start = end


@dataclass
class Model:
    """values: per bucket, what its embedding adds to the softmax's logit of label 1 against 0."""

    values: np.ndarray
    bias: float
    slope: float
    offset: float

    def of_words(self, words: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for some in _lots(words):
            flat, owner = subwords(some, len(self.values))
            out.append(np.bincount(owner, self.values[flat], len(some)) / np.maximum(np.bincount(owner, minlength=len(some)), 1))
        return np.concatenate(out)

    def chance(self, bags: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (bags + self.bias) + self.offset, -40, 40)))


def train(texts: list[str], labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0), seed: int = 7) -> Model:
    """weights: how many rows of class 0 and 1 one row of the sample stands for."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    words, times, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d, text in enumerate(texts):
        ids, n = np.unique(np.array([index.setdefault(plain(w), len(index)) for w in text.split()], np.int64), return_counts=True)
        words.append(ids)
        times.append(n)
        doc.append(np.full(len(ids), d))
    words, times, doc = np.concatenate(words), np.concatenate(times), np.concatenate(doc)
    flat, owner = subwords(list(index))
    sizes = np.bincount(owner, minlength=len(index))

    fit = rng.random(len(texts)) < 0.8
    toxic = labels[doc] == 1
    used = fit[doc]
    n_words = np.maximum(np.bincount(doc, times, len(texts)), 1)
    # Embeddings and softmax, trained with Adam over all words at once.
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def logits(flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        by_bucket = params[0] @ (params[1][:, 1] - params[1][:, 0])
        by_word = np.bincount(owner, by_bucket[flat], len(index)) / np.maximum(sizes, 1)
        return by_word[words] + params[2][1] - params[2][0]

    def worst_of(z: np.ndarray) -> np.ndarray:
        """Each document's worst word, or -1."""
        out = np.full(len(texts), -1)
        order = np.lexsort((z, doc))
        last = np.append(doc[order][1:] != doc[order][:-1], True) if len(order) else np.zeros(0, bool)
        out[doc[order[last]]] = order[last]
        return out

    if len(words):
        for step in range(STEPS_MEAN + STEPS_WORST):
            stay = rng.random(len(flat), np.float32) >= DROPPED
            flat_now, owner_now = flat[stay], owner[stay]
            sizes_now = np.bincount(owner_now, minlength=len(index))
            z = logits(flat_now, owner_now, sizes_now)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            part = np.zeros(len(words))
            if step < STEPS_MEAN:
                part[used] = times[used] / n_words[doc[used]]
            else:
                worst = worst_of(z)
                part[used & ~toxic] = 0.5 * times[used & ~toxic] / n_words[doc[used & ~toxic]]
                w = worst[fit & (worst >= 0)]
                part[w] += 1.0
            for c in (toxic, ~toxic):
                part[c] /= max(part[c].sum(), 1e-9)
            dz = (p - toxic) * part
            per_word = np.bincount(words, dz, len(index)) / np.maximum(sizes_now, 1)
            g = np.bincount(flat_now, per_word[owner_now], BUCKETS)
            along = params[0].T @ g
            grads = [np.outer(g, params[1][:, 1] - params[1][:, 0]), np.stack([-along, along], 1), np.array([-dz.sum(), dz.sum()])]
            for k, grad in enumerate(grads):
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                rise = RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
                params[k] -= rise + RATE * (DECAY if k < 2 else 0) * params[k]
    bias = float(params[2][1] - params[2][0])
    z = logits(flat, owner, sizes) - bias
    often = np.minimum(times, TOP)
    z, z_doc = np.repeat(z, often), np.repeat(doc, often)
    bags = np.array([bag(z[a:b]) for a, b in pairwise(np.searchsorted(z_doc, np.arange(len(texts) + 1)))]) + bias
    held = np.flatnonzero(~fit)
    if len(set(labels[held].tolist())) < 2:
        held = np.arange(len(texts))
    slope, offset = _logistic(bags[held], labels[held], weights)
    values = params[0] @ (params[1][:, 1] - params[1][:, 0])
    seen = np.zeros(BUCKETS, bool)
    seen[flat] = True
    values[~seen] = 0  # n-grams that training never met say nothing
    return Model(values.astype(np.float32), bias, slope, offset)


def out_of_fold(texts: list[str], labels: np.ndarray, folds: int = 3) -> np.ndarray:
    """Each text's chance by a model trained on the other folds: to compare settings without the held-out rows."""
    fold, out = np.arange(len(texts)) % folds, np.zeros(len(texts))
    for k in range(folds):
        model = train([t for t, f in zip(texts, fold) if f != k], labels[fold != k])
        out[fold == k] = model.chance(np.fromiter(_bags(model, [t for t, f in zip(texts, fold) if f == k], {}), np.float64))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weights: tuple[float, float]) -> tuple[float, float]:
    """Slope and offset of a logistic fit, targets drawn in a little from 0 and 1, by Newton's method."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, weights[1], weights[0])
    w = w / w.sum()
    scale = max(float(np.std(x)), 1e-6)
    a, b = 1.0 / scale, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = w * (p - target)
        h = w * p * (1 - p) + 1e-9
        grad = np.array([(r * x).sum() + 1e-6 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2 / max(1e-9, abs(step[0]) * scale, abs(step[1])))
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 1 modulo 3: such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Learns from the labelled documents that aren't held out; None without labels of both kinds."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    h = F.xxhash64("doc_id")
    # At most max_labelled rows of each class: small enough to be sent to every task whatever the tables' size.
    chosen = [marked.filter(F.col("toxic") == c).orderBy(h, "doc_id").limit(max_labelled) for c in (0, 1)]
    picked = stored(chosen[0].unionByName(chosen[1]))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.orderBy(h, "doc_id", "toxic", F.xxhash64("text")).limit(3 * max_labelled)
    weights = tuple(counts[c] / min(counts[c], max_labelled) for c in (0, 1))

    def learn(it):
        pdf = pd.concat([*it, pd.DataFrame({"text": [], "toxic": []})])
        labels = pdf["toxic"].to_numpy().astype(np.int64)
        if len(set(labels.tolist())) == 2:
            m = train(pdf["text"].tolist(), labels, weights)
            yield pd.DataFrame({"raw": [m.values.astype("<f4").tobytes()], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    row = rows.select("text", "toxic").coalesce(1).mapInPandas(learn, "raw binary, bias double, slope double, offset double").first()
    return row and Model(np.frombuffer(row["raw"], "<f4"), row["bias"], row["slope"], row["offset"])


def _bags(model: Model, texts: list[str | None], known: dict[str, float]) -> Iterator[float]:
    """Each text's bag of worst words; known keeps words' values between calls, under None the number of their characters."""
    for some in _lots(texts):
        split = [(text or "").split() for text in some]
        new = list(set().union(*split).difference(known))
        known.update(zip(new, model.of_words([plain(w) for w in new]).tolist()))
        known[None] = known.get(None, 0) + sum(map(len, new))
        for words in split:
            yield bag(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
        if known[None] > CACHED:
            known.clear()


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with toxic_score (0 to 1); all their columns are kept."""
    names = documents.columns
    added = next(n for n in ("toxic_score", *(f"toxic_score_{i}" for i in range(len(names) + 1))) if n.lower() not in {x.lower() for x in names})
    if model is None:
        return documents.withColumn(added, F.lit(0.0))
    text_at = [x.lower() for x in names].index("text")
    kinds = documents.schema

    def score(it):
        known: dict[str, float] = {}
        for b in it:
            bags = np.fromiter(_bags(model, b.column(text_at).cast(pa.string()).to_pylist(), known), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.chance(bags), pa.float64())], names=[*names, added])

    return documents.mapInArrow(score, T.StructType([*kinds.fields, T.StructField(added, T.DoubleType())]))


def accepted(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than threshold, with all their columns."""
    out = scored(documents, model)
    return out.filter(F.col(out.columns[-1]) < threshold).drop(out.columns[-1])


def op5(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    out = scored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
