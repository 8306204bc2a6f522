"""Quality rules: text statistics, a fixed base rule and a learned decision list, in Spark's own expressions.

Statistics of a text are computed inside its row with array functions, so nothing is shuffled however
long a text is or however often its words recur. The list is learned by sequential covering (in the
manner of IREP): a rule for low quality grows by the threshold test with the best gain on two thirds
of the labelled rows, is pruned on the last third, is kept if precise enough there, and the rows it
covers leave both parts. Each step needs one grouped count of (statistic, bin, label), at most
len(STATS) x BINS x 2 rows, whatever the number of labelled rows. Learning uses at most `max_labelled`
labelled documents (those with the smallest hashes of doc_id); everything else covers all rows.

Defined cases: a null text is empty, has no words and fails the base rule; rows without a label, or
with a label other than 0 and 1, teach nothing; without labelled rows of both kinds the list is empty
and only the base rule decides; repeated rows are judged each; labels that repeat or disagree for a
doc_id all count; an empty table gives an empty result, and empty labels an empty list; a statistic of a text
without words is 0; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import WS, stored, table, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
MAX_LABELLED = 20_000
BINS = 32
#: Statistics that rules may test; all are ratios, so that a rule holds for short and long texts.
STATS = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "bang_ratio", "digit_ratio", "distinct_ratio"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row: the optimizer doesn't copy it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by two 64-bit hashes of their words. Sorted with their places, equal ones are
    neighbours; of the repeated places in order, each adds the words up to the next one, at most three.
    """

    def places(windows: Column) -> Column:
        same = lambda i, j: (windows[i]["a"] == windows[j]["a"]) & (windows[i]["b"] == windows[j]["b"])
        n = F.size(windows)
        twice = lambda w, i: F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False)) | F.coalesce(F.when(i < n - 1, same(i, i + 1)), F.lit(False))
        return F.sort_array(F.transform(F.filter(windows, twice), lambda w: w["i"]))

    def covered(at: Column) -> Column:
        step = lambda p, k: F.when(k < F.size(at) - 1, F.least(F.lit(3), at[k + 1] - p)).otherwise(F.lit(3))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda acc, x: acc + x)

    def of(h: Column) -> Column:
        window = lambda i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("a"), i.alias("i"), F.xxhash64(h[i + 2], h[i], h[i + 1], F.lit(7)).alias("b"))
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), window))
        return let(let(windows, places), covered)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashed, of))


def text_stats(documents: DataFrame, with_row: bool = False) -> DataFrame:
    """doc_id and the counts of each text; with_row: and `row`, a struct of all columns."""
    row = [F.struct("*").alias("row")] if with_row else []
    first = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *row)
    row = ["row"] if with_row else []
    count = lambda keep: F.length(F.regexp_replace("text", keep, ""))
    lines = lambda x: F.filter(F.split(x, "\n"), lambda y: y.rlike(r"[^\x20\x09-\x0D]"))
    per_words = lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), _repeat_words(w).alias("n_repeat_words"))
    per_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return first.select(
        "doc_id",
        *row,
        count(SPACE).alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        count(r"[^A-ZÀ-ÖØ-Þ]+").alias("n_upper"),
        count(r"[^!?]+").alias("n_bang"),
        count(r"[^0-9]+").alias("n_digits"),
        let(_words(F.col("text")), per_words).alias("w"),
        let(lines(F.col("text")), per_lines).alias("l"),
    ).select(
        "doc_id",
        *row,
        F.col("w.n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_bang",
        "n_digits",
        F.col("w.n_distinct").alias("n_distinct"),
        F.col("l.n_lines").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_ratio": per("n_symbols", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "mean_word": per("word_chars", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "bang_ratio": per("n_bang", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"),
        "distinct_ratio": per("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    """stat >= threshold, or stat < threshold."""

    stat: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.stat) >= self.threshold if self.at_least else F.col(self.stat) < self.threshold


@dataclass
class Rule:
    tests: list[Test] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out


def learn_rules(rows: DataFrame, max_rules: int = 6, max_tests: int = 3, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """An ordered list of rules for bad = 1. rows: the STATS, bad (0 or 1), grow (boolean)."""
    cuts = _cuts(rows)
    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(max_rules):
        rule = _grow(rows.filter(left & F.col("grow")), cuts, max_tests, least)
        if rule is None:
            break
        rule, good = _prune(rows.filter(left & ~F.col("grow")), rule)
        if good < precision:
            break
        rules.append(rule)
        left = left & ~rule.column()
    return rules


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds to try: distinct quantiles of each statistic among the bad rows and among all."""
    probs = [(i + 0.5) / BINS for i in range(BINS)]
    half = [(i + 0.5) / (BINS // 2) for i in range(BINS // 2)]
    row = rows.agg(*[F.percentile_approx(s, probs, 1000).alias(s) for s in STATS], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(s)), half, 1000).alias(f"bad_{s}") for s in STATS]).first()
    return {s: sorted({*(row[s] or []), *(row[f"bad_{s}"] or [])}) for s in STATS}


def _up_to(stat: str):
    return lambda cut: cut <= F.col(stat)


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Per statistic, for each of its bins [cut i-1, cut i) the counts of good and bad rows: one grouped count."""
    bins = [F.struct(F.lit(s).alias("stat"), F.size(F.filter(F.array(*[F.lit(c) for c in cuts[s]]), _up_to(s))).alias("bin")) for s in STATS if cuts[s]]
    out = {s: [[0, 0] for _ in range(len(cuts[s]) + 1)] for s in STATS}
    if bins:
        for r in rows.select("bad", F.inline(F.array(*bins))).groupBy("stat", "bin", "bad").count().collect():  # at most len(STATS) x (2 x BINS) x 2 rows
            out[r["stat"]][r["bin"]][r["bad"]] += r["count"]
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_tests: int, least: int) -> Rule | None:
    rule = Rule()
    for _ in range(max_tests):
        hist = _histogram(rows.filter(rule.column()), cuts)
        total = next((tuple(sum(b[k] for b in h) for k in (0, 1)) for h in hist.values() if len(h) > 1), (0, 0))
        if not total[1] or not total[0]:
            break
        best, test = 0.0, None
        for s in STATS:
            good = bad = 0
            for i, c in enumerate(cuts[s]):
                good, bad = good + hist[s][i][0], bad + hist[s][i][1]
                for at_least, (g, b) in ((True, (total[0] - good, total[1] - bad)), (False, (good, bad))):
                    if b < least:
                        continue
                    gain = b * (math.log2((b + 1) / (b + g + 2)) - math.log2((total[1] + 1) / (sum(total) + 2)))
                    if gain > best + 1e-9:
                        best, test = gain, Test(s, at_least, c)
        if test is None:
            break
        rule = Rule([*rule.tests, test])
    return rule if rule.tests else None


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float]:
    """The prefix of the rule with the best (bad - good) / covered on rows kept back, and its share of bad rows there."""
    prefixes = [Rule(rule.tests[: k + 1]) for k in range(len(rule.tests))]
    row = rows.agg(*[F.count(F.when(p.column() & (F.col("bad") == b), 1)).alias(f"{b}_{k}") for k, p in enumerate(prefixes) for b in (0, 1)]).first()
    scored = []
    for k, p in enumerate(prefixes):
        good, bad = row[f"0_{k}"], row[f"1_{k}"]
        scored.append(((bad - good) / (bad + good) if bad + good else -1.0, bad, -k, p, bad / (bad + good) if bad + good else 0.0))
    best = max(scored, key=lambda x: x[:3])
    return best[3], best[4]


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns the list from stats (of text_stats, with STATS) and labels (doc_id, quality; 1 is good)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).cast("int").alias("bad")).filter("bad in (0, 1) and doc_id is not null")
    rows = marked.join(stats.filter(~base_failed()).select("doc_id", *STATS), "doc_id")
    rows = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "bad", *STATS).limit(max_labelled)
    rows = stored(rows.select("bad", *STATS, (F.pmod(F.col("h"), F.lit(3)) != 0).alias("grow")))
    return learn_rules(rows.coalesce(4))


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, with_row: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, the STATS and kept. The counts are written once: learning and judging both read them."""
    stats = stored(text_stats(documents, with_row)).withColumns(ratios())
    rules = fit(stats, labels, max_labelled)
    failed = F.coalesce(base_failed(), F.lit(True))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def accepted(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judge(documents, labels, max_labelled, with_row=True).filter("kept").select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
