"""Plain versions of operators, written row by row, to hold results against on small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, width: int = 5) -> Counter:
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or Counter([tuple(words)])


def jaccard(a: Counter, b: Counter) -> float:
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def near_classes(texts: dict[int, str | None], near: float = 0.8) -> dict[int, int]:
    """doc_id -> smallest doc_id of its component."""
    bags = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            holders[s].append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, bag in bags.items():
        beside = {j for s in bag for j in holders[s] if j < i}
        for j in beside:
            if root(i) != root(j) and jaccard(bag, bags[j]) >= near:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def decision_list(rows: list[dict], cuts: dict[str, list[float]], max_rules=6, max_tests=3, precision=0.95, least=5) -> list[list[tuple]]:
    """Sequential covering over rows as dicts, with thresholds to try for each statistic: each rule is a list of (stat, at_least, threshold)."""
    rules, left = [], list(rows)
    passes = lambda r, tests: all((r[s] >= c) == up for s, up, c in tests)
    while len(rules) < max_rules:
        inside, tests = [r for r in left if r["grow"]], []
        while len(tests) < max_tests:
            bad, good = sum(r["bad"] for r in inside), sum(1 - r["bad"] for r in inside)
            best, test = 1e-9, None
            if bad and good:
                for s in cuts:
                    for c in cuts[s]:
                        for up in (True, False):
                            some = [r for r in inside if (r[s] >= c) == up]
                            b = sum(r["bad"] for r in some)
                            g = len(some) - b
                            gain = b * (math.log2((b + 1) / (b + g + 2)) - math.log2((bad + 1) / (bad + good + 2)))
                            if b >= least and gain > best + 1e-9:
                                best, test = gain, (s, up, c)
            if test is None:
                break
            tests.append(test)
            inside = [r for r in inside if passes(r, [test])]
        if not tests:
            break
        kept_back, scored = [r for r in left if not r["grow"]], []
        for k in range(1, len(tests) + 1):
            some = [r for r in kept_back if passes(r, tests[:k])]
            b = sum(r["bad"] for r in some)
            scored.append(((2 * b - len(some)) / len(some) if some else -1.0, b, -k, b / len(some) if some else 0.0))
        worth, _, k, share = max(scored)
        if share < precision:
            break
        rules.append(tests[:-k])
        left = [r for r in left if not passes(r, rules[-1])]
    return rules


def one_permutation(hashes: list[int], bins: int, bits: int, pick, mix) -> list[int]:
    """The low bits of each bin's smallest hash; an empty bin asks others in turn."""
    least = {}
    for h in hashes:
        b = h * bins >> 64
        least[b] = min(h, least.get(b, h))
    out = []
    for b in range(bins):
        at, k = b, 0
        while at not in least:
            at, k = pick(b, k), k + 1
        out.append(mix(least[at]) % (1 << bits))
    return out
