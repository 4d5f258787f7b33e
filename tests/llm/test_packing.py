"""The search of operator 10 against brute force, and its rows on awkward tables."""

import collections
import itertools
import random

import pytest

from tallyflow.llm import packing


def fits(bins, parts):
    """Whether ``parts`` can be dealt to bins of the sizes ``bins``."""
    if not parts:
        return True
    for i in {b: k for k, b in enumerate(bins)}.values():
        if bins[i] >= parts[0] and fits([b - parts[0] * (k == i) for k, b in enumerate(bins)], parts[1:]):
            return True
    return False


def test_fillings_are_the_undominated_ones():
    rng = random.Random(21)
    for _ in range(120):
        counts = collections.Counter(rng.randrange(2, 25) for _ in range(rng.randrange(1, 8)))
        room = rng.randrange(5, 50)
        pieces = list(counts.elements())
        all_of_them = {tuple(sorted(s, reverse=True)) for r in range(len(pieces) + 1) for s in itertools.combinations(pieces, r) if sum(s) <= room}
        want = {b for b in all_of_them if not any(a != b and fits(list(a), list(b)) for a in all_of_them)}
        got = list(packing.fillings(dict(counts), room, [10**9]))
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= capacity:
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_plan_is_optimal_on_a_hundred_small_cases():
    rng = random.Random(22)
    for _ in range(100):
        sizes = sorted((rng.randrange(10, 75) for _ in range(rng.randrange(1, 13))), reverse=True)
        plan = packing.plan(collections.Counter(sizes), 100, 10**6)
        assert collections.Counter(x for f, n in plan for x in f for _ in range(n)) == collections.Counter(sizes)
        assert all(sum(f) <= 100 for f, _ in plan)
        assert packing.bins(plan) == fewest(sizes, 100), sizes


def test_plan_beats_best_fit_on_wide_histograms():
    rng = random.Random(23)
    counts = collections.Counter(rng.randrange(200, 701) for _ in range(2000))
    assert packing.bins(packing.plan(counts)) < packing.bins(packing.best_fit(counts, packing.CAPACITY))


@pytest.mark.parametrize("chunk", [3, packing.CHUNK])
def test_rows(spark, chunk):
    rows = [(None, "a b c", "x", 1), (None, None, "x", 2), (7, "", None, 3), (7, "", None, 3), (8, "word " * 3000, "y", 4)] + [(i, "same text", "z", i) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `piece` string, `chunk` long").repartition(3)
    got = packing.pack(docs, chunk=chunk).collect()
    assert sum(r["doc_id"] is None for r in got) == 2 and [r["length"] for r in got if r["doc_id"] == 7] == [1, 1]
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) == -(-total // 1024)
