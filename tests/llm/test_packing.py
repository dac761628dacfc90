import itertools
import math
from collections import Counter, defaultdict

import numpy as np
from common import LONG, odd_docs, rows

from ripplemark.llm import packing, queries
from ripplemark.llm.shared import read


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        prices = rng.random(4)
        best = max(float(np.dot(c, prices)) for c in itertools.product(*[range(20 // s + 1) for s in sizes]) if np.dot(c, sizes) <= 20)
        got = packing.knapsack(sizes, prices, 20)
        assert np.dot(got, sizes) <= 20 and abs(float(np.dot(got, prices)) - best) < 1e-9


def test_the_linear_program_covers_each_class_once():
    sizes, counts = np.array([2, 3, 5, 7]), np.array([40, 31, 17, 9])
    found = packing.solve(sizes, counts, 10)
    assert np.allclose(sum(c * x for c, x in found), counts)
    assert all(np.dot(c, sizes) <= 10 for c, _ in found)
    bins = sum(x for _, x in found)
    assert np.dot(sizes, counts) / 10 - 1e-9 <= bins <= np.dot(sizes, counts) / 10 * 1.2


def slow_best_fit(histogram, capacity):
    bins = []
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            at = min((i for i, room in enumerate(bins) if room >= s), key=lambda i: bins[i], default=None)
            if at is None:
                bins.append(capacity)
                at = -1
            bins[at] -= s
    return len(bins)


def laid_out(segments, histogram):
    """``{bin: [(slot, size)]}`` of a plan."""
    bins = defaultdict(list)
    for size, rows_ in segments.items():
        ends = [r[0] for r in rows_[1:]] + [histogram[size]]
        for (rank, first, copies, slot), end in zip(rows_, ends):
            for off in range(end - rank):
                bins[first + off // copies].append((slot + off % copies, size))
    return bins


def test_plans_are_valid_and_need_no_more_bins_than_best_fit():
    rng = np.random.default_rng(1)
    made = {
        "all sizes": {int(k): int(rng.integers(1, 60)) for k in range(1, 65)}, "thirds": {int(k): int(rng.integers(1, 300)) for k in range(15, 35)},
        "few": {7: 100, 31: 50, 33: 50}, "one": {64: 9}, "small": {1: 1000}, "skewed": {k: 4000 // k for k in range(1, 65)},
    }
    for name, histogram in made.items():
        segments, n = packing.plan(histogram, 64)
        bins = laid_out(segments, histogram)
        assert sorted(bins) == list(range(n)), name
        for held in bins.values():
            assert sorted(s for s, _ in held) == list(range(len(held))) and sum(s for _, s in held) <= 64
        fit = slow_best_fit(histogram, 64)
        assert packing.best_fit_decreasing(histogram, 64).bins == fit
        assert -(-sum(s * c for s, c in histogram.items()) // 64) <= n <= fit, name
    thirds = packing.plan(made["thirds"], 64)[1]
    assert thirds < 0.99 * slow_best_fit(made["thirds"], 64)  # the program is worth having where three pieces fill a bin


def test_odd_capacities_are_kept(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate((1, 2049, 2050, 2051, 5000, 300, 1025))], "doc_id bigint, text string")
    for capacity in (1, 7, 257, 2050):
        checked(packing.pack(df, capacity).collect(), {i: n for i, n in enumerate((1, 2049, 2050, 2051, 5000, 300, 1025))}, capacity)


def checked(out, lengths, capacity):
    """Every piece of every document once, in place; no bin over its capacity; slots from 0."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
        if r["n_tokens"]:
            bins[r["bin_id"]].append((r["slot"], r["n_tokens"]))
        else:
            assert r["bin_id"] is None and r["slot"] is None
    for doc, n in lengths.items():
        want = [(i, i * capacity, min(capacity, n - i * capacity)) for i in range(max(1, math.ceil(n / capacity)))]
        assert sorted(pieces[doc]) == want
    for held in bins.values():
        assert sorted(s for s, _ in held) == list(range(len(held)))
        assert sum(n for _, n in held) <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    lengths = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    out = packing.pack(docs).collect()
    n = checked(out, lengths, packing.CAPACITY)
    got = queries.QUERIES["op4_packing"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, out), key=repr)
    histogram = Counter(-(-min(packing.CAPACITY, r["n_tokens"]) // 8) for r in out if r["n_tokens"])
    assert n <= slow_best_fit(histogram, 256)
    assert n <= 1.06 * sum(lengths.values()) / packing.CAPACITY + 2


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = packing.pack(docs, 512).collect()
    counts = Counter(r["doc_id"] for r in out)
    words = len(LONG.split())
    assert counts[4] == math.ceil(words / 512)
    assert counts[1] == 3 and counts[2] == 1 and counts[3] == 1 and counts[5] == 1 and counts[None] == 2
    places = [(r["bin_id"], r["slot"]) for r in out if r["n_tokens"]]
    assert len(places) == len(set(places))
    assert rows(packing.pack(docs.limit(0))) == []
    assert rows(packing.pack(docs.where("doc_id = 2"))) == [(None, None, 2, 0, 0, 0)]
