import numpy as np
from common import rows

from ripplemark.llm import shared, topk


def brute(data, k, queries=None):
    out = []
    for a, x in data if queries is None else queries:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), b, j) for j, (b, y) in enumerate(data) if b != a)
        out += [(a, b, r + 1, round(v, 9)) for r, (v, b, _) in enumerate(d[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((a, b, r, round(d, 9)) for a, b, r, d in (tuple(x) for x in df.collect())), key=repr)


def test_against_all_pairs_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 3, (5, 24))
    data = [(i, (centers[i % 5] + rng.normal(0, 1, 24)).tolist()) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert found(topk.top_k(df, 7, block=50)) == brute(data, 7)


def test_ties_repeated_rows_and_ids(spark):
    data = [(i, [float(i % 3), 0.0, 1.0]) for i in range(30)] + [(0, [0.0, 0.0, 1.0]), (0, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert found(topk.top_k(df, 4, block=7)) == brute(data, 4)


def test_bad_vectors_and_extra_columns(spark):
    good = [(1, [1.0, 2.0]), (2, [1.0, 3.0])]
    bad = [(None, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "vec_id as id", "vec_id as rank", "1 as q", "2 as b", "3 as v")
    assert found(topk.top_k(df, 10)) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]
    assert rows(topk.top_k(df.limit(0))) == []
    assert rows(topk.top_k(df.where("vec_id = 1"))) == []


def test_bounds_are_lower_bounds_and_prune():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 64)) + np.repeat(rng.normal(0, 2, (60, 4)), 16, axis=1)
    exact = ((x[:, None] - x[None]) ** 2).sum(2)
    last = np.zeros_like(exact)
    for m in topk.LEVELS:
        s = topk.statistics(x, m)
        bound = ((s[:, None] - s[None]) ** 2).sum(2)
        assert (bound <= exact + 1e-9).all()
        assert bound.sum() >= last.sum()
        last = bound
    best, seen = topk.Best(60, 3), topk.Pruning()
    one = topk.Rows(np.arange(60), x)
    topk.search(one, one, best, seen)
    topk.search(one, one, best, seen)
    assert seen.exact < 60 * 59 and seen.left[1] < seen.got[0] / 2


def test_queries_of_their_own_and_text_ids(spark):
    rng = np.random.default_rng(6)
    data = [(f"k{i % 90:03d}", rng.normal(0, 1, 6).tolist()) for i in range(100)]
    asked = [("k001", data[3][1]), ("new", data[3][1]), ("new", data[3][1])]
    df, queries = (spark.createDataFrame(d, "vec_id string, embedding array<double>") for d in (data, asked))
    assert found(topk.top_k(df, 5, block=9, queries=queries, query_block=2)) == brute(data, 5, asked)
    assert rows(topk.top_k(df, 5, queries=queries.limit(0))) == []


def test_a_vector_that_a_third_of_all_rows_repeat_fills_many_blocks(spark):
    rng = np.random.default_rng(8)
    data = [(7, [1.0, 2.0, 3.0])] * 400 + [(i, rng.normal(0, 1, 3).tolist()) for i in range(800)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(4)
    path = shared.scratch_path(spark, "blocks") + "/b"
    clean = df.selectExpr("vec_id as id", "embedding as v")
    n = topk._write_blocks(clean, topk.fit_pivots(topk.statistics(np.array([d[1] for d in data]), 16), 5), 60, path)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("block").count().collect()]
    assert sum(sizes) == 1200 and n == 20 and max(sizes) <= 150
    asked = df.where("vec_id % 50 = 0")
    assert found(topk.top_k(df, 5, block=60, queries=asked)) == brute(data, 5, [d for d in data if d[0] % 50 == 0])


def test_far_blocks_are_skipped():
    """Well parted clusters: whole blocks are never read."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 40, (1, 64)) + rng.normal(0, 1, (50, 64)) for _ in range(20)])

    class Memory(topk.Blocks):
        def __init__(self):
            y = topk.statistics(x, topk.LEVELS[-1]).reshape(20, 50, -1)
            self.path, self.number = None, np.arange(20)
            self.centre = y.mean(axis=1)
            self.radius = np.sqrt(((y - self.centre[:, None]) ** 2).sum(2)).max(1)

    read, topk_read = [], topk._read_block
    topk._read_block = lambda _, b: read.append(b) or topk.Rows(np.arange(b * 50, b * 50 + 50), x[b * 50 : b * 50 + 50])
    try:
        seen = topk.Pruning()
        best = topk.answer(topk.Rows(np.arange(50), x[:50]), Memory(), 5, 0, 1, seen)
    finally:
        topk._read_block = topk_read
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    d[np.arange(50), np.arange(50)] = np.inf
    assert np.allclose(np.sqrt(best.d), np.sort(d, axis=1)[:, :5])
    assert read == [0] and seen.skipped == 19


def test_what_the_real_embeddings_leave(spark):
    """The driver's embeddings have no structure along their elements: coarse bounds prune next to nothing there, and are passed over."""
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    every = topk.Rows(np.array([r[0] for r in got]), np.array([r[1] for r in got], float))
    asked = topk.Rows(every.ids[::100], every.x[::100])
    best, seen = topk.Best(20, 10), topk.Pruning()
    for s in range(0, 2000, 250):
        topk.search(asked, topk.Rows(every.ids[s : s + 250], every.x[s : s + 250]), best, seen)
    print("pairs", seen.pairs, "got", seen.got, "left", seen.left, "exact", seen.exact)
    d = ((asked.x[:, None] - every.x[None]) ** 2).sum(2)
    d[np.arange(20), np.arange(20) * 100] = np.inf
    assert np.allclose(best.d, np.sort(d, axis=1)[:, :10]) and seen.exact < 0.1 * seen.pairs
