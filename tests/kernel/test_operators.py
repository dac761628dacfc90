from pyspark.sql import functions as F

from ripplemark.functions import arrays, bits, text
from ripplemark.operators import asof, closure, dedup, lookup, sequence, stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_ties_nulls_and_clashing_columns(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (None, 10, "c"), (1, None, "d"), (2, 3, "e")], "k int, t int, __row string")
    right = spark.createDataFrame([(1, 5, 100), (1, 5, 101), (1, 9, None), (1, None, 7), (None, 1, 8)], "k int, t int, v int")
    got = {r["__row"]: r["v2"] for r in asof.asof_preceding(left, right, ["k"], "t", "v", "v2").collect()}
    assert got == {"a": None, "b": 101, "c": None, "d": None, "e": None}
    got = {r["__row"]: r["v2"] for r in asof.asof_preceding(left, right, ["k"], "t", "v", "v2", default_first=True).collect()}
    assert got == {"a": 100, "b": 101, "c": None, "d": 100, "e": None}
    got = {r["__row"]: r["v2"] for r in asof.asof_preceding(left, right, ["k"], "t", "v", "v2", allow_equal=True).collect()}
    assert got["a"] == 101


def test_asof_of_hot_keys_in_slices(spark):
    import random

    rng = random.Random(5)
    left = [(rng.choice((1, 1, 1, 2, None)), rng.choice((None, *range(40))), i) for i in range(400)]
    right = [(rng.choice((1, 1, 1, 3, None)), rng.choice((None, *range(40))), rng.choice((None, *range(50)))) for _ in range(120)]
    a, b = spark.createDataFrame(left, "k int, t int, n int"), spark.createDataFrame(right, "k int, t int, v int")
    for more in ({}, {"default_first": True}, {"allow_equal": True}):
        assert rows(asof.asof_preceding(a, b, ["k"], "t", "v", "w", hot_rows=30, **more)) == rows(asof.asof_preceding(a, b, ["k"], "t", "v", "w", **more))


def test_dedup(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 1, "z"), (None, 1, "z")], "k int, o int, n string")
    assert rows(dedup.first_wins(df, ["k"], ["o", "n"])) == [(1, 1, "x"), (None, 1, "z")]
    assert rows(dedup.last_wins(df, ["k"], ["o", "n"])) == [(1, 2, "y"), (None, 1, "z")]
    assert dedup.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_fallback_chain_never_multiplies_rows(spark):
    base = spark.createDataFrame([(1, 7), (2, 8), (None, 9)], "a int, b int")
    first = spark.createDataFrame([(1, "p"), (1, "o"), (None, "n"), (2, None)], "k int, v string")
    second = spark.createDataFrame([(8, "q")], "k int, v string")
    steps = [lookup.Step("one", first, "k", "v", F.col("a")), lookup.Step("two", second, "k", "v", F.col("b"))]
    assert rows(lookup.fallback_chain(base, steps, "v", "by")) == [(1, 7, "o", "one"), (2, 8, "q", "two"), (None, 9, None, "none")]


def test_scored_match_rejects_ties(spark):
    pairs = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 10, 5), (2, 11, 4), (3, 9, -7)], "k int, c int, s int")
    assert rows(lookup.scored_match(pairs, "k", "c", F.col("s"), "best")) == [(1, None, 5, 2), (2, 10, 5, 2), (3, 9, -7, 1)]


def test_merge_and_diff(spark):
    a = spark.createDataFrame([(1, "", 5), (2, "x", 0), (3, "y", 1)], "id int, n string, q int")
    b = spark.createDataFrame([(1, "b", 9), (2, "c", 9), (4, "d", 9)], "id int, n string, q int")
    assert rows(lookup.merge_with_defaults(a, b, "id", ["n", "q"])) == [(1, "b", 5), (2, "x", 9), (3, "y", 1), (4, "d", 9)]
    assert rows(lookup.merge_with_defaults(a, b, "id", ["n", "q"], ("q",)))[2] == (3, "y", 1)
    assert rows(lookup.incremental_diff(b, a, "id", "n")) == [(1, "changed"), (2, "changed"), (3, "removed"), (4, "new")]


def test_positions_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 1)] + [(i % 7, i) for i in range(500)], "v int, id int")
    got = [r["id"] for r in sequence.positions(df, ["v", "id"], "pos").orderBy("pos").collect()]
    assert got == [1] + [i for _, i in sorted((i % 7, i) for i in range(500))]
    assert sequence.positions(df.limit(0), ["v", "id"], "pos").count() == 0
    same = spark.createDataFrame([("x", i) for i in range(300)] + [(None, 5)], "v string, id int")
    assert [r["id"] for r in sequence.positions(same, ["v", "id"], "pos", 7).orderBy("pos").collect()] == [5, *range(300)]


def test_closure_of_a_cycle_and_chain_outcomes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (None, 4), (2, 2)], "src int, dst int")
    assert rows(closure.reachable(edges, spark.createDataFrame([(1,)], "node int"))) == [(1, 0), (2, 1), (3, 2)]
    items = spark.createDataFrame([(1, 2, False), (2, 3, False), (3, 3, True), (4, 5, False), (5, 4, False), (6, 77, False), (7, None, False)], "k int, p int, ok boolean")
    assert rows(closure.bounded_chain(items, "k", "p", "ok", 10)) == [(1, 3, 2, "found"), (2, 3, 1, "found"), (3, 3, 0, "found"), (4, None, 1, "cycle"), (5, None, 1, "cycle"), (6, None, 0, "broken"), (7, None, 0, "broken")]
    deep = spark.createDataFrame([(i, i + 1, False) for i in range(6)], "k int, p int, ok boolean")
    assert rows(closure.bounded_chain(deep, "k", "p", "ok", 2))[0] == (0, None, 2, "too deep")


def test_stats(spark):
    df = spark.createDataFrame([("ok", "a"), ("ok", None), ("bad", "a")], "o string, k string")
    got = {(r["bucket"], r["k"]): r["n"] for r in stats.outcome_buckets(df, "o", "k", {"ok": ["all"], "bad": ["all"]}).collect()}
    assert got == {("ok", "a"): 1, ("ok", "Unknown"): 1, ("ok", None): 2, ("bad", "a"): 1, ("bad", None): 1, ("all", "a"): 2, ("all", "Unknown"): 1, ("all", None): 3}
    reason = stats.first_reason([("x", F.col("o") == "bad"), ("y", F.col("k").isNull()), ("z", F.lit(None).cast("boolean"))])
    assert [r[0] for r in df.select(reason).collect()] == [None, "y", "x"]


def test_union_within_bounds(spark):
    a, b = spark.createDataFrame([(0,), (1,), (None,)], "x int"), spark.createDataFrame([(1,), (9,), (10,)], "y bigint")
    assert rows(stats.union_distinct([(a, "x"), (b, "y")], "id")) == sorted([(0,), (1,), (9,), (10,)], key=repr)
    assert rows(stats.union_distinct([(a, "x"), (b, "y")], "id", 0, 10)) == [(1,), (9,)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([(" a\x00b\r\nc\rd　", bytearray(b"\x81\x00"), [1.0, 3.0, 1.0, 3.5])], "t string, b binary, v array<double>")
    got = df.select(text.normalize_text(F.col("t")), text.rtf(F.lit("a{\\}\n")), bits.varint(F.col("b")), arrays.smoothness(F.col("v")), arrays.half_similarity(F.col("v"), lambda a, b: a == b), text.basename(F.lit("a\\b:c/Movie.DCR")), text.sanitize(F.lit('a/b?"c')), text.sanitize(F.lit(" "))).first()
    assert got[0] == "ab\nc\nd"
    assert got[1].endswith("a\\{\\\\\\}\\par\n\n}")
    assert got[2] == 128
    assert (got[3], got[4], got[5], got[6], got[7]) == (6.5 / 3, 0.5, "Movie", "a_b__c", "artifact")
