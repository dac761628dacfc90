import numpy as np
from common import odd_docs, rows

from pyspark.sql import functions as F

from ripplemark.llm import queries, sharding
from ripplemark.llm.shared import read


def brute_place(items, shards):
    total = [sum(x[d] for x in items) or 1 for d in range(3)]
    share = [[x[d] / total[d] * shards for d in range(3)] for x in items]
    room = [[1.0] * 3 for _ in range(shards)]
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-round(max(share[i]), 9), i)):
        fit = [sum(a * b for a, b in zip(room[s], share[i])) for s in range(shards)]
        out[i] = max(range(shards), key=lambda s: (round(fit[s], 9), -s))
        room[out[i]] = [a - b for a, b in zip(room[out[i]], share[i])]
    return out


def test_placing_against_brute_force():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 1000, (80, 3)).astype(float)
    assert sharding.place(items, 7).tolist() == brute_place(items.tolist(), 7)
    assert sharding.place(np.zeros((0, 3)), 4).tolist() == []
    assert set(sharding.place(np.zeros((3, 3)), 4).tolist()) == {0}


def test_more_shards_than_hash_classes_before():
    items = np.ones((sharding.slots(8192), 3))
    assert sharding.slots(64) == 4096 and sharding.slots(8192) >= 8192 * sharding.PARTS
    small = sharding.place(items[: 8192 * 2], 8192)
    assert np.bincount(small, minlength=8192).tolist() == [2] * 8192


def brute_groups(items, owners, shards, tolerance=sharding.TOLERANCE):
    """Owners, largest first, whole where they fit; then the others' parts, largest first."""
    total = [sum(x[d] for x in items) or 1 for d in range(3)]
    share = [[x[d] / total[d] * shards for d in range(3)] for x in items]
    room = [[1.0] * 3 for _ in range(shards)]
    of = {}
    for i, o in enumerate(owners):
        of.setdefault(o, []).append(i)
    whole = {o: [sum(share[i][d] for i in own) for d in range(3)] for o, own in of.items()}
    out = [None] * len(items)

    def put(size, among):
        s = max(among, key=lambda s: (round(sum(a * b for a, b in zip(room[s], size)), 9), -s))
        room[s] = [a - b for a, b in zip(room[s], size)]
        return s

    for o in sorted(of, key=lambda o: (-round(max(whole[o]), 9), of[o][0])):
        if fit := [s for s in range(shards) if all(r + tolerance >= w for r, w in zip(room[s], whole[o]))]:
            s = put(whole[o], fit)
            for i in of[o]:
                out[i] = s
    for i in sorted((i for i in range(len(items)) if out[i] is None), key=lambda i: (-round(max(share[i]), 9), i)):
        out[i] = put(share[i], range(shards))
    return out


def test_the_query_against_brute_force(spark):
    """The registered query's rows: items rebuilt in Python from its slots and placed one by one."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    shards, n_slots = sharding.SHARDS, sharding.slots(sharding.SHARDS)
    rows_ = docs.selectExpr("doc_id", "source", f"pmod(xxhash64(doc_id), {n_slots}) slot", "octet_length(text) b", r"regexp_count(text, '[^ \\t\\n\\r\\f]+') w").collect()
    tot = [sum(r["b"] for r in rows_), sum(r["w"] for r in rows_), len(rows_)]
    group = {}
    for r in rows_:
        g = group.setdefault(r["source"], [0, 0, 0])
        for d, v in enumerate((r["b"], r["w"], 1)):
            g[d] += v
    share = {g: max(a / b for a, b in zip(v, tot)) * shards for g, v in group.items()}
    assert min(share.values()) >= 1 / sharding.BUNDLED  # nothing is bundled in this table
    items = {}
    for r in rows_:
        cut = 1 << max(0, int(np.ceil(np.log2(max(1.0, share[r["source"]] * sharding.PARTS)))))
        it = items.setdefault((r["source"], r["slot"] % min(cut, n_slots)), [0, 0, 0])
        for d, v in enumerate((r["b"], r["w"], 1)):
            it[d] += v
    keys = sorted(items)
    at = dict(zip(keys, brute_groups([items[k] for k in keys], [k[0] for k in keys], shards)))
    want = {r["doc_id"]: at[r["source"], r["slot"] % min(1 << max(0, int(np.ceil(np.log2(max(1.0, share[r["source"]] * sharding.PARTS))))), n_slots)] for r in rows_}
    got = {r["doc_id"]: r["shard_id"] for r in queries.QUERIES["op3_sharding"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_groups_that_fit_stay_whole(spark):
    df = spark.createDataFrame([(i, "a b c", f"g{min(i // 50, 9)}") for i in range(1000)], "doc_id bigint, text string, source string")
    out = sharding.shard(df, 4)
    spread = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.countDistinct("shard_id").alias("n")).collect()}
    assert spread.pop("g9") > 1 and set(spread.values()) == {1}  # g9 is 2.2 shards, the others 0.2 each
    sizes = [r["count"] for r in out.groupBy("shard_id").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 250 * 1.15


def test_balance_and_whole_groups(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    out = sharding.shard(docs, 8)
    assert out.columns == ["doc_id", "source", "shard_id"]
    assert out.count() == docs.count()
    sums = out.join(docs.drop("source"), "doc_id").groupBy("shard_id").agg({"n_chars": "sum", "doc_id": "count"}).collect()
    assert len(sums) == 8
    for i in (1, 2):
        sizes = [r[i] for r in sums]
        assert max(sizes) / (sum(sizes) / 8) < 1.15
    # 20 sources of about 2.5 shard eighths each are cut into few parts, never scattered
    assert out.select("source", "shard_id").distinct().count() <= 20 * 8


def test_a_small_group_stays_together(spark):
    df = spark.createDataFrame([(i, "a b c", f"g{i % 40}") for i in range(400)], "doc_id bigint, text string, source string")
    spread = sharding.shard(df, 4).groupBy("source").agg({"shard_id": "min"}).count()
    assert sharding.shard(df, 4).select("source", "shard_id").distinct().count() == spread == 40


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = sharding.shard(docs, 3)
    assert sorted((r[0], r[1]) for r in out.fillna({"doc_id": -1, "source": "-"}).collect()) == sorted((r["doc_id"], r["source"]) for r in docs.fillna({"doc_id": -1, "source": "-"}).collect())
    assert out.where("shard_id < 0 or shard_id > 2 or shard_id is null").count() == 0
    assert out.where("doc_id = 1 and source = 'src0'").select("shard_id").distinct().count() == 1
    assert rows(sharding.shard(docs.limit(0), 3)) == []
