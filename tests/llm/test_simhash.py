import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from common import odd_docs, rows
from pyspark.sql import functions as F

from ripplemark.llm import components, simhash
from ripplemark.llm.shared import materialize, read


def slow_distance(a, b):
    return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))


def test_distances_count_the_sign_bit():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63, (40, 4))
    got = simhash._distances(a[:, None], a[None])
    assert all(got[i, j] == slow_distance(a[i].tolist(), a[j].tolist()) for i in range(40) for j in range(40))


def brute_pairs(docs, distance):
    fps = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect()]
    ids, raw = np.array([i for i, f in fps if f]), np.array([f for _, f in fps if f])
    out = {}
    for s in range(0, len(raw), 200):
        d = simhash._distances(raw[s : s + 200, None], raw[None, s:])
        for i, j in zip(*np.nonzero(d <= distance)):
            if j > i:
                a, b = sorted((int(ids[s + i]), int(ids[s + j])))
                out[a, b] = int(d[i, j])
    return out


def test_recall_against_all_pairs(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute_pairs(docs, simhash.MAX_DISTANCE)
    # Small buckets, so that as many bits are sampled as on a table a hundred times as large.
    got = {(r["a"], r["b"]): r["distance"] for r in simhash.near_pairs(docs, bucket=4).collect()}
    assert got.items() <= want.items()
    assert len(got) >= 0.9 * len(want)


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(2, 9)))
    words = [word() for _ in range(6000)]
    docs, group = [], {}
    for g in range(60):
        base = rng.choices(words, k=rng.randint(80, 600))
        for c in range(1 + (g % 3) * 2):
            copy = [rng.choice(words) if c and rng.random() < 0.06 else w for w in base]
            group[len(docs)] = g
            docs.append((len(docs), " ".join(copy), "en", "s", 1))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(group[k] for k in kept) == list(range(60))
    assert all(k == min(i for i in group if group[i] == group[k]) for k in kept)
    found = {r["doc_id"]: (r["group_id"], r["keep"]) for r in simhash.near_groups(df).collect()}
    assert {k for k, (_, keep) in found.items() if keep} == set(kept)


def hot(n, seed=3):
    """``n`` distinct fingerprints that differ from one in three bits at most, and as many others."""
    rng = np.random.default_rng(seed)
    bits = np.repeat(rng.integers(0, 2, (1, 256), np.uint8), n, axis=0)
    flip = rng.integers(0, 256, (n, 3))
    np.put_along_axis(bits, flip, 1 - np.take_along_axis(bits, flip, axis=1), axis=1)
    near = np.unique(np.packbits(bits, axis=1).view(np.int64), axis=0)
    return near, rng.integers(-(2**63), 2**63, (n, 4), dtype=np.int64)


def test_oversized_buckets_are_split_before_they_are_gathered(spark):
    near, far = hot(8_000)
    data = pa.table({"id": np.arange(len(near) + len(far)), "fp": pa.array(np.concatenate((near, far)).tolist(), pa.list_(pa.int64()))})
    df = spark.createDataFrame(data)
    for cap in (200, 5000):
        out = materialize(simhash._buckets(df, 4, 3, cap, 7)[0], "b")
        sizes = [r["count"] for r in out.groupBy("tab", "bucket").count().collect()]
        assert max(sizes) <= cap and sum(sizes) == 3 * len(data)
        assert out.groupBy("id").agg(F.countDistinct("tab").alias("t")).where("t = 3").count() == len(data)
    roots = simhash.components(df, 0.9, 2000, 200, 7, 46)
    assert roots.where(f"node < {len(near)} and root = 0").count() == len(near)  # split, and still one group
    assert roots.where(f"node >= {len(near)}").count() == 0


def test_fingerprints_against_their_definition():
    rng = random.Random(2)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 80)))
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_fingerprint(text):
    import re

    import xxhash

    votes = [0] * 256
    for w in set(re.findall(r"\w+", text.lower())):
        h, bits = xxhash.xxh3_64_intdigest(w), []
        for k in range(4):
            z = (h + 0x9E3779B97F4A7C15 * (k + 1)) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            for byte in z.to_bytes(8, "little"):
                bits += [byte >> 7 - i & 1 for i in range(8)]
        for i, b in enumerate(bits):
            votes[i] += (2 * b - 1) * (min(max(len(w), 2), 10) - 1)
    raw = bytes(sum((votes[s + i] >= 0) << 7 - i for i in range(8)) for s in range(0, 256, 8))
    return [int.from_bytes(raw[s : s + 8], "little", signed=True) for s in range(0, 32, 8)]


def test_ids_of_any_type(spark):
    data = [("b", "one two three four five"), ("a", "one two three four five"), ("c", "something else in other words here"), (None, "one two three four five")]
    df = spark.createDataFrame(data, "doc_id string, text string")
    assert rows(simhash.near_pairs(df)) == [("a", "b", 0)]
    assert rows(simhash.near_groups(df)) == sorted([("a", "a", True), ("b", "a", False), ("c", "c", True), (None, None, True)], key=repr)
    assert rows(simhash.drop_near_duplicates(df).select("doc_id")) == sorted([("a",), ("c",), (None,)], key=repr)
    assert rows(simhash.near_pairs(df.selectExpr("cast(ascii(doc_id) as decimal(5, 1)) as doc_id", "text"))) == [("97.0", "98.0", 0)]


def test_tables_follow_the_bits():
    assert simhash.table_count(0, 46) == 1
    for bits in (5, 10, 20):
        t = simhash.table_count(bits, 46)
        agree = (1 - 46 / 256) ** bits
        assert 1 - (1 - agree) ** t >= 0.9 > 1 - (1 - agree) ** (t - 1)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2060)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in list(root))
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert rows(components.connected_components(df)) == sorted(want, key=repr)
    assert rows(components.connected_components(df.limit(0))) == []


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = defaultdict(int)
    for r in out.collect():
        kept[r["doc_id"], r["text"][:9] if r["text"] else r["text"]] += 1
    assert kept[1, "some plai"] == 1 and kept[2, None] == kept[3, ""] == kept[None, None] == kept[None, "text with"] == kept[5, " \t\n"] == 1
    groups = simhash.near_groups(docs)
    assert groups.count() == docs.count()
    assert groups.where("doc_id is null and keep").count() == 2
    empty = docs.limit(0)
    assert rows(simhash.near_groups(empty)) == rows(simhash.drop_near_duplicates(empty)) == rows(simhash.near_pairs(empty)) == []
    assert simhash.near_pairs(docs).where("a is null or b is null or a >= b").count() == 0
