import hashlib
import math
from collections import Counter

from common import odd_docs, rows

from ripplemark.llm import mixing
from ripplemark.llm.shared import read


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def inverse(rate, u):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_every_count_is_the_inverse_of_its_poisson_distribution(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    weights = {"src0": 30.0, "src1": 5.0, "src2": 0.1}
    data = docs.select("doc_id", "source", "text").collect()
    size = Counter()
    for r in data:
        size[r["source"]] += len(r["text"].split())
    weight = {s: weights.get(s, 1.0) for s in size}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) * 2 / size[s] for s in size}
    want = {r["doc_id"]: inverse(rate[r["source"]], unit(mixing.SEED, r["doc_id"])) for r in data}
    got = Counter(r["doc_id"] for r in mixing.mix(docs, weights, epochs=2.0).select("doc_id").collect())
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert mixing.mix(docs, weights).columns == docs.columns


def test_rates_reach_the_target_weights(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    found = {r["source"]: r for r in mixing.rates(docs, {"src0": 7.0}).collect()}
    expected = {s: r["rate"] * r["size"] for s, r in found.items()}
    assert all(abs(expected["src0"] / expected[s] - 7) < 1e-9 for s in expected if s != "src0")


def test_the_order_mixes_sources(spark):
    got = mixing.mixture_rows(read(spark, "/root/testdata/sf0.01", "documents")).orderBy("shuffle_key").select("source").limit(300).collect()
    assert len({r[0] for r in got}) >= 15


def test_documents_without_an_id_are_drawn_apart(spark):
    df = spark.createDataFrame([(None, f"word number {i}", "a") for i in range(400)], "doc_id bigint, text string, source string")
    got = Counter(Counter(r[0] for r in mixing.mix(df, {}).select("text").collect()).values())
    assert 80 < got[1] < 220 and 30 < got[2] < 120 and 250 < 400 - sum(got.values()) + 150 < 400


def test_the_distribution_is_exact_and_linear_in_the_rate():
    assert mixing.poisson_cdf(0.0).tolist() == mixing.poisson_cdf(None).tolist() == [1.0]
    for rate in (0.01, 1.0, 7.5, 300.0):
        want, term = 0.0, math.exp(-rate)
        for k, got in enumerate(mixing.poisson_cdf(rate)):
            want += term
            term *= rate / (k + 1)
            assert abs(got - want) < 1e-11
    assert abs(mixing.poisson_cdf(2e6)[-1] - 1) < 1e-6


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mix(docs, {"src0": 4.0}, epochs=30.0)
    assert out.columns == docs.columns
    assert out.where("doc_id is null and text is not null").count() > 0
    same = Counter(r[0] for r in out.where("doc_id = 1 and source = 'src0'").select("text").collect())
    assert all(v % 2 == 0 for v in same.values())  # rows that repeat an id have the same draw
    assert out.where("source = ''").count() == 0  # a source of no words has rate zero
    assert rows(mixing.mix(docs.limit(0))) == []
    assert rows(mixing.mix(docs, {})) == rows(mixing.mix(docs, {}))
