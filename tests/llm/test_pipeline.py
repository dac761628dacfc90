from collections import Counter

import corpus_pipeline
import pytest
from common import odd_docs
from test_mixing import inverse, unit
from test_packing import slow_best_fit

from compare import compare
from ripplemark.llm import mixing, packing, queries, simhash, toxicity
from ripplemark.llm.shared import materialize, read

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name, queries.QUERIES[name], queries.ORACLE_SQL[name]).startswith("equal")


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mixing", "best_fit_packing"]


def test_each_stage_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    first = materialize(corpus_pipeline.reject_toxic(spark, docs, SF), "t")
    model = toxicity.train(docs, read(spark, SF, "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = dict(zip(text, toxicity.Scorer(model).scores(list(text.values()))))
    assert first.columns == columns
    assert {r["doc_id"] for r in first.collect()} == {d for d, s in score.items() if s < model.threshold}

    second = materialize(corpus_pipeline.drop_near_duplicates(spark, first, SF), "d")
    left = sorted(r["doc_id"] for r in first.collect())
    prints = {d: f for d in left if (f := simhash.fingerprint(text[d]))}
    root = {d: d for d in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(left):
        for b in left[i + 1 :]:
            if a in prints and b in prints and sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(prints[a], prints[b])) <= simhash.MAX_DISTANCE:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {d for d in left if find(d) == d}
    kept = {r["doc_id"] for r in second.collect()}
    assert second.columns == columns and want <= kept  # search is approximate: at most a copy too many
    assert len(kept - want) <= 0.05 * (len(left) - len(want)) + 1

    third = materialize(corpus_pipeline.mix_sources(spark, second, SF), "m")
    assert third.columns == columns
    mixed = third.collect()
    left = {r["doc_id"]: r for r in second.collect()}
    size, weight = Counter(), {}
    for r in left.values():
        size[r["source"]] += len(r["text"].split())
        weight[r["source"]] = mixing.WEIGHTS.get(r["source"], mixing.DEFAULT_WEIGHT)
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) * mixing.EPOCHS / size[s] if size[s] else 0.0 for s in size}
    times = {d: inverse(rate[r["source"]], unit(mixing.SEED, d)) if rate[r["source"]] else 0 for d, r in left.items()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in times.items() if n})
    assert all(r == left[r["doc_id"]] for r in mixed)

    last = corpus_pipeline.pack_sequences(spark, third, SF)
    words = sum(len(r["text"].split()) for r in third.collect())
    assert last.agg({"n_tokens": "sum"}).first()[0] == words
    lengths = Counter()
    for r in mixed:
        n = len(r["text"].split())
        lengths.update(min(packing.CAPACITY, n - i) for i in range(0, n, packing.CAPACITY))
    pieces = [r for r in last.collect() if r["n_tokens"]]
    assert Counter(r["n_tokens"] for r in pieces) == lengths
    grain = packing.CAPACITY // packing.UNITS
    histogram = Counter()
    for n, times_ in lengths.items():
        histogram[-(-n // grain)] += times_
    assert len({r["bin_id"] for r in pieces}) <= slow_best_fit(histogram, packing.UNITS)
    assert last.groupBy("bin_id").agg({"n_tokens": "sum"}).where(f"bin_id is not null and `sum(n_tokens)` > {packing.CAPACITY}").count() == 0


def test_stages_survive_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == docs.columns
        out.collect()
        stage(spark, docs.limit(0), SF).collect()
