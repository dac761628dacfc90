import numpy as np
import pytest
from common import LONG, odd_docs, rows

from ripplemark.llm import queries, toxicity
from ripplemark.llm.shared import read


@pytest.fixture(scope="module")
def labelled(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    labels = read(spark, "/root/testdata/sf0.1", "labels")
    got = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    return [r["text"] for r in got], [r["toxic"] for r in got]


@pytest.fixture(scope="module")
def model(labelled):
    texts, y = labelled
    cut = len(texts) * 2 // 3
    return toxicity.fit(texts[:cut], y[:cut])


def test_held_out_accuracy(labelled, model):
    texts, y = labelled
    cut = len(texts) * 2 // 3
    said = toxicity.Scorer(model).scores(texts[cut:]) >= model.threshold
    y = np.array(y[cut:]) == 1
    assert said[y].mean() > 0.7
    assert said[~y].mean() < 0.02


def test_unseen_misspellings(model):
    score = toxicity.Scorer(model).scores
    pad = " ".join(["the of and to in is was for"] * 3)
    for word in ("idiott", "stupiid", "patheticc", "worthlesss"):
        assert score([f"{pad} {word} you {word} {pad}"])[0] > score([f"{pad} table you table {pad}"])[0]


def test_one_toxic_word_anywhere_in_a_long_text_is_found(model):
    plain, bad = toxicity.Scorer(model).scores([LONG, LONG + " stupid moron idiot " + LONG])
    assert bad > 0.9 > plain


def brute(model, text):
    words = toxicity.tokens(text)
    number = [model.word_scores([w])[0] for w in words]
    windows = [number[i : i + toxicity.WINDOW] for i in range(max(1, len(number) - toxicity.WINDOW + 1))]
    return 1 / (1 + np.exp(-(max(np.mean(w) for w in windows) + model.bias))) if words else 0.0


def test_scores_against_brute_force(model):
    texts = ["one", "", None, "a b c d e f g h", "stupid " * 30, "x y z " * 11 + "moron", "  \n"]
    got = toxicity.Scorer(model).scores(texts)
    assert np.allclose(got, [brute(model, t or "") for t in texts])


def test_the_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.QUERIES["op8_toxicity"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert r["toxic"] == (r["score"] >= model.threshold)
        if len(text[r["doc_id"]]) < 4000:
            assert abs(r["score"] - brute(model, text[r["doc_id"]])) < 1e-9


def test_long_texts_are_not_sampled_but_scored(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TEXT_CHARS", 1000)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **_: seen.append(list(texts)) or toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, 0.5))
    df = spark.createDataFrame([(i, "word " * (120 if i else 5000)) for i in range(9)], "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id bigint, toxic int"))
    assert len(seen[0]) == 6 and max(map(len, seen[0])) == 600
    assert toxicity.classify(df, model).count() == 9


def test_one_class_only():
    assert toxicity.fit(["a b"], [0]).threshold > 1
    assert toxicity.fit([], []).threshold > 1
    assert toxicity.fit(["a b"], [1]).threshold == 0


def test_odd_rows(spark, model):
    docs = odd_docs(spark)
    out = toxicity.drop_toxic(docs, model)
    assert out.columns == docs.columns
    said = toxicity.classify(docs, model)
    assert said.count() == docs.count() and said.where("score is null or toxic <> (score >= %r)" % model.threshold).count() == 0
    assert out.count() == said.where("not toxic").count()
    assert out.where("text is null or length(trim(text)) < 3").count() == docs.where("text is null or length(trim(text)) < 3").count()
    assert rows(toxicity.classify(docs.limit(0), model)) == []
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (4, None), (5, 0), (5, 0)], "doc_id bigint, toxic int")
    assert rows(toxicity.sample_labels(labels)) == [(1, 1), (2, 1), (5, 0)]
    assert toxicity.train(docs, labels.limit(0)).threshold > 1
    toxicity.train(docs, labels)


def test_the_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(1000).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    a = rows(toxicity.sample_labels(labels, per_class=50))
    assert len(a) == 100 and a == rows(toxicity.sample_labels(labels.repartition(7), per_class=50))
