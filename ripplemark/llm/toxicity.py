"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 6-grams (with ``<`` and ``>`` at its ends) and itself, hashed
into ``BUCKETS`` rows of an embedding table. A word's vector is the mean of its rows, a window's vector the
mean over ``WINDOW`` consecutive words, and a linear softmax turns that into the probability of toxicity.
Rows and softmax are trained together by Adagrad. A misspelling that was never seen shares most of its
n-grams with the known word, so it gets nearly the same vector.

Labels are per document while a few words make it toxic, so training alternates (multiple-instance
learning): score all windows of the sampled documents, take the highest of each toxic document as positive
and the highest and some random ones of each clean document as negative, train on.
A document's score is the highest over its windows; every word of every text is scored.

Because averaging and the softmax are linear up to the final logistic, a trained model folds to one number
per bucket (1 MB at 2**18 buckets, whatever the corpus); scoring adds up cached word numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, uniform

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 6)
WINDOW = 8
#: Labelled documents of each class that the classifier is fitted on, at most.
SAMPLE_PER_CLASS = 3000
#: Characters of the sampled texts of each class, in all, and of a text that is sampled; they bound the driver's memory.
SAMPLE_CHARS, TEXT_CHARS = 32_000_000, 1_000_000
#: Windows of toxic texts that training starts from, at random places (4 a text at least); from the next pass on it looks at all.
START_WINDOWS = 40_000
#: From the third pass on, a toxic text whose likeliest window has a lower log-odds teaches nothing in that pass: it is taken for mislabelled.
NOISE = -1.0
SEED = "toxicity-v1"
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_CACHE_WORDS = 400_000
_WORDS = 20_000
_CHUNK_CHARS = 1 << 20


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashed_subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the words, in no order, and the word that each belongs to."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lens)
    starts = ends - lens
    owner = np.repeat(np.arange(len(words)), lens)
    left = ends[owner] - np.arange(len(codes))
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(lens.max()), _P))
        whole = np.add.reduceat((codes + np.uint64(7)) * power[np.arange(len(codes)) - starts[owner]], starts)
        hashes, owners = [whole ^ np.uint64(0xABCDEF)], [np.arange(len(words))]
        rolling = codes
        for n in range(2, NGRAMS[1] + 1):
            if len(codes) < n:
                break
            rolling = rolling[:-1] * _P + codes[n - 1 :]
            if n >= NGRAMS[0]:
                inside = np.flatnonzero(left[: len(rolling)] >= n)
                hashes.append(rolling[inside] + np.uint64(n))
                owners.append(owner[inside])
        flat, by = np.concatenate(hashes), np.concatenate(owners)
        flat = (flat ^ (flat >> np.uint64(31))) * _MIX
        flat ^= flat >> np.uint64(33)
    return (flat & np.uint64(BUCKETS - 1)).astype(np.int32), by


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the words, word after word, and each word's number of features."""
    flat, by = hashed_subwords(words)
    return flat[np.argsort(by, kind="stable")], np.bincount(by, minlength=len(words))


@dataclass(frozen=True)
class Model:
    """A folded model: bucket weights (embedding row times softmax difference), bias and decision threshold."""

    weights: np.ndarray
    bias: float
    threshold: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        flat, by = hashed_subwords(words)
        return np.bincount(by, self.weights[flat], len(words)) / np.bincount(by, minlength=len(words))


class Scorer:
    """Scores texts with a model; word numbers are cached up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _chunk(self, docs: list[list[str]]) -> np.ndarray:
        words = [w for d in docs for w in d]
        new = [w for w in set(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > _CACHE_WORDS:
                self.known.clear()
                new = list(set(words))
            self.known.update(zip(new, self.model.word_scores(new).tolist()))
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        return window_maxima(scores, np.array([len(d) for d in docs], np.int64)) + self.model.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of toxicity for each text; 0 for null texts and texts without words."""
        out = np.zeros(len(texts))
        docs, at, chars = [], [], 0
        for i, text in enumerate(texts):
            words = tokens(text) if text else []
            if words:
                docs.append(words)
                at.append(i)
                chars += len(text)
            if docs and (chars > _CHUNK_CHARS or i == len(texts) - 1):
                logit = np.clip(self._chunk(docs), -60, 60)
                out[at] = 1 / (1 + np.exp(-logit))
                docs, at, chars = [], [], 0
        if docs:
            out[at] = 1 / (1 + np.exp(-np.clip(self._chunk(docs), -60, 60)))
        return out


def window_maxima(scores: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each document, the highest mean over WINDOW consecutive scores (over all where there are fewer)."""
    ends = np.cumsum(lens)
    starts = ends - lens
    total = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.arange(len(scores))
    doc_end = np.repeat(ends, lens)
    stop = np.minimum(at + WINDOW, doc_end)
    mean = (total[stop] - total[at]) / (stop - at)
    tail = (stop - at < WINDOW) & (np.repeat(lens, lens) >= WINDOW)
    mean[tail | ((np.repeat(lens, lens) < WINDOW) & (at != np.repeat(starts, lens)))] = -np.inf
    return np.maximum.reduceat(mean, starts)


def fit(texts: Iterable[str | None], labels: list[int], seed: int = 7, rounds: int = 8, clean_weight: float = 1.0) -> Model:
    """Train on labelled texts; a fifth of them is held out and sets the threshold.

    ``clean_weight`` says how many clean documents each clean one of the sample stands for, per toxic one.

    Texts without words are left out. With only one class among the labels nothing can be learned: the
    model then scores every text as that class's rate would (threshold above 1 for none toxic).
    """
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs, keep = [], []  # word numbers of each text that has words; the words themselves are kept once
    for i, text in enumerate(texts):
        words = tokens(text) if text else []
        if words:
            docs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
            keep.append(i)
    y = np.array([int(labels[i]) for i in keep], np.int64)
    if len(set(y.tolist())) < 2:
        only = bool(len(y) and y[0])
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0 if only else 2.0)
    vocabulary = list(index)
    parts = [subwords(vocabulary[s : s + _WORDS]) for s in range(0, len(vocabulary), _WORDS)]
    feats, counts = (np.concatenate(x) for x in zip(*parts))
    del index, vocabulary, parts
    begins = np.cumsum(counts) - counts
    lens = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate(docs)
    del docs
    base = np.cumsum(lens) - lens
    held = rng.random(len(y)) < 0.2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    head = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_head, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)

    def train(windows: np.ndarray, target: np.ndarray, rate: float) -> None:
        nonlocal emb, head, bias, g_head, g_bias
        order = rng.permutation(len(windows))
        for s in range(0, len(order), 512):
            rows = order[s : s + 512]
            start, stop = windows[rows, 0], windows[rows, 1]
            n = stop - start
            ahead = np.cumsum(n) - n
            # Words that several windows of a batch share are looked up once.
            words, slot = np.unique(flat[np.repeat(start - ahead, n) + np.arange(int(n.sum()))], return_inverse=True)
            c = counts[words]
            before = np.cumsum(c) - c
            refs = feats[np.repeat(begins[words] - before, c) + np.arange(int(c.sum()))]
            per_word, per_window = (1 / c).astype(np.float32)[:, None], (1 / n).astype(np.float32)[:, None]
            vectors = np.add.reduceat(emb[refs], before, axis=0) * per_word
            hidden = np.add.reduceat(vectors[slot], ahead, axis=0) * per_window
            logits = hidden @ head + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            grad = p / len(rows) * 64
            g_hid = grad @ head.T
            d_head, d_bias = hidden.T @ grad, grad.sum(axis=0)
            spread = np.repeat(g_hid * per_window, n, axis=0)
            by = np.argsort(slot, kind="stable")
            g_word = np.add.reduceat(spread[by], np.searchsorted(slot[by], np.arange(len(words))), axis=0) * per_word
            by = np.argsort(refs, kind="stable")
            sorted_refs = refs[by]
            cut = np.flatnonzero(np.concatenate(([True], sorted_refs[1:] != sorted_refs[:-1])))
            d_emb = np.add.reduceat(np.repeat(g_word, c, axis=0)[by], cut, axis=0)
            hit = sorted_refs[cut]
            g_emb[hit] += (d_emb**2).mean(axis=1)
            emb[hit] -= rate * d_emb / np.sqrt(g_emb[hit])[:, None]
            g_head += d_head**2
            head -= rate * d_head / np.sqrt(g_head)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)

    def folded() -> Model:
        return Model(emb @ (head[:, 1] - head[:, 0]), float(bias[1] - bias[0]), 0.5)

    def word_numbers(model: Model) -> np.ndarray:
        total = np.empty(len(begins))
        for s in range(0, len(begins), _WORDS):
            own = begins[s : s + _WORDS]
            part = feats[own[0] : own[-1] + counts[s + len(own) - 1]]
            total[s : s + _WORDS] = np.add.reduceat(model.weights[part].astype(np.float64), own - own[0])
        return (total / counts)[flat]

    def window(doc: int, at: int) -> tuple[int, int]:
        start = base[doc] + max(0, min(at, lens[doc] - WINDOW))
        return start, min(start + WINDOW, base[doc] + lens[doc])

    pos, neg = np.flatnonzero((y == 1) & ~held), np.flatnonzero((y == 0) & ~held)
    spans, target = [], []
    room = max(4, START_WINDOWS // len(pos))
    for d in pos:
        places = np.arange(0, lens[d], WINDOW // 2)
        for a in places if len(places) <= room else rng.choice(places, room, replace=False):
            spans.append(window(d, int(a)))
            target.append(1)
    n_pos, n_neg = len(spans), max(1, len(spans) // len(neg))
    for d in neg:
        for a in rng.integers(0, lens[d], n_neg):
            spans.append(window(d, int(a)))
            target.append(0)
    for _ in range(2):
        train(np.array(spans), np.array(target), 0.3)
    for turn in range(rounds):
        model = folded()
        number = word_numbers(model)
        total = np.concatenate(([0.0], np.cumsum(number)))
        spans, target = [], []
        for d in np.concatenate((pos, neg)):
            starts = np.arange(base[d], max(base[d] + 1, base[d] + lens[d] - WINDOW + 1))
            stops = np.minimum(starts + WINDOW, base[d] + lens[d])
            logit = (total[stops] - total[starts]) / (stops - starts) + model.bias
            if y[d]:
                best = int(logit.argmax())
                if turn < 2 or logit[best] > NOISE:  # a toxic label with nothing toxic in the text teaches only noise
                    spans.append((starts[best], stops[best]))
                    target.append(1)
                    if turn >= 2:
                        for i in np.flatnonzero(logit > 1)[:: WINDOW // 2][:3]:
                            spans.append((starts[i], stops[i]))
                            target.append(1)
            else:
                hard = np.argpartition(-logit, min(2, len(logit) - 1))[:2]
                for i in {*hard.tolist(), *rng.integers(0, len(starts), 3).tolist()}:
                    spans.append((starts[i], stops[i]))
                    target.append(0)
        for _ in range(2):
            train(np.array(spans), np.array(target), 0.15)
    model = folded()
    rows = np.flatnonzero(held) if held.any() else np.arange(len(y))
    number = word_numbers(model)
    best = np.array([window_maxima(number[base[d] : base[d] + lens[d]], lens[d : d + 1])[0] for d in rows]) + model.bias
    return Model(model.weights, model.bias, _threshold(1 / (1 + np.exp(-np.clip(best, -60, 60))), y[rows], clean_weight))


def _threshold(score: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    """The middle of the gap between scores at which F1 is highest, but not under 0.5, where clean is the likelier."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (hits + clean_weight * np.cumsum(1 - y[order]) + y.sum())
    i = int(f1.argmax())
    below = score[order[i + 1]] if i + 1 < len(order) else 0.0
    return max(0.5, float((score[order[i]] + below) / 2))


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, by hash order: the same at every run, spread over the table.

    Rows with a null id or label are left out; an id with different labels counts as toxic; repeated rows count once.
    """
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    clean = clean.groupBy("id").agg(F.max("y").alias("y")).withColumn("u", uniform(SEED, F.col("id")))
    parts = [clean.where(F.col("y") == c).orderBy("u", "id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).select("id", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a bounded labelled sample of ``docs``: at most ``per_class`` texts of each class come to the driver, of ``TEXT_CHARS``
    characters at most each, and in hash order no more than have ``SAMPLE_CHARS`` characters together. Scoring has no such bounds.

    Repeated ids in ``docs`` give one text (the least). No labelled document at all gives a model that rejects nothing.
    """
    sample = sample_labels(labels, id_col, label_col, per_class)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.where(F.length("text") <= TEXT_CHARS).join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    # At most ``2 * per_class`` rows.
    total = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(uniform(SEED, F.col("id")), "id"))
    rows = texts.withColumn("total", total).where(F.col("total") <= SAMPLE_CHARS).select("id", "text", "y").toArrow().sort_by("id")
    y = rows["y"].to_pylist()
    classes = labels.agg(*[F.count(F.when(F.col(label_col) == c, 1)).alias(f"n{c}") for c in (0, 1)]).first()
    weight = classes["n0"] / max(1, y.count(0)) * y.count(1) / max(1, classes["n1"])
    # One text at a time becomes a Python string.
    return fit((t.as_py() for t in rows["text"]), y, clean_weight=weight)


def score_column(spark, text: Column, model: Model) -> Column:
    """The score of each text, by an Arrow function; null and word-free texts score 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.array(scorer.scores(batch.to_pylist()), pa.float64())

    return score(text.cast("string"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, score and whether the score reaches the model's threshold.

    Repeated rows are scored each; null ids stay; other columns are not carried, so none can clash.
    """
    score = score_column(docs.sparkSession, F.col("text"), model)
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", score.alias("score"))
    return scored.select(F.col("id").alias(id_col), F.col("score"), (F.col("score") >= F.lit(model.threshold)).alias("toxic"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without those whose score reaches the threshold, with all their columns and no other."""
    (name,) = fresh(docs, "toxicity")
    scored = docs.withColumn(name, score_column(docs.sparkSession, docs[text_col], model))
    return scored.where(F.col(name) < F.lit(model.threshold)).drop(name)
