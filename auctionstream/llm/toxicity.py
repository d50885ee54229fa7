"""Toxicity by multiple-instance learning: labels of documents train scores of sentences."""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.llm.common import bytes_of

#: Labelled documents that the model is fitted on: at most so many of either label, by the hash of the text.
SAMPLE_PER_LABEL = 3_000
#: The log-likelihood ratio by which a feature must go with toxic documents of the sample (p of about 0.002).
LEAST_RATIO = 10.0
#: Features that get a weight at most: those with the largest ratios.
MOST_FEATURES = 50_000
PREFIX = 5
#: Strength of the pull of weights towards 0.
RIDGE = 1e-6
THRESHOLD = 0.3
SENTENCE = re.compile(rb"[^.!?\n]+[.!?]*")


@dataclass(frozen=True)
class Model:
    """Weights of features; a sentence's probability is the logistic function of bias plus their sum."""

    weights: dict[bytes, float]
    bias: float


def not_held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def words_of(sentence: bytes) -> list[bytes]:
    """Lower-cased words without the marks around them."""
    return [w for x in sentence.lower().split() if (w := x.strip(b".,;:!?\"'()[]*#$%&|<>-"))]


def features(sentence: bytes) -> set[bytes]:
    """The words of a sentence, and the first letters of longer ones as stems."""
    words = set(words_of(sentence))
    return words | {w[:PREFIX] + b"~" for w in words if len(w) > PREFIX}


def _sentences(text: bytes) -> list[set[bytes]]:
    return [f for m in SENTENCE.finditer(text) if (f := features(m[0]))]


def _known(labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id and toxic: the labels that may be used, one per id."""
    known = labels.where(F.col("toxic").isin(0, 1) & usable & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int) -> list[tuple[int, bytes]]:
    """Up to ``per_label`` labelled texts of either label: those whose ids have the smallest hashes."""
    known = _known(labels, usable)
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == x).orderBy(order, "doc_id").limit(per_label) for x in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_label rows at most
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(few, "doc_id")
    found = rows.orderBy(order, F.xxhash64("text")).limit(2 * per_label)  # an id may be repeated
    return [(r.toxic, r.text.encode()) for r in found.collect()]


def _telling(bags: list[tuple[int, list[tuple[bytes, ...]]]]) -> list[bytes]:
    """Features found in toxic documents more often than chance explains, the most telling first."""
    n = Counter(label for label, _ in bags)
    counts = {x: Counter(f for label, bag in bags if label == x for f in set().union(*bag)) for x in (0, 1)}
    ratios = {}
    for f, a in counts[1].items():
        b = counts[0][f]
        if a * n[0] > b * n[1]:
            share = (a + b) / (n[0] + n[1])
            cells = ((a, n[1] * share), (n[1] - a, n[1] * (1 - share)), (b, n[0] * share), (n[0] - b, n[0] * (1 - share)))
            ratios[f] = 2 * sum(o * math.log(o / e) for o, e in cells if o and e)
    return sorted((f for f, x in ratios.items() if x >= LEAST_RATIO), key=lambda f: (-ratios[f], f))


def _fit(bags: list[tuple[int, list[np.ndarray]]], n_features: int, priors: dict[int, float], steps: int = 400):
    """Weights and bias that maximise the likelihood of the document labels under noisy-or, by Adam.

    A document is clean if all its sentences are: log P(clean) is the sum of log(1 - p) over sentences.
    ``priors`` weigh the labels as often as they are found, since the sample takes them evenly.
    """
    instance_doc = np.repeat(np.arange(len(bags)), [len(b) for _, b in bags])
    instances = [x for _, bag in bags for x in bag]
    lengths = np.array([len(x) for x in instances], np.int64)
    columns = np.concatenate(instances) if instances else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(instances)), lengths)
    toxic = np.array([label for label, _ in bags], bool)
    weight = np.array([priors[label] for label, _ in bags])
    w, b = np.zeros(n_features), -4.0
    state = [np.zeros(n_features + 1), np.zeros(n_features + 1)]
    for step in range(1, steps + 1):
        z = np.clip(b + np.bincount(rows, w[columns], len(instances)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(instance_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        # d log-likelihood / d log P(clean): 1 for clean documents, -P(clean) / P(toxic) for toxic ones.
        odds = np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9)
        slope = weight * np.where(toxic, np.minimum(odds, 1e3), -1.0)
        each = slope[instance_doc] * p / weight.sum()
        gradient = np.append(np.bincount(columns, each[rows], n_features) - RIDGE * w, each.sum())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, b = w + move[:-1], b + move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit the sentence scores on documents with a label for which ``usable`` holds.

    The sample has at most ``per_label`` documents of each label. Only features that go with its toxic
    documents beyond chance get a weight. Labels other than 0 and 1 and null texts are left out; of repeated
    labels the larger counts. Without any label, or with only one kind, every document scores the share of toxic
    labels with Laplace's correction. Labels that are not usable, or of no document, change nothing.
    """
    sample = _sample(docs, labels, usable, per_label)
    found = _known(labels, usable).join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    known = found.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    share = ((known.toxic or 0) + 1) / (known.n + 2)
    one: dict[bytes, bytes] = {}  # one object per feature: the sample repeats most
    bags = [(label, [tuple(one.setdefault(f, f) for f in s) for s in _sentences(text)]) for label, text in sample]
    chosen = _telling(bags)[:MOST_FEATURES]
    place = {f: i for i, f in enumerate(chosen)}
    if len({label for label, _ in bags}) < 2 or not place:
        return Model({}, float(np.log(share / (1 - share))))
    numbered = [(label, [np.array(sorted(place[f] for f in s if f in place), np.int64) for s in bag]) for label, bag in bags]
    n = Counter(label for label, _ in bags)
    w, b = _fit(numbered, len(place), {0: (1 - share) / n[0], 1: share / n[1]})
    return Model({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-6}, float(b))


def score_text(text: bytes, model: Model, threshold: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of the sentences' probabilities, and the offending ones as (begin, end, p) in bytes."""
    weights, bias = model.weights, model.bias
    clean, offending, seen = 0.0, [], False
    for match in SENTENCE.finditer(text):
        words = set(words_of(match[0]))
        if not words:
            continue
        seen = True
        z = bias + sum([weights.get(w, 0.0) for w in words])
        z += sum([weights.get(w, 0.0) for w in {w[:PREFIX] + b"~" for w in words if len(w) > PREFIX}])
        p = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
        clean += math.log1p(-min(p, 1 - 1e-12))
        if p >= threshold:
            offending.append((*match.span(), p))
    if not seen:
        clean = math.log1p(-1 / (1 + math.exp(-min(max(bias, -30.0), 30.0))))
    return -math.expm1(clean), offending


def _scores(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    for batch in batches:
        found = [score_text(x, model, threshold) for x in bytes_of(batch.column("text"))]
        spans = [[{"begin": b, "end": e, "p": p} for b, e, p in spans] for _, spans in found]
        columns = [batch.column("doc_id"), pa.array([x for x, _ in found], pa.float64()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "sentences"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (score >= threshold) and sentences.

    ``sentences`` locates those that alone reach the threshold, as bytes from begin to end of the UTF-8
    text, with their probability. Null, empty and wordless texts score as one sentence without words. Repeated
    rows are scored each. No shuffle; the weights, MOST_FEATURES at most, travel with the tasks.
    """
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _scores(batches, model, threshold),
        "doc_id long, score double, sentences array<struct<begin: int, end: int, p: double>>",
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels, usable)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [score_text(x, model, threshold)[0] < threshold for x in bytes_of(batch.column("text"))]
            yield batch.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
