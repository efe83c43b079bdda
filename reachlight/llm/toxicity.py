"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlight.llm import frame
from reachlight.llm.words import Words, mix

#: Weights are kept in 2 ** BITS places.
BITS = 20
#: Labelled rows that the model is fitted on at most, those with the least hashes of doc_id; and passes over them.
SAMPLE, PASSES = 8000, 2
#: Per-coordinate rate alpha / (beta + sqrt(sum of squares)), and the two penalties.
ALPHA, BETA, L1, L2 = 0.7, 1.0, 16.0, 0.1
#: Labelled documents that a feature must occur in to be learned.
LEAST_DOCS = 3
#: Texts whose features are made at once while fitting.
CHUNK = 250
#: A document is toxic from this probability on.
THRESHOLD = 0.5


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) of every distinct feature of each text: words, pairs of neighbours, and pairs with one word between."""
    h, doc = words.hashes, words.document()
    parts, docs = [h], [doc]
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        same = doc[:-gap] == doc[gap:]
        parts.append(mix(h[:-gap] * np.uint64(31) + h[gap:] + np.uint64(salt))[same])
        docs.append(doc[:-gap][same])
    place = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    # a feature counts once in a text
    key = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | place)
    return key & ((1 << BITS) - 1), key >> BITS


class Ftrl:
    """FTRL-proximal with binary features; weights are zero until |z| exceeds L1, so most stay out of the model."""

    def __init__(self):
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA)

    def learn(self, at: np.ndarray, y: int, scale: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias(), -35, 35)))
        g = (p - y) * scale
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        b = self.bias()
        sigma = (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / ALPHA
        self.bias_z += g - sigma * b
        self.bias_n += g * g


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the non-zero weights. Rare classes weigh more. No rows, or one class, give no weights.

    Without a positive row the bias says that nothing is toxic.
    """
    y = np.asarray(labels, int)
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    model, rare = Ftrl(), np.sqrt((len(y) - y.sum()) / y.sum())
    parts = [features(Words(texts[i : i + CHUNK])) for i in range(0, len(texts), CHUNK)]
    place = np.concatenate([p.astype(np.int32) for p, _ in parts])
    doc = np.concatenate([(d + i * CHUNK).astype(np.int32) for i, (_, d) in enumerate(parts)])
    del parts
    known = np.bincount(place, minlength=1 << BITS) >= LEAST_DOCS
    place, doc = place[known[place]], doc[known[place]]
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    order = np.random.default_rng(1)
    for _ in range(PASSES):
        for i in order.permutation(len(y)):
            model.learn(place[first[i] : first[i + 1]], int(y[i]), rare if y[i] else 1.0)
    w = model.weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return at, w[at], float(model.bias())


def probabilities(texts: list[str | None], model: tuple[np.ndarray, np.ndarray, float], dense: np.ndarray | None = None) -> np.ndarray:
    at, weights, bias = model
    if dense is None:
        dense = np.zeros(1 << BITS)
        dense[at] = weights
    words = Words(texts)
    h, doc = words.hashes, words.document()
    sums = np.full(len(texts), bias)
    # only features with a weight are made distinct: most are zero
    keys = []
    for gap, salt in ((0, 0), (1, 0x51), (2, 0xA7)):
        if gap:
            same = doc[:-gap] == doc[gap:]
            g, d = mix(h[:-gap] * np.uint64(31) + h[gap:] + np.uint64(salt)), doc[:-gap]
        else:
            g, d, same = h, doc, True
        place = (g >> np.uint64(64 - BITS)).astype(np.int64)
        hit = np.flatnonzero((dense[place] != 0) & same)
        keys.append((d[hit].astype(np.int64) << BITS) | place[hit])
    key = np.unique(np.concatenate(keys))
    np.add.at(sums, key >> BITS, dense[key & ((1 << BITS) - 1)])
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from at most ``sample`` labels of documents, chosen by a hash.

    Null labels, ids and texts are left out. Labels that repeat in everything count once, different labels of one
    document each; of a doc_id's texts the least counts, so that no more rows than ``sample`` reach the driver.
    An empty table, or one without labels, gives a model without weights.
    """
    rows = frame.plain(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    few = frame.sampled(rows, "doc_id", sample)
    texts = frame.plain(docs, doc_id="long", text="string").where("text IS NOT NULL")
    # the sample is of at most ``sample`` rows, whatever the tables hold
    got = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "toxic", "text"])
    return fit(got["text"].tolist(), (got["toxic"] > 0).astype(int).tolist())


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, probability) of each document, over its whole text. A null text has null, an empty one the bias alone.

    Repeated rows give repeated rows; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for part in frame.steps(batch, 1):
                text = part.column(1)
                p = probabilities(text.to_pylist(), sent.value, dense)
                yield pa.record_batch([part.column(0), pa.array(p, pa.float64(), mask=text.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "probability"])

    return frame.plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, probability double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The toxic ones of all documents, with their probabilities."""
    docs = frame.read(spark, folder, "documents")
    return scored(docs, train(docs, frame.read(spark, folder, "labels"))).where(F.col("probability") >= THRESHOLD)
