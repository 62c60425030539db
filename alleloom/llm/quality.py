"""Quality classifier: supervised subword embeddings.

Every word, every two words in a row and every character 3- and 4-gram is hashed to a learned vector; a document is their
average, and a softmax over it gives the label. Vectors and softmax are trained together by stochastic gradient descent in
numpy, each with a rate of its own (an average hands each vector a small share of the gradient, so vectors take larger
steps), on a bounded sample of labelled rows (`sample` of each label at most, the smallest by hash). A document's score
depends on its vectors only through their inner products with the softmax rows, so scoring sums one number for each word
and n-gram; the numbers are whole multiples of 1 / UNIT, so sums are exact and equal texts have equal scores.

Defined results: null and empty texts have no vectors and get the prior share of label 1 in the sample; without any
labels every score is 0.5; of several labels of a document the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleloom.llm.common import text_slices
from alleloom.llm.features import characters, grams, word_slots

SLOTS = 1 << 16  # of words, and as many of pairs of words and of character n-grams
ALL = 3 * SLOTS
UNIT = 1 << 30
SIZES = (3, 4)
DIMENSION = 12
SAMPLE = 1500
VECTOR_RATE = 300.0
THRESHOLD = 0.3


@dataclass
class Model:
    slot_score: np.ndarray  # ALL, in units of 1 / UNIT
    bias: float
    prior: float


def _features(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Slices as (first row, rows, parts); a part has its slots, and where each row's begin and end in them."""
    for first, data, offsets in text_slices(texts):
        rows = len(offsets) - 1
        points, at = characters(data, offsets)
        parts = []
        for k, (of, slots) in enumerate(word_slots(data, offsets, SLOTS)):
            edge = np.searchsorted(of, np.arange(rows + 1), "left")
            parts.append((slots + np.uint32(2 * k * SLOTS), edge[:-1], edge[1:]))
        for n, g in zip(SIZES, grams(points, SIZES, SLOTS, fold=False), strict=True):
            lo = np.minimum(at[:-1], len(g))
            parts.append((g + np.uint32(SLOTS), lo, np.minimum(np.maximum(lo, at[1:] - n + 1), len(g))))
        yield first, rows, parts


def _bag(parts, i: int) -> np.ndarray:
    """All slots of row i of a slice."""
    return np.concatenate([slots[lo[i] : max(lo[i], hi[i])] for slots, lo, hi in parts])


def sgd(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 10, rate: float = 0.5, vector_rate: float = VECTOR_RATE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (ALL x DIMENSION) and softmax rows (DIMENSION + 1 x 2) from (slots, shares) bags; rates fall to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (ALL, DIMENSION))
    out = np.zeros((DIMENSION + 1, 2))
    steps, done = epochs * max(len(bags), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            left = 1 - done / steps
            done += 1
            x = share @ vectors[at]
            s = x @ out[:-1] + out[-1]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1  # the gradient of the loss by the logits
            back = out[:-1] @ p
            out[:-1] -= rate * left * x[:, None] * p[None, :]
            out[-1] -= rate * left * p
            vectors[at] -= vector_rate * left * share[:, None] * back[None, :]
    return vectors, out


def fits(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, vectors: np.ndarray, out: np.ndarray) -> bool:
    """Whether what has been learned says more about the sample than its labels' shares do; if steps were too large, it doesn't."""
    way = vectors @ (out[:-1, 1] - out[:-1, 0])
    s = np.array([share @ way[at] for at, share in bags]) + out[-1, 1] - out[-1, 0]
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    loss = float(np.logaddexp(0, np.where(y == 1, -s, s)).mean())
    return bool(np.isfinite(loss)) and loss < -(share * np.log(share) + (1 - share) * np.log(1 - share))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """labels holds just the rows that may be learned from."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(label).alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    share = one.agg(F.avg("y")).first()[0]
    # at most `sample` rows of each label: a bounded side, whatever the tables hold
    chosen = one.where("y = 0").orderBy(*order).limit(sample).unionByName(one.where("y = 1").orderBy(*order).limit(sample))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, at, n = [], [], []
            for first, rows, parts in _features(b.column(1)):
                for i in range(rows):
                    slots, times = np.unique(_bag(parts, i), return_counts=True)
                    if len(slots):
                        y.append(b.column(0)[first + i].as_py())
                        at.append(slots.astype("<i4").tobytes())
                        n.append((times / times.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["y", "at", "n"])

    got = sorted((r["y"], bytes(r["at"]), bytes(r["n"])) for r in texts.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(bags, "y int, at binary, n binary").collect())
    if not got or share is None:
        return Model(np.zeros(ALL, np.int64), 0.0, 0.5)
    y = np.array([r[0] for r in got])
    learned = [(np.frombuffer(a, "<i4"), np.frombuffer(n, "<f4").astype(float)) for _, a, n in got]
    rate = VECTOR_RATE
    vectors, out = sgd(learned, y, vector_rate=rate)
    while rate > 1 and not fits(learned, y, vectors, out):
        rate /= 2
        vectors, out = sgd(learned, y, vector_rate=rate)
    way = out[:, 1] - out[:, 0]
    # the sample is balanced by label; the intercept moves to the labels' own share
    prior = min(max(float(share), 1e-3), 1 - 1e-3)
    mine = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(way[-1]) + np.log(prior / (1 - prior)) - np.log(mine / (1 - mine))
    return Model(np.rint(vectors @ way[:-1] * UNIT).astype(np.int64), bias, prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1."""
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select([F.col(f"`{c}`") for c in keep]).schema.add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast((model.slot_score, model.bias, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias, prior = sent.value
        for b in batches:
            out = np.full(b.num_rows, prior)
            for first, rows, parts in _features(b.column(b.schema.get_field_index(text))):
                total, count = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for slots, lo, hi in parts:
                    run_sum = np.concatenate([[0], np.cumsum(value[slots])])
                    total += run_sum[np.maximum(lo, hi)] - run_sum[lo]
                    count += np.maximum(lo, hi) - lo
                has = count > 0
                s = np.clip(total[has] / UNIT / count[has] + bias, -30, 30)
                out[first : first + rows][has] = 1 / (1 + np.exp(-s))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(out)], names=[*keep, "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted, learned from the labels of rows that aren't held out."""
    model = train(docs, labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
