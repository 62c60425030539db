"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed character 1- to 3-grams are counted over all documents that may be learned from. The
model is trained on a bounded sample of them (`sample` rows, of the languages in turn the smallest by hash) with the follow-the-regularised-leader
proximal update and an elastic-net penalty, one example at a time; a fifth of the sample is kept back, and on it a
temperature is fitted that calibrates the scores. Prediction reads nothing but the text, whole.

Defined results: null text and text without a letter are `und` with score 0; without any labelled rows every document
is `und`; equal scores go to the language that sorts first; a row without id is learned from like any other, a repeated row once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleloom.llm.common import text_slices
from alleloom.llm.features import characters, grams, has_letter

SLOTS = 1 << 14
SIZES = (1, 2, 3)
SAMPLE = 3000
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SLOTS x labels
    temperature: float


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, counts of slots) of each row; None without a letter."""
    for first, data, offsets in text_slices(texts):
        points, at = characters(data, offsets)
        known = has_letter(points, at)
        slots = grams(points, SIZES, SLOTS)
        for i in range(len(at) - 1):
            if not known[i]:
                yield first + i, None
                continue
            lo, hi = at[i], at[i + 1]
            c = np.zeros(SLOTS, np.int64)
            for n, g in zip(SIZES, slots, strict=True):
                c += np.bincount(g[lo : max(lo, hi - n + 1)], minlength=SLOTS)
            yield first + i, c


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents with letters, and in how many each slot occurs, over all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for _, c in _counts(b.column(0)):
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["slot", "n"])

    # a vector of SLOTS counts for each task, summed by slot: bounded whatever the input
    rows = docs.select(text).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(SLOTS, np.int64), 0
    for r in rows:
        if r["slot"] < 0:
            n = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return int(n or 0), df


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (SLOTS x labels) by FTRL-proximal with per-coordinate rates and elastic-net penalty."""
    z, n = np.zeros((SLOTS, labels)), np.zeros((SLOTS, labels))
    rng = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g2
    return weights(z, n)


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def smallest(rows: DataFrame, n: int, group: str, h: str, tag: str) -> DataFrame:
    """Rows of each group among which are its n distinct smallest by hash h, and in expectation no more than 4 n others.

    A hash's level is the length of its distance from the smallest hash in bits: the rows up to one level are half those
    up to the next. Distinct rows of a level are counted with map-side sketches, 63 small rows for each group, and the
    level at which there are twice as many as wanted (the sketches err by 5 %) is the group's threshold, so no group is
    sorted whole and nothing else is shuffled. The groups are the model's labels, for which the driver has room.
    """
    level = F.length(F.bin(F.shiftrightunsigned(F.col(h).bitwiseXOR(F.lit(-(1 << 63))), 1)))
    marked = rows.withColumn("_level", level)
    counted = marked.groupBy(group, "_level").agg(F.approx_count_distinct(F.xxhash64(h, tag)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("_level"))
    enough = counted.withColumn("upto", upto).groupBy(group).agg(F.coalesce(F.min(F.when(F.col("upto") >= 2 * n, F.col("_level"))), F.lit(64)).alias("_last"))
    return marked.join(F.broadcast(enough), group).where("_level <= _last").drop("_level", "_last")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of docs' non-null languages; docs holds just the rows that may be learned from."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("id"))
    n, df = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + df)) + 1
    # the sample's features are made where the texts are; the driver gets `sample` sparse vectors at most
    # which rows is settled without their texts, and language by language in turn, so rare languages are learned too
    # a row without id has its text's hash, so such rows spread as well
    known = usable.withColumn("th", F.xxhash64("text")).withColumn("h", F.when(F.col("id").isNull(), F.col("th")).otherwise(F.xxhash64("id")))
    order = ["h", "id", "th"]
    few = smallest(known, sample, "lang", "h", "th")
    turn = few.select("lang", *order).distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= sample)
    ids = turn.orderBy("r", *order, "lang").limit(sample).select("h", "th", "lang")
    chosen = known.join(F.broadcast(ids), ["h", "th", "lang"]).dropDuplicates(["h", "th", "lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *_vector(c, idf)) for i, c in _counts(b.column(1)) if c is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py() for i, _, _ in rows]), pa.array([a.astype("<i4").tobytes() for _, a, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, _, x in rows], pa.binary())], names=["lang", "at", "x"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in chosen.select("lang", "text").mapInArrow(vectors, "lang string, at binary, x binary").collect())
    labels = sorted({r[0] for r in got})
    if not labels:
        return Model([], idf, np.zeros((SLOTS, 0)), 1.0)
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float), labels.index(k)) for k, a, x in got]
    fit, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    w = ftrl(fit or rows, len(labels))
    t = calibrated(np.array([x @ w[a] for a, x, _ in held]), np.array([y for _, _, y in held]))
    return Model(labels, idf, w, t)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; text goes along unchanged."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select([F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.idf, model.weights, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, idf, w, temperature = sent.value
        for b in batches:
            said, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            if labels:
                for i, c in _counts(b.column(b.schema.get_field_index(text))):
                    if c is None:
                        continue
                    at, x = _vector(c, idf)
                    s = (x @ w[at]) / temperature
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    said[i], score[i] = labels[int(p.argmax())], min(1.0, float(p.max()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(said, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the rows that aren't held out."""
    model = train(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model)
