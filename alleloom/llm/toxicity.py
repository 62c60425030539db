"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words (letters, digits and all non-ASCII; A-Z in lower case) and their beginnings of
STEMS bytes, so that inflected forms share something. Every term has a weight and a vector of RANK numbers; a document's
logit is the bias, the sum of its terms' weights, and the inner products of the vectors of every two of its terms: a pair
such as an insult and the mention of a group can weigh more, or less, than its parts do. The pairs are never listed: their
sum is half the difference of the squared sum of the vectors and the sum of their squares.

Weights are learned by follow-the-regularised-leader with an L1 penalty and vectors by adaptive steps with a group penalty
that sets whole vectors to zero, so terms that say nothing weigh nothing, however long a text is. Vectors are kept for the
PAIRED terms that differ most between the labels: with one for every term the sum of all pairs of a long text outgrows
whatever a few of them say. Training takes a bounded
sample of labelled rows (`sample` of each label at most, the smallest by hash). A fifth of it is kept back at first: on it the
penalty is chosen from PENALTIES by log loss, and a scale and an offset of the logit are fitted; then all of the sample is
learned from. The model keeps these losses.

Defined results: null and empty texts have no terms, and a text without terms known to the model has the score of its bias;
without labels of both kinds every score is the labels' share of 1, or 0.5 without any; of several labels of a document the
largest counts; a null id is no document that labels could belong to; equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleloom.llm.common import mix, text_slices, words

SLOTS = 1 << 16  # of words, and as many of beginnings
ALL = 2 * SLOTS
STEMS = (4, 5, 6)
RANK = 6
SAMPLE = 1500
EPOCHS = 10
#: L1 penalties of weights that are tried; a vector's penalty is a share of it.
PENALTIES = (3.0, 8.0, 20.0)
#: Terms that have vectors.
PAIRED = 256
THRESHOLD = 0.7
_M = np.uint64(0x9E3779B97F4A7C15)
#: What parts words: ASCII but letters and digits. A-Z become a-z.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(chr(i).lower()) if chr(i).isalnum() else 0x20 for i in range(128)]


# --- terms ------------------------------------------------------------------------------------


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices as (first row, rows, row, slot): every occurrence of a term."""
    for first, data, offsets in text_slices(texts):
        data = _PLAIN[data]
        row, start, end, h = words(data, offsets)
        rows, slots = [row], [(mix(h) & np.uint64(SLOTS - 1)).astype(np.int64)]
        acc = np.full(len(row), _M)
        for k in range(max(STEMS)):
            long = end - start > k + 1  # a beginning is shorter than its word
            row, start, end, acc = row[long], start[long], end[long], acc[long]
            acc = mix((acc ^ data[start + k]) * _M)
            if k + 1 in STEMS:
                rows.append(row)
                slots.append((acc & np.uint64(SLOTS - 1)).astype(np.int64) + SLOTS)
        yield first, len(offsets) - 1, np.concatenate(rows), np.concatenate(slots)


def _distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(row * ALL + slot)
    return pair // ALL, pair % ALL


# --- learning ---------------------------------------------------------------------------------


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # ALL
    vectors: np.ndarray  # ALL x RANK
    scale: float = 1.0
    offset: float = 0.0
    penalty: float | None = None
    losses: dict[float, float] = field(default_factory=dict)  # by penalty, on the rows kept back

    def logit(self, at: np.ndarray) -> float:
        return logit_of(self.bias, self.weights[at], self.vectors[at])


def logit_of(bias: float, w: np.ndarray, v: np.ndarray) -> float:
    """The logit of a document from its terms' weights and vectors."""
    s = v.sum(0)
    return float(bias + w.sum() + 0.5 * (s @ s - (v * v).sum()))


def slope(v: np.ndarray) -> np.ndarray:
    """The slope of a document's logit by each of its terms' vectors: the sum of the other ones."""
    return v.sum(0) - v


def learned(bags: Sequence[np.ndarray], y: np.ndarray, penalty: float, epochs: int = EPOCHS, alpha: float = 0.3, rate: float = 0.1, start: float = 0.05, pull: float = 0.02, pairs: int = PAIRED, seed: int = 5) -> Model:
    """A machine from bags of distinct slots. Terms of one bag only are left out, as they can't say anything of others; the
    `pairs` terms whose shares of the two labels differ most, by their standard error, have vectors. In the first half of
    the epochs weights are learned alone, so vectors learn what these leave."""
    rng = np.random.default_rng(seed)
    times = np.bincount(np.concatenate([*bags, np.zeros(0, np.int64)]), minlength=ALL)
    used = np.flatnonzero(times > 1)
    toxic = np.bincount(np.concatenate([*(b for b, k in zip(bags, y, strict=True) if k), np.zeros(0, np.int64)]), minlength=ALL)[used]
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    share = (times[used] + 1) / (n1 + n0 + 2)
    differ = np.abs(toxic / n1 - (times[used] - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    used = used[np.argsort(-differ, kind="stable")]  # those with vectors come first
    paired = min(pairs, len(used))
    place = np.full(ALL, -1)
    place[used] = np.arange(len(used))
    own = [np.sort(place[b][place[b] >= 0]) for b in bags]
    z, n = np.zeros(len(used)), np.zeros(len(used))
    v, g2 = rng.normal(0, start, (paired, RANK)), np.full((paired, RANK), 1e-2)
    bias, bias_n = 0.0, 1.0

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((1 + np.sqrt(n[at])) / alpha))

    for epoch in range(epochs):
        for i in rng.permutation(len(own)):
            at = own[i]
            two = at[: np.searchsorted(at, paired)]
            w, vi = weight(at), v[two]
            g = 1 / (1 + np.exp(-min(max(logit_of(bias, w, vi), -30.0), 30.0))) - y[i]
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            if 2 * epoch < epochs:
                continue
            # an adaptive step, then the group penalty at the same rate
            gv = g * slope(vi)
            h = g2[two] + gv * gv
            g2[two] = h
            step = rate / np.sqrt(h)
            vi = vi - step * gv
            size = np.sqrt((vi * vi).sum(1))
            v[two] = vi * np.maximum(0, 1 - pull * penalty * step.mean(1) * abs(g) / np.maximum(size, 1e-12))[:, None]
    weights, vectors = np.zeros(ALL), np.zeros((ALL, RANK))
    weights[used], vectors[used[:paired]] = weight(np.arange(len(used))), v
    return Model(bias, weights, vectors, penalty=penalty)


def _loss(s: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -s, s)).mean()) if len(y) else 0.0


def fitted(s: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(scale, offset) with the least log loss of scale * s + offset, a little drawn to (1, 0); scale is positive."""
    a, b, pull = 1.0, 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        d, h = p - y, p * (1 - p)
        grad = np.array([(d * s).sum() + pull * (a - 1), d.sum() + pull * b])
        hess = np.array([[(h * s * s).sum() + pull, (h * s).sum()], [(h * s).sum(), h.sum() + pull]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - step[0], 0.05), b - step[1]
    return float(a), float(b)


def chosen(bags: Sequence[np.ndarray], y: np.ndarray, penalties: Sequence[float] = PENALTIES) -> Model:
    """The machine of the penalty that says most about a fifth of the bags when it is learned from the others."""
    inner = np.arange(len(bags)) % 5 == 0
    if len(set(y[inner])) < 2 or len(set(y[~inner])) < 2:
        return learned(bags, y, penalties[len(penalties) // 2])
    tried = {}
    for p in penalties:
        m = learned([b for b, k in zip(bags, inner, strict=True) if not k], y[~inner], p)
        s = np.array([m.logit(b) for b, k in zip(bags, inner, strict=True) if k])
        a, b = fitted(s, y[inner])
        tried[p] = (_loss(a * s + b, y[inner]), a, b)
    best = min(tried, key=lambda p: (tried[p][0], p))
    out = learned(bags, y, best)
    out.scale, out.offset = tried[best][1:]
    out.losses = {p: t[0] for p, t in tried.items()}
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels holds just the rows that may be learned from."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    share = one.agg(F.avg("y")).first()[0]
    # at most `sample` rows of each label: a bounded side, whatever the tables hold
    order = [F.xxhash64("id"), F.col("id")]
    some = one.where("y = 0").orderBy(*order).limit(sample).unionByName(one.where("y = 1").orderBy(*order).limit(sample))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, row, slot in _terms(b.column(1)):
                row, slot = _distinct(row, slot)
                edge = np.searchsorted(row, np.arange(rows + 1), "left")
                at = [slot[lo:hi].astype("<i4").tobytes() for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array(at, pa.binary())], names=["y", "at"])

    # copies of a text count once for each label, as if there were one of it
    got = sorted({(bytes(r["at"]), r["y"]) for r in texts.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(bags, "y int, at binary").collect()})
    got = [(np.frombuffer(a, "<i4").astype(np.int64), k) for a, k in got if a]
    order_ = np.random.default_rng(3).permutation(len(got))  # bags come sorted; the fifth that is kept back is any fifth
    y = np.array([got[i][1] for i in order_])
    if share is None or len(set(y.tolist())) < 2:
        share = 0.5 if share is None else min(max(float(share), 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), np.zeros(ALL), np.zeros((ALL, RANK)))
    out = chosen([got[i][0] for i in order_], y)
    # the sample may be balanced by label; the offset moves to the labels' own share
    odds = lambda q: np.log(q / (1 - q))
    out.offset += float(odds(min(max(float(share), 1e-3), 1 - 1e-3)) - odds(float(y.mean())))
    return out


# --- scoring ----------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1."""
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select([F.col(f"`{c}`") for c in keep]).schema.add("score", "double")
    known = np.flatnonzero((model.weights != 0) | (model.vectors != 0).any(1))
    numbers = np.concatenate([model.weights[known, None], model.vectors[known]], 1)
    sent = docs.sparkSession.sparkContext.broadcast((known, numbers, model.bias, model.scale, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias, scale, offset = sent.value
        place = np.full(ALL, -1)
        place[at] = np.arange(len(at))
        for b in batches:
            out = np.zeros(b.num_rows)
            for first, rows, row, slot in _terms(b.column(b.schema.get_field_index(text))):
                has = place[slot] >= 0
                row, slot = _distinct(row[has], slot[has])
                x = values[place[slot]]
                s = np.full(rows, bias)
                if len(row):
                    new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    total, squares = np.add.reduceat(x, new), np.add.reduceat(x[:, 1:] ** 2, new)
                    s[row[new]] += total[:, 0] + 0.5 * (total[:, 1:] ** 2 - squares).sum(1)
                out[first : first + rows] = 1 / (1 + np.exp(-np.clip(scale * s + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(np.round(out, 12))], names=[*keep, "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted, learned from the labels of rows that aren't held out."""
    model = train(docs, labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
