"""The factorization machine: its sum of pairs, its slopes, what pairs add to plain weights, and the query."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from alleloom.llm import toxicity as T

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "tol", "vas", "dip") for c in ("a", "om", "is")]


def test_pairs_are_summed_and_slopes_are_true():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=7), rng.normal(size=(7, T.RANK))
    plain = 0.3 + w.sum() + sum(v[i] @ v[j] for i, j in itertools.combinations(range(7), 2))
    assert T.logit_of(0.3, w, v) == pytest.approx(plain)
    step = 1e-6
    for i, k in itertools.product(range(7), range(T.RANK)):
        up, down = v.copy(), v.copy()
        up[i, k] += step
        down[i, k] -= step
        assert T.slope(v)[i, k] == pytest.approx((T.logit_of(0.3, w, up) - T.logit_of(0.3, w, down)) / (2 * step), abs=1e-6)


def _pairs(n, seed):
    """Bags whose label is that the two kinds of mark agree: neither mark alone says anything."""
    rng = np.random.default_rng(seed)
    bags, y = [], []
    for _ in range(n):
        a, b = rng.integers(0, 2, 2)
        bags.append(np.unique(np.concatenate([[100 + a * 10 + rng.integers(3)], [200 + b * 10 + rng.integers(3)], 1000 + rng.integers(0, 300, 12)])))
        y.append(int(a == b))
    return bags, np.array(y)


def test_pairs_say_what_weights_cannot():
    (bags, y), (more, z) = _pairs(1500, 1), _pairs(500, 2)
    right = lambda m: np.mean([(m.logit(b) > 0) == k for b, k in zip(more, z, strict=True)])
    assert right(T.learned(bags, y, 1.0)) > 0.9 and right(T.learned(bags, y, 1.0, pairs=0)) < 0.6


def test_penalties_make_it_sparse_and_are_chosen():
    bags, y = _pairs(600, 3)
    few, many = (np.count_nonzero(T.learned(bags, y, p).weights) for p in (20.0, 0.5))
    assert few < many
    m = T.chosen(bags, y, (1.0, 500.0))
    assert m.penalty == 1.0 == min(m.losses, key=m.losses.get) and m.losses[500.0] == pytest.approx(np.log(2), abs=0.02)


def test_scale_and_offset():
    """They are found again where labels are drawn from known ones."""
    rng = np.random.default_rng(1)
    s = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * s - 1)))).astype(int)
    assert T.fitted(s, y) == pytest.approx((0.5, -1.0), abs=0.08)


def test_terms():
    """Case and punctuation don't matter, words share beginnings, and other bytes part nothing."""
    terms = lambda t: {s for _, _, _, slots in T._terms(pa.array([t])) for s in slots.tolist()}
    assert terms("Idiot!") == terms("(idiot)") == terms("idiot") and terms("") == set() == terms("?! \n")
    assert len(terms("idioten") & terms("idiotisch")) == 2 and not terms("abc") & terms("abd")
    assert terms("größe") != terms("gr e") and len(terms("größe")) == 4


def corpus(n=900, seed=1):
    """An insult is toxic where a group is named as well; a fifth of the documents has one of them alone."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["blockhead" + rng.choice(("", "s", "ed"))] * insult + ["northerner" + rng.choice(("", "s"))] * group
        rng.shuffle(w)
        docs.append((i, " ".join(w).capitalize() + "."))
        if i % 3 != 2:
            labels.append((i, int(insult and group)))
    return docs, labels


def test_query(spark, tmp_path):
    from alleloom.llm.queries import queries

    docs, labels = corpus()
    copies = [(5000, docs[4][1]), (5001, docs[4][1]), docs[7], docs[7]]
    odd = [(6000, None), (6001, ""), (6002, " \n"), (6003, "karena " * 50_000), (None, docs[3][1]), (None, docs[3][1])]
    table = [(*d, "de", 0.0) for d in docs + copies + odd]
    spark.createDataFrame(table, "doc_id long, text string, lang string, score double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 0, t) for i, t in labels] + [(labels[0][0], 1, labels[0][1]), (None, 1, 1), (3, 1, None), (7777, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries()["op11_toxicity"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(table) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert len({by[i][0]["score"] for i in (4, 5000, 5001)}) == 1 and by[None][0]["score"] == by[None][1]["score"] == by[3][0]["score"]
    assert by[6000][0]["score"] == by[6001][0]["score"] == by[6002][0]["score"]
    toxic = {i: t for i, t in labels}
    held = [(by[i][0]["predicted"], t) for i, t in toxic.items() if by[i][0]["held_out"]]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.95
    assert {(r["doc_id"], r["score"]) for r in queries()["op11_toxicity"](spark, str(tmp_path)).collect()} == {(r["doc_id"], r["score"]) for r in rows}


def test_without_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    scores = lambda marks: {r["score"] for r in T.judged(docs, labels(marks)).collect()}
    assert scores([]) == {0.5} and scores([(i, 0) for i in range(9)]) == {0.001}
    assert T.judged(docs.limit(0), labels([(1, 1)])).count() == 0
