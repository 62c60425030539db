"""Vector codes against whole-number brute force, and the rounding bounds against exact arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from alleloom.llm import vector_codes as V


def exact(x, c):
    """(index, distance) by Python's own numbers, of any size."""
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    return [r.index(min(r)) for r in d], [min(r) for r in d]


_size = st.integers(1, 9)


@given(st.data(), _size, st.sampled_from([3, 300, 1 << 15, 1 << 24, 1 << 26]))
@settings(max_examples=150, deadline=None)
def test_nearest_is_exact(data, n, top):
    numbers = st.integers(-top, top)
    x = data.draw(hnp.arrays(np.int64, (6, n), elements=numbers))
    c = data.draw(hnp.arrays(np.int64, (5, n), elements=numbers))
    c[3], x[4] = c[1], c[1]  # a tie, and a distance of nothing
    c[4] = c[0] + data.draw(st.integers(0, 1))
    code, error, _ = V.nearest(x, c)
    assert (code.tolist(), error.tolist()) == exact(x, c)
    low, high = V.intervals(x, c)
    for i in range(len(x)):
        for j in range(len(c)):
            true = sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], c[j], strict=True)) - sum(int(a) ** 2 for a in x[i])
            assert math.floor(low[i, j]) <= true <= math.ceil(high[i, j])


def test_far_from_the_origin_float32_alone_is_wrong():
    """Entries a unit apart at 2^20: their float32 distances are equal or swapped; all of them are evaluated again."""
    rng = np.random.default_rng(2)
    c = (1 << 20) + rng.integers(-3, 4, (64, 4))
    x = (1 << 20) + rng.integers(-3, 4, (500, 4))
    code, error, evaluated = V.nearest(x, c)
    assert (code.tolist(), error.tolist()) == exact(x, c)
    plain = (c.astype(np.float32) ** 2).sum(1) - 2 * (x.astype(np.float32) @ c.astype(np.float32).T)
    assert (plain.argmin(1) != code).any() and evaluated > 500 * 30


def test_screening_leaves_few():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-150, 150, (4000, 4)), rng.integers(-150, 150, (64, 4))
    code, error, evaluated = V.nearest(x, c)
    assert evaluated < 1.05 * len(x) and (code.tolist(), error.tolist()) == exact(x, c)


def rows(n=300, size=32, seed=5):
    rng = random.Random(seed)
    out = [(i * 7 % 1009, [rng.gauss(0, 0.3) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(n)]
    out += [(2000 + i, out[i][1], 9) for i in range(30)] + [(i * 7 % 1009, [x / 2 for x in out[i][1]], 3) for i in range(10)]
    odd = [None, [], [0.5] * (size - 1) + [None], [0.5] * (size - 1) + [float("nan")], [float("inf")] + [0.0] * (size - 1), [1e300] * size, [0.1] * (size + 1)]
    out += [(3000 + i, v, 1) for i, v in enumerate(odd)] + [(None, [0.25] * size, None), (None, [0.0] * size, 1)]
    out.append(out[0])
    rng.shuffle(out)
    return out


def brute(data, size, parts=16, entries=64, rounds=2):
    """(id, code, error, label) of each vector that counts, and the codebooks as text."""
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in data if v and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)]
    k = -(-size // parts)
    cut = lambda v: [(v + [0] * (parts * k - size))[p * k : (p + 1) * k] for p in range(parts)]
    good = [(i, cut(v), lab) for i, v, lab in good]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, sum(r[1], [])))[:entries]
    books = [[list(v[p]) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            at = exact([v[p] for _, v, _ in good], books[p])[0]
            for e in range(len(books[p])):
                own = [v[p] for (_, v, _), a in zip(good, at, strict=True) if a == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [exact([v[p] for _, v, _ in good], books[p]) for p in range(parts)]
    done = [(i, "".join(f"{codes[p][0][n]:02x}" for p in range(parts)), sum(codes[p][1][n] for p in range(parts)), lab) for n, (i, _, lab) in enumerate(good)]
    return done, ",".join(str(x) for b in books for e in b for x in e)


def of_labels(done):
    out = {}
    for _, _, error, lab in done:
        out[lab] = out.get(lab, 0) + error
    return out


@pytest.mark.parametrize("size", [32, 16, 20])
def test_query_against_brute_force(spark, tmp_path, size):
    data = rows(size=size)
    spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, label int, _x int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    from alleloom.llm.queries import queries

    done, books = brute(data, size)
    digest, sums = hashlib.sha256(books.encode()).hexdigest(), of_labels(done)
    got = queries()["op12_vector_codes"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, c, e, sums[lab], digest) for i, c, e, lab in done), key=str)


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(200)] + [(500, None, 1), (501, [float("nan")] * 32, 1)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = V.digests(spark.read.parquet(str(tmp_path / "embeddings.parquet")))
    with duckdb.connect() as c:
        c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(c.sql(V.SQL).fetchall()) == sorted(map(tuple, got.collect()))


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = [(3, [0.5] * 16, None), (1, [-0.5] * 16, None), (2, [0.1] * 16, 4)]
    got = {r["vec_id"]: r for r in V.digests(spark.createDataFrame(few, schema)).collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {1: ("00" * 16, 0), 2: ("01" * 16, 0), 3: ("02" * 16, 0)}
    assert V.digests(spark.createDataFrame(few, schema).limit(0)).count() == 0
    assert V.digests(spark.createDataFrame([(1, None, 1)], schema)).count() == 0


def test_one_label_and_other_sizes(spark):
    """Other numbers of parts and entries; columns go along."""
    data = [(i, [math.sin(i * k + k) for k in range(12)], 1, "x") for i in range(90)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, error string")
    done, book = V.compressed(df, parts=3, entries=200, rounds=1)
    want, text = brute([r[:3] for r in data], 12, parts=3, entries=200, rounds=1)
    assert {(r["vec_id"], r["code"], r["error"]) for r in done.collect()} == {r[:3] for r in want} and book.digest() == hashlib.sha256(text.encode()).hexdigest()
    assert done.columns == ["vec_id", "embedding", "label", "code", "error"] and done.where(F.col("error") > 0).count() == 0
    with pytest.raises(ValueError):
        V.compressed(df, entries=257)
