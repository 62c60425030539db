"""Greedy blocks by composed functions against the fold over all positions in order."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alleloom.operators import greedy as G
from alleloom.operators import stats as A


def fold(places, size):
    """The starts over positions in order, and the first free place after them."""
    free, out = -(1 << 62), []
    for p in sorted(places):
        if p >= free:
            out.append(p)
            free = p + size
    return out, free


def covered(stretches):
    return {p for s, e in stretches for p in range(s, e)}


_stretches = st.lists(st.tuples(st.integers(0, 150), st.integers(1, 30)), max_size=12).map(lambda x: sorted((s, s + n) for s, n in x))


@given(_stretches, st.integers(1, 40), st.integers(-5, 39))
@settings(max_examples=300, deadline=None)
def test_a_part_is_its_function(stretches, size, into):
    if not stretches:
        return
    s, e = (np.array(x) for x in zip(*stretches, strict=True))
    f = G.function_of(s, e, size, 0)
    for x in {min(into, size - 1), G._LOW, 0}:
        starts, free = [], x
        for p in sorted(covered(stretches)):
            if p >= free:
                starts.append(p)
                free = p + size
        assert G.value(f, x) == free and G.starts_of(s, np.maximum.accumulate(e), size, x).tolist() == starts == G.starts_of(s, e, size, x).tolist()


@given(_stretches, _stretches, st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_composition(left, right, size):
    """Functions of two parts composed are that of both."""
    right = [(s + 200, e + 200) for s, e in right]
    of = lambda x, begin: G.function_of(*(np.array(v) for v in zip(*x, strict=True)), size, begin) if x else G.IDENTITY
    f = G.composed(of(left, 0), of(right, 200), size)
    for x in [G._LOW, *range(-2, size)]:
        free = x
        for p in sorted(covered(left) | covered(right)):
            if p >= free:
                free = p + size
        assert G.value(f, x) == free
    assert len(f[0]) <= 2 * (len(left) + len(right)) + 3


@pytest.mark.parametrize(("size", "part"), [(7, 16), (90, 100), (400, 64), (1, 32)])
def test_starts_equal_the_fold(spark, size, part):
    """More parts than a group has, empty parts and chromosomes of one position."""
    rng = random.Random(size)
    rows = [(c, s := rng.randrange(4000), s + rng.choice((1, 1, 2, 50))) for c in (0, 3) for _ in range(260)] + [(5, 17, 18), (6, 900, 900), (7, 0, 3000)]
    df = spark.createDataFrame(rows, "chrom_ix int, s int, e int").repartition(5)
    want = sorted((c, p) for c in {r[0] for r in rows} for p in fold(covered([r[1:] for r in rows if r[0] == c]), size)[0])
    assert sorted(map(tuple, G.greedy_starts_of(df, size, part).collect())) == want
    points = spark.createDataFrame([(c, p) for c, s, e in rows[:-1] for p in range(s, e)], "chrom_ix int, pos int")
    assert sorted(map(tuple, A.greedy_starts(points, size, part).collect())) == [x for x in want if x[0] != 7]
    assert G.greedy_starts_of(df.limit(0), size, part).count() == 0


def test_what_goes_up_is_small():
    """A function keeps what can come in: the positions of one block, or fewer, whatever the part holds."""
    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(1 << 20, 200_000, replace=False))
    f = G.function_of(at, at + 1, 1000, 0)
    assert len(f[0]) <= (at < 1000).sum() + 1
    assert len(G.function_of(np.array([0]), np.array([1 << 20]), 1000, 0)[0]) <= 3
