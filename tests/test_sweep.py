"""The interval sweep at real bin widths, its masks, and how much it looks at."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.operators import filters as Q
from alleloom.operators import merge as M
from alleloom.operators import stats as A
from alleloom.operators import sweep


def random_runs(seed, samples, length, step=60, chroms=(0, 1)):
    rng, rows = random.Random(seed), []
    for i in range(samples):
        for c in chroms:
            at = rng.randrange(30)
            while at < length:
                code = rng.choice([S.NS, S.EQS1, S.EQS2, S.EQS2, S.EQS2, S.TRANS2, S.REFCOMPL, S.TCOMPL1, S.TRANSCOMPL, S.DEL1])
                n = rng.randrange(1, step) if code in S.STRETCHES else 1
                rows.append((i, c, at, min(at + n, length), code))
                at += n + (rng.randrange(40) if rng.random() < 0.1 else 0)
    return rows


def wide_rows(rows, n, keep=lambda c, p: True):
    """Variants and the positions without one, base by base."""
    at = {(i, c, p): code for i, c, s, e, code in rows for p in range(s, e)}
    sparse, dense = [], []
    for c, p in sorted({(c, p) for (_, c, p), code in at.items() if code not in (S.NS, S.DEL1) and keep(c, p)}):
        alts = [a for a in (1, 2, 3) if any(S.counts(at.get((i, c, p), 0), a)[1] for i in range(n))]
        for a in alts or [S.PSEUDO]:
            calls = [S.counts(at.get((i, c, p), 0), 1 if a == S.PSEUDO else a) for i in range(n)]
            dense.append((c, p, a, [x if a != S.PSEUDO else (x[0], 0) for x in calls]))
        sparse += [dense[-len(alts) + k] for k in range(len(alts))]
    return sparse, dense


def collected(df):
    return sorted((r["chrom_ix"], r["pos"], r["alt"], [tuple(c) for c in r["calls"]]) for r in df.collect())


@pytest.mark.parametrize("width", [7, 64, 65536])
def test_every_width_gives_the_same(spark, width):
    n, rows = 9, random_runs(3, 9, 700)
    runs = spark.createDataFrame(rows, S.RUNS).repartition(3).cache()
    sparse, dense = wide_rows(rows, n)
    assert collected(M.merge_sparse(runs, n, 0, width)) == sorted(sparse) and collected(M.merge_dense(runs, n, width)) == sorted(dense)


@pytest.mark.parametrize("pieces", [1, 50, 1 << 18])
def test_bins_come_whole(spark, monkeypatch, pieces):
    """Groups of bins of any size, and few calls at a time."""
    monkeypatch.setattr(sweep, "_PIECES", pieces)
    monkeypatch.setattr(sweep, "_CALLS", 40)
    n, rows = 5, random_runs(5, 5, 400)
    sparse, dense = wide_rows(rows, n)
    runs = spark.createDataFrame(rows, S.RUNS)
    assert collected(M.merge_dense(runs, n, 32)) == sorted(dense) and collected(M.merge_sparse(runs, n, 0, 32)) == sorted(sparse)


def test_a_hundred_samples_in_one_bin(spark):
    """A real bin of 65,536 bases: one shuffle and no join, and each call is looked up once."""
    n = 100
    rng = random.Random(1)
    rows = []
    for i in range(n):
        at = 0
        for p in sorted(rng.sample(range(60_000), 40)):
            rows += [(i, 0, at, p, S.EQS2), (i, 0, p, p + 1, rng.choice([S.TRANS2, S.REFCOMPL, S.TCOMPL2]))]
            at = p + 1
        rows.append((i, 0, at, 65_000, S.EQS2))
    runs = spark.createDataFrame(rows, S.RUNS).cache()
    v = M.merge_sparse(runs, n)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan
    code = {(i, p): k for i, _, s, e, k in rows if e - s == 1 for p in (s,)}
    got = collected(v)
    assert len(got) == len({(p, a) for (_, p), k in code.items() for a in (1, 2, 3) if S.counts(k, a)[1]})
    for _, p, a, calls in got[::50]:
        assert calls == [S.counts(code.get((i, p), S.EQS2), a) for i in range(n)]


def test_lookups_are_in_proportion(monkeypatch):
    """What is looked at grows with sites times samples, which is what comes out, not with the square of a bin's runs."""
    looked = []
    plain = np.searchsorted
    for n in (20, 40, 80):
        rng = np.random.default_rng(n)
        lo = np.sort(rng.choice(65_536, (n, 130)), 1)
        sample = np.repeat(np.arange(n), 130)
        pieces = sweep.Pieces(sample, lo.ravel(), np.append(lo[:, 1:], np.full((n, 1), 65_536), 1).ravel(), np.full(n * 130, S.EQS2), n)
        sites = np.unique(lo[:, ::13])
        count = [0]

        def counted(a, v, *rest, count=count):
            count[0] += np.size(v)
            return plain(a, v, *rest)

        monkeypatch.setattr(np, "searchsorted", counted)
        got = pieces.codes(sites)
        monkeypatch.undo()
        assert count[0] == len(sites) * n == got.size
        looked.append(count[0] / (len(sites) * n))
    assert looked == [1, 1, 1]


def test_the_last_of_overlapping_runs_counts(spark):
    rows = [(0, 0, 0, 10, S.EQS2), (0, 0, 4, 5, S.TRANS2), (1, 0, 0, 10, S.EQS1)]
    assert collected(M.merge_sparse(spark.createDataFrame(rows, S.RUNS), 2)) == [(0, 4, 1, [(0, 2), (1, 0)])]
    assert M.merge_sparse(spark.createDataFrame([], S.RUNS), 2).count() == 0 == M.merge_dense(spark.createDataFrame([(0, 0, 5, 5, S.EQS2)], S.RUNS), 1).count()


@pytest.mark.parametrize("width", [16, 65536])
def test_masks(spark, width):
    """Stretches and sites within regions and without others, as base by base; regions overlap, touch and cross bins."""
    n, rows, rng = 6, random_runs(8, 6, 500), random.Random(2)
    runs = spark.createDataFrame(rows, S.RUNS).cache()
    some = lambda k, top: [(rng.randrange(2), s := rng.randrange(500), s + rng.randrange(top)) for _ in range(k)]
    beds = [some(14, 90), some(20, 60), some(40, 9)]
    sets = [{(c, p) for c, s, e in b for p in range(s, e)} for b in beds]
    keep = lambda c, p: (c, p) in sets[0] and (c, p) in sets[1] and (c, p) not in sets[2]
    sparse, dense = wide_rows(rows, n, keep)
    frames = [spark.createDataFrame(b, S.BED) for b in beds]
    both = sweep.swept(runs, n, 0, width, stretches=True, within=frames[:2], without=frames[2:]).cache()
    rows_of = both.select("chrom_ix", F.explode(F.expr("sequence(s, e - 1)")).alias("pos"), "alt", "calls")
    assert collected(rows_of) == sorted(dense) and dense and collected(both.where("alt < 4").withColumnRenamed("s", "pos")) == sorted(sparse)
    combos = [c for c, _ in A.patterson_combos(1, 2, [f"s{i}" for i in range(n)])]
    v = spark.createDataFrame([(c, p, a, [tuple(x) for x in calls]) for c, p, a, calls in dense], "chrom_ix int, pos int, alt int, calls array<struct<n_ref:int,n_alt:int>>")
    sums = lambda df: {(r["chrom_ix"], r["block"], r["combo"]): (r["k"], r["n"], r["t"]) for r in df.collect()}
    for grid in (True, False):
        fast = A.dense_blocks(None, runs, n, combos, A.PATTERSON, 70, width, grid, frames[:2], frames[2:], F.col("alt") >= 2)
        assert sums(fast) == sums(A.block_sums(v.where("alt >= 2"), combos, A.PATTERSON, 70, grid))


def test_cpg_pairs(spark):
    seq = "CGTCCGNCGACGGTNGCGC"
    for size in (4, 5, 19, 64):
        chunks = spark.createDataFrame([(0, i, seq[i : i + size]) for i in range(0, len(seq), size)], S.CHUNKS)
        got = sorted(tuple(r) for r in Q.cpg_sites(chunks, size).collect())
        assert got == [(0, p, p + 2) for p in range(len(seq)) if seq[p : p + 2] == "CG"]


@pytest.mark.parametrize("width", [8, 1000])
def test_regions_by_sweep(spark, width):
    """Rows on beginnings and ends, several of one place, regions over many bins; other columns go along."""
    rng = random.Random(6)
    bed = [(rng.randrange(2), s := rng.randrange(120), s + rng.randrange(25)) for _ in range(12)]
    rows = [(rng.randrange(3), rng.randrange(150), rng.choice([None, "x"])) for _ in range(400)]
    got = Q.restrict_to_regions(spark.createDataFrame(rows, "chrom_ix int, pos int, e string"), spark.createDataFrame(bed, S.BED), width)
    assert got.columns == ["chrom_ix", "pos", "e"]
    want = [r for r in rows if any(c == r[0] and s <= r[1] < e for c, s, e in bed)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
