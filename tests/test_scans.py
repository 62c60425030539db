"""Scans along chromosomes, bin by bin: the same rows for every width of bins and parts, and as by hand."""

import random

import numpy as np
import pytest

from alleloom import schema as S
from alleloom.operators import greedy as G
from alleloom.operators import runs as R
from alleloom.operators.sweep import merged_regions

WIDTHS = [3, 50, 65536]


def pieces(seed, n=300):
    """Runs of few codes that touch often, some empty, over two samples and chromosomes; long ones cross many bins."""
    rng, rows = random.Random(seed), []
    for key in ((0, 0), (0, 1), (4, 1)):
        at = rng.randrange(9)
        for _ in range(n):
            k = rng.choice([0, 1, 1, 2, 7, 200 if rng.random() < 0.05 else 3])
            code = rng.choice([S.NS, S.NS, S.EQS2, S.EQS2, S.DEL1, S.TRANS2])
            k = min(k, 1) if code == S.TRANS2 else k
            rows.append((*key, at, at + k, code))
            at += k + (rng.randrange(5) if rng.random() < 0.2 else 0)
    return rows


def joined(rows):
    out = []
    for r in sorted(x for x in rows if x[3] > x[2]):
        if out and out[-1][:2] == r[:2] and out[-1][3] == r[2] and out[-1][4] == r[4] and r[4] != S.TRANS2:
            out[-1] = (*out[-1][:3], r[3], r[4])
        else:
            out.append(r)
    return out


@pytest.mark.parametrize("width", WIDTHS)
def test_normalise(spark, width):
    rows = pieces(1)
    got = R.normalize(spark.createDataFrame(rows, S.RUNS).repartition(3), width=width)
    assert sorted(map(tuple, got.collect())) == joined(rows)
    one = [(0, 0, i * 10, i * 10 + 10, S.EQS2) for i in range(400)]
    assert [tuple(r) for r in R.normalize(spark.createDataFrame(one, S.RUNS), width=width).collect()] == [(0, 0, 0, 4000, S.EQS2)]
    assert R.normalize(spark.createDataFrame(one, S.RUNS).limit(0), width=width).count() == 0


@pytest.mark.parametrize("width", WIDTHS)
def test_regions(spark, width):
    rng = random.Random(2)
    bed = [(c, s := rng.randrange(2000), s + rng.choice([0, 1, 5, 40, 300])) for c in (0, 2) for _ in range(60)]
    want = []
    for c, s, e in sorted(x for x in bed if x[2] > x[1]):
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(want[-1][2], e))
        else:
            want.append((c, s, e))
    assert sorted(map(tuple, merged_regions(spark.createDataFrame(bed, S.BED), width).collect())) == want


@pytest.mark.parametrize("width", WIDTHS)
def test_gaps(spark, width):
    rng = random.Random(3)
    points = [(i, c, p, rng.choice([S.TRANS2, S.REFCOMPL])) for i, c in ((0, 0), (1, 0), (1, 1)) for p in sorted(rng.sample(range(900), 60))] + [(2, 1, 0, S.TRANS2), (2, 0, 999, S.TRANS2), (0, 7, 5, S.TRANS2)]
    contigs = spark.createDataFrame([(0, "1", 1000), (1, "2", 901)], S.CONTIGS)
    want = []
    for i, c, length in ((0, 0, 1000), (1, 0, 1000), (1, 1, 901), (2, 1, 901), (2, 0, 1000)):
        at = 0
        for p, code in [(x[2], x[3]) for x in points if x[:2] == (i, c)] + [(length, None)]:
            want += [(i, c, at, p, S.NS)] * (p > at) + [(i, c, p, p + 1, code)] * (code is not None)
            at = p + 1
    df = spark.createDataFrame(points, "sample_ix int, chrom_ix int, pos int, code int")
    assert sorted(map(tuple, R.gap_fill(df, contigs, S.NS, width=width).collect())) == sorted(want)
    bed = [(0, 100, 300), (0, 250, 400), (1, 0, 10), (1, 800, 2000)]
    inside = {(c, p) for c, s, e in bed for p in range(s, e)}
    got = R.gap_fill_patches(df, contigs, spark.createDataFrame(bed, S.BED), width=width).collect()
    at = {(r["sample_ix"], r["chrom_ix"], p): r["code"] for r in got for p in range(r["run_start"], r["run_end"])}
    called = {x[:3]: x[3] for x in points if x[1] != 7}
    assert at == {(i, c, p): called.get((i, c, p), S.EQS2 if (c, p) in inside else S.NS) for i, c, s, e, _ in want for p in range(s, e)}
    assert sum(r["run_end"] - r["run_start"] for r in got) == len(at)


@pytest.mark.parametrize("width", WIDTHS)
def test_blocks(spark, width):
    rng = random.Random(4)
    blocks = [(c, rng.randrange(3000), rng.choice([0, 1, 9, 30, 400]), i * 3 + c) for c in (0, 1) for i in range(150)]
    last = {(c, s): (n, o) for c, s, n, o in sorted(blocks, key=lambda b: b[3])}
    rows = sorted((c, s, n, o) for (c, s), (n, o) in last.items())
    df = spark.createDataFrame(blocks, "chrom_ix int, start int, len int, ord long").repartition(4)
    want = []
    for c, s, n, o in rows:
        others = [(x[1], x[1] + x[2]) for x in rows if x[0] == c and x[1] != s]
        after = [a for a, _ in others if a > s]
        want.append((c, s, n, o, any(a < s < e for a, e in others), bool(after) and min(after) < s + n))
    assert sorted(map(tuple, R.block_overlaps(df, width).collect())) == want
    contigs = spark.createDataFrame([(0, "1", 4000), (1, "2", 4000), (2, "3", 8)], S.CONTIGS)
    used = []
    for c in (0, 1):
        end = 0
        for _, s, n, o in (x for x in rows if x[0] == c):
            if s >= end:
                used.append((c, s, s + n, o))
                end = s + n
    whole = list(used)
    for c, length in ((0, 4000), (1, 4000), (2, 8)):
        at = 0
        for s, e in [(x[1], x[2]) for x in used if x[0] == c] + [(length, length)]:
            whole += [(c, at, s, None)] * (s > at)
            at = e
    got = R.assemble(df, contigs, width, part=width)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(whole, key=str)
    assert R.assemble(df.limit(0), contigs, width, part=width).count() == 3


def test_no_window_over_a_whole_chromosome(spark):
    """What is ordered along a chromosome is what bins have handed up: their ends, not their rows."""
    rows = [(0, 0, i * 2, i * 2 + 1, S.EQS2) for i in range(5000)]
    runs = spark.createDataFrame(rows, S.RUNS)
    own = R._islands(runs.withColumn("_bin", runs["run_start"] / 1000 - runs["run_start"] / 1000 % 1), ("sample_ix", "chrom_ix", "_bin"), R.KEY)
    assert own.count() == 5000 and R.normalize(runs, width=1000).count() == 5000
    f = G.composed(G.IDENTITY, G.function_of(*(np.array(x) for x in zip(*[r[2:4] for r in rows], strict=True)), 100, 0), 100)
    assert len(f[0]) <= 102
