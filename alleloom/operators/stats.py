"""Allele-sharing statistics: scores per variant, block sums, and the weighted block jackknife.

A statistic is a small table of sample index combinations. Scores are sums of products of allele counts over
`calls`; every product of counts is a power of two, so the sums over variants are exact in any order.

`summed` scores batches of variants as matrices, variants by combinations, and adds them up by block where they are read,
so what is shuffled is blocks times combinations, not variants times combinations, and the plan doesn't grow with either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleloom.functions.beta import p_value_udf
from alleloom.operators import merge as M
from alleloom.operators.greedy import greedy_starts_of
from alleloom.operators.sweep import dealt, swept
from alleloom.schema import PSEUDO

#: Fixed value: the default block, in bases.
BLOCK = 5_000_000


# --- combinations and their labels, in one order ---------------------------------------------


def kay_combos(good: int, labels: Sequence[str]) -> list[tuple[tuple[int, ...], tuple[str, ...]]]:
    """(reference-like, sample, other good genome); index -1 is the reference allele, which counts as good."""
    names = ["reference", *labels]
    return [((a - 1, s - 1, b - 1), (names[a], names[s], names[b])) for a, b in combinations(range(good + 1), 2) for s in range(len(names)) if s not in (a, b)]


def patterson_combos(nout: int, nref: int, labels: Sequence[str]) -> list[tuple[tuple[int, ...], tuple[str, ...]]]:
    """(sample, outgroup, panel, panel)."""
    n = len(labels)
    return [((s, o, g, h), tuple(labels[i] for i in (s, o, g, h))) for o in range(min(nout, n)) for g, h in combinations(range(nout, min(nout + nref, n)), 2) for s in range(nout + nref, n)]


def yadda_combos(nape: int, nout: int, nnea: int, labels: Sequence[str]) -> list[tuple[tuple[int, ...], tuple[str, ...]]]:
    """(ape, archaic, archaic, sample, outgroup)."""
    n, at = len(labels), nape + nout
    return [((c, a, b, s, y), tuple(labels[i] for i in (c, a, b, s, y))) for c in range(min(nape, n)) for y in range(nape, min(at, n)) for a, b in combinations(range(at, min(at + nnea, n)), 2) for s in range(at + nnea, n)]


# --- scores ---------------------------------------------------------------------------------

#: Patterns count one state per taxon: "A" takes a taxon's reference alleles, "D" its others; each also in reverse.
KAY = {"aa": ("ADD",), "bb": ("AAD",)}
PATTERSON = {"aa": ("DADA",), "bb": ("ADDA",)}
YADDA = {"aa": ("AADDA", "AADDD", "ADAAD"), "bb": ("AADAD", "ADADA", "ADADD")}
#: The taxa of a statistic's combinations.
NAMES = {
    "kayvergence": ("reference", "sample", "outgroup"),
    "dstatistics": ("sample", "outgroup", "panel_a", "panel_b"),
    "f4statistics": ("sample", "outgroup", "panel_a", "panel_b"),
    "yaddayadda": ("ape", "archaic_a", "archaic_b", "sample", "african"),
}


#: Combinations scored at once, and sums held before they are handed on.
_AT_ONCE, _HELD = 64, 1 << 21
_SUMS = "chrom_ix int, block long, combo int, k double, n double, t double"


def _scored(ref: np.ndarray, alt: np.ndarray, patterns: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, n, t) from counts by variant, combination and taxon."""

    def ways(pattern: str) -> np.ndarray:
        out = []
        for states in (pattern, pattern.translate(str.maketrans("AD", "DA"))):
            x = np.ones(ref.shape[:2])
            for i, s in enumerate(states):
                x *= (ref if s == "A" else alt)[:, :, i]
            out.append(x)
        return out[0] + out[1]

    aa, bb = (sum(map(ways, patterns[kind])) for kind in ("aa", "bb"))
    nn = (ref + alt).prod(2)
    ok = nn > 0
    nn = np.where(ok, nn, 1)
    return np.where(ok, aa / nn, 0), np.where(ok, (aa + bb) / nn, 0), ok.astype(float)


def _numbers(calls: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_ref, n_alt) by variant and sample; the last column is the reference allele."""
    flat = calls.flatten()
    out = [flat.field(f).to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) for f in ("n_ref", "n_alt")]
    return np.concatenate([out[0], np.ones((n, 1))], 1), np.concatenate([out[1], np.zeros((n, 1))], 1)


def summed(variants: DataFrame, combos: Sequence[tuple[int, ...]], patterns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(chrom_ix, block, combo, k, n, t) of wide variants with `block` and, if there is one, `weight`."""
    index = np.array(combos, int).reshape(len(combos), -1 if len(combos) else 0)
    weighted = "weight" in variants.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                m = len(index)
                chrom, block = (np.array([k[i] for k in held]).repeat(m) for i in (0, 1))
                sums = np.concatenate(list(held.values()), 1)
                yield pa.RecordBatch.from_arrays([pa.array(chrom.astype(np.int32)), pa.array(block), pa.array(np.tile(np.arange(m, dtype=np.int32), len(held))), *map(pa.array, sums)], names=["chrom_ix", "block", "combo", "k", "n", "t"])
                held.clear()

        for b in batches:
            if not b.num_rows or not len(index):
                continue
            chrom, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            ref, alt = _numbers(b.column(2), b.num_rows)
            order = np.lexsort((block, chrom))
            chrom, block, ref, alt = chrom[order], block[order], ref[order], alt[order]
            weight = b.column(3).to_numpy()[order].astype(float) if weighted else np.ones(len(order))
            new = np.ones(len(order), bool)
            new[1:] = (chrom[1:] != chrom[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            sums = np.zeros((3, len(at), len(index)))
            for i in range(0, len(index), _AT_ONCE):
                c = index[i : i + _AT_ONCE]
                for j, x in enumerate(_scored(ref[:, c], alt[:, c], patterns)):
                    sums[j, :, i : i + _AT_ONCE] = np.add.reduceat(x * weight[:, None], at, 0)
            for j, k in enumerate(at):
                key = (int(chrom[k]), int(block[k]))
                held[key] = held[key] + sums[:, j] if key in held else sums[:, j]
            if len(held) * len(index) > _HELD:
                yield from out()
        yield from out()

    columns = ["chrom_ix", F.col("block").cast("long").alias("block"), "calls", *(["weight"] if weighted else [])]
    part = variants.select(*columns).mapInArrow(run, _SUMS)
    return part.groupBy("chrom_ix", "block", "combo").agg(*(F.sum(c).alias(c) for c in ("k", "n", "t")))


# --- blocks ---------------------------------------------------------------------------------


def grid_blocks(df: DataFrame, size: int) -> DataFrame:
    """Fixed windows: `block` is the number of the window."""
    return df.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def greedy_starts(df: DataFrame, size: int, part: int | None = None) -> DataFrame:
    """(chrom_ix, block): starts of greedy blocks. A block starts at the first position left and takes what lies within size;
    parts of a chromosome find theirs at the same time (operators/greedy.py)."""
    return greedy_starts_of(df.select("chrom_ix", F.col("pos").alias("s"), (F.col("pos") + 1).alias("e")).distinct(), size, part)


def placed_in(df: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """df with `block`, the start of its block: an equi-join, as a start lies in the position's grid window or the one before."""
    near = starts.select("chrom_ix", F.col("block"), F.explode(F.array(F.floor(F.col("block") / size), F.floor(F.col("block") / size) + 1)).alias("w"))
    at = df.withColumn("w", F.floor(F.col("pos") / size))
    return at.join(near, ["chrom_ix", "w"]).where((F.col("block") <= F.col("pos")) & (F.col("pos") < F.col("block") + size)).drop("w")


def greedy_blocks(df: DataFrame, size: int) -> DataFrame:
    """df with `block`, the start of its greedy block."""
    return placed_in(df, greedy_starts(df, size), size)


def blocked(variants: DataFrame, size: int = BLOCK, grid: bool = False) -> DataFrame:
    """variants with their `block`. The grid variant is cheaper and gives other blocks."""
    return grid_blocks(variants, size) if grid else greedy_blocks(variants, size)


def block_sums(variants: DataFrame, combos: Sequence[tuple[int, ...]], patterns: dict[str, tuple[str, ...]], size: int = BLOCK, grid: bool = False) -> DataFrame:
    """(chrom_ix, block, combo, k, n, t) of wide variants."""
    return summed(blocked(variants, size, grid), combos, patterns)


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("combo").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.count("*").alias("g"))


def jackknife(blocks: DataFrame) -> DataFrame:
    """(combo, k, n, t, g, v): totals, the number of blocks and the variance of k/n by the delete-m jackknife.

    v is null where it is undefined: no data, or a block that holds all of it.
    """
    # one row per combination, a table the caller enumerated
    all_ = totals(blocks)
    j = blocks.select("combo", F.col("k").alias("kj"), F.col("n").alias("mj")).join(all_, "combo")
    d = F.col("kj") * F.col("kj") / F.col("mj") - 2 * F.col("kj") * F.col("k") / F.col("n") + F.col("k") * F.col("k") * F.col("mj") / (F.col("n") * F.col("n"))
    term = F.when(F.col("mj") != 0, F.when(F.col("n") == F.col("mj"), F.lit(None)).otherwise(d / (F.col("n") - F.col("mj")))).otherwise(0.0)
    v = j.groupBy("combo").agg(F.sum(term).alias("s"), F.max(F.when((F.col("mj") != 0) & (F.col("mj") == F.col("n")), 1).otherwise(0)).alias("bad"))
    return all_.join(v, "combo").select("combo", "k", "n", "t", "g", F.when((F.col("bad") == 0) & (F.col("n") != 0), F.col("s") / F.col("g")).alias("v"))


def summarize(blocks: DataFrame) -> DataFrame:
    """(combo, k, n, t, g, ratio, r, f4, var, p): ratio = k/n, r = 2k/n - 1, f4 = (2k - n)/t, var = 4v."""
    k, n, t = F.col("k"), F.col("n"), F.col("t")
    safe = lambda a, b: F.when(b != 0, a / b)
    j = jackknife(blocks)
    return j.select("combo", "k", "n", "t", "g", safe(k, n).alias("ratio"), (2 * safe(k, n) - 1).alias("r"), safe(2 * k - n, t).alias("f4"), (4 * F.col("v")).alias("var"), p_value_udf(safe(k, n), F.col("v"), n).alias("p"))


def report(spark, blocks: DataFrame, combos: Sequence[tuple[tuple[int, ...], tuple[str, ...]]], names: Sequence[str]) -> DataFrame:
    """The statistic's table, one row per combination in label order, with a label column for each taxon."""
    labels = spark.createDataFrame([(i, *who) for i, (_, who) in enumerate(combos)], "combo int, " + ", ".join(f"{n} string" for n in names))
    return labels.join(summarize(blocks), "combo", "left").orderBy("combo")


# --- dense sites without a row for each base -------------------------------------------------


def placed_spans(rows: DataFrame, starts: DataFrame, size: int, width: int) -> DataFrame:
    """(chrom_ix, block, calls, weight) of sites and stretches (chrom_ix, s, e, calls; none crosses a bin of `width`), cut where
    blocks start; weight is a piece's length. A bin's rows meet the starts of the blocks that touch it, in order of place."""
    bins = F.sequence(F.floor(F.col("block") / width), F.floor((F.col("block").cast("long") + size - 1) / width))
    near = starts.select("chrom_ix", F.explode(bins).alias("bin"), F.lit(0).alias("kind"), F.col("block").alias("s"), F.col("block").alias("e"), F.lit(None).cast(rows.schema["calls"].dataType).alias("calls"))
    both = near.unionByName(rows.select("chrom_ix", F.floor(F.col("s") / width).alias("bin"), F.lit(1).alias("kind"), "s", "e", "calls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, np.zeros(0, np.int64)  # the bin at hand and its starts, which come first
        for b in batches:
            if not b.num_rows:
                continue
            chrom, bin_, kind, s, e = (b.column(i).to_numpy().astype(np.int64) for i in range(5))
            edge = np.append(np.flatnonzero(np.append(True, (chrom[1:] != chrom[:-1]) | (bin_[1:] != bin_[:-1]))), len(s))
            block, weight, take = [], [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if key != (chrom[lo], bin_[lo]):
                    key, at = (chrom[lo], bin_[lo]), np.zeros(0, np.int64)
                mid = lo + int((kind[lo:hi] == 0).sum())
                at = np.append(at, s[lo:mid])
                if mid == hi:
                    continue
                first = np.searchsorted(at, s[mid:hi], "right") - 1
                n = np.searchsorted(at, e[mid:hi], "left") - first  # a piece for the block at hand and each that starts inside
                row = np.repeat(np.arange(mid, hi), n)
                k = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                stop = np.append(at, 1 << 40)[k + 1]
                block.append(at[k])
                weight.append(np.minimum(stop, e[row]) - np.maximum(at[k], s[row]))
                take.append(row)
            if take:
                i = np.concatenate(take)
                yield pa.RecordBatch.from_arrays([pa.array(chrom[i].astype(np.int32)), pa.array(np.concatenate(block)), b.column(5).take(pa.array(i)), pa.array(np.concatenate(weight).astype(np.int32))], names=["chrom_ix", "block", "calls", "weight"])

    schema = "chrom_ix int, block long, calls array<struct<n_ref:int,n_alt:int>>, weight int"
    return dealt(both, "chrom_ix", "bin").sortWithinPartitions("chrom_ix", "bin", "kind", "s").mapInArrow(run, schema)


def dense_blocks(variants: DataFrame | None, runs: DataFrame, n_samples: int, combos: Sequence[tuple[int, ...]], patterns: dict[str, tuple[str, ...]], size: int, width: int, grid: bool = True, within: Sequence[DataFrame] = (), without: Sequence[DataFrame] = (), sites: Column | None = None) -> DataFrame:
    """Block sums over dense sites: scores of real variants (merged without outgroups), plus those of the stretches between.

    Where nobody differs every position scores alike, so a stretch counts once, weighted by its length; greedy blocks cut
    stretches where they start. Without variants, they come from the same sweep as the stretches. within, without: regions
    that all sites lie in, or not, as interval algebra on stretches; sites: a condition on variants.
    """
    if variants is None:
        both = swept(runs, n_samples, 0, width, stretches=True, grid=size if grid else None, within=within, without=without)
    else:
        real = variants.select("chrom_ix", F.col("pos").alias("s"), (F.col("pos") + 1).alias("e"), "alt", "calls")
        both = real.unionByName(M.intervals(runs, n_samples, width, size if grid else None, within, without).withColumn("alt", F.lit(PSEUDO)))
    if sites is not None:
        both = both.where((F.col("alt") == PSEUDO) | sites)
    if grid:
        placed = both.select("chrom_ix", F.floor(F.col("s") / size).cast("long").alias("block"), "calls", (F.col("e") - F.col("s")).alias("weight"))
    else:
        placed = placed_spans(both, greedy_starts_of(both.select("chrom_ix", "s", "e"), size), size, width)
    return summed(placed, combos, patterns)
