"""The sweep over runs by bin: which calls every sample has at the sites of a bin, and between them.

Runs are cut at bins of a chromosome and dealt out by (chromosome, bin), once. A task has all samples' pieces of a bin, so it
finds the sites itself and looks up each sample's call at each of them by one pass over that sample's pieces, which are
sorted and don't overlap: the work of a bin is its pieces, its sites and what comes out, whatever the bin's width is. Rows
come out wide; nothing is joined or grouped afterwards. Of pieces of a sample that do overlap, the one that starts last
counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleloom import schema as S

#: Bin width for genomes.
WIDTH = 65536
SWEPT = "chrom_ix int, s int, e int, alt int, calls array<struct<n_ref:int,n_alt:int>>"
#: Pieces that are looked at together (whole bins), and calls in an Arrow batch.
_PIECES, _CALLS = 1 << 18, 1 << 20
#: Reference and alternative alleles by code and change (1, 2, 3).
_COUNTS = np.array([[S.counts(c, a) for a in range(4)] for c in range(16)], np.int32)
_N_REF, _N_ALT = _COUNTS[..., 0].copy(), _COUNTS[..., 1].copy()
_N_REF[:, 0] = _N_ALT[:, 0] = 0
_DIFFERS = _N_ALT.max(1) > 0


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by hashes of its keys, in as many partitions as a shuffle has. Given as a number they stay as many: adaptive execution
    puts partitions together by their compressed size, and runs compress so well that one of these took a GB to sort."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def binned(runs: DataFrame, width: int) -> DataFrame:
    """Runs, once for each bin that they touch."""
    return runs.where("run_end > run_start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("run_start") / width), F.floor((F.col("run_end") - 1) / width))))


def _joined(pieces: DataFrame, part: tuple[str, ...]) -> DataFrame:
    """Regions of a part that overlap or touch as one."""
    w = Window.partitionBy(*part).orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("s") <= top, 0).otherwise(1)
    return pieces.withColumn("_n", new).withColumn("_i", F.sum("_n").over(w)).groupBy(*part, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def merged_regions(bed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Regions without overlap: cut at bins and joined there; of a bin's regions only those that touch its ends go on in
    another bin, so just these are looked at along a chromosome."""
    cut = binned(bed.select("chrom_ix", F.col("s").alias("run_start"), F.col("e").alias("run_end")), width)
    begin, end = F.col("bin") * width, (F.col("bin") + 1) * width
    own = _joined(dealt(cut.select("chrom_ix", "bin", F.greatest("run_start", begin).alias("s"), F.least("run_end", end).alias("e")), "chrom_ix", "bin"), ("chrom_ix", "bin"))
    edge = (F.col("s") == begin) | (F.col("e") == end)
    out = own.where(~edge).drop("bin").unionByName(_joined(own.where(edge).drop("bin"), ("chrom_ix",)))
    return out.select("chrom_ix", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """From batches sorted by their first columns: tables of at least so many rows that hold whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if size >= least:
            same = np.ones(b.num_rows, bool)
            for i in range(keys):
                same &= b.column(i).to_numpy() == held[-1].column(i)[held[-1].num_rows - 1].as_py()
            cut = b.num_rows if same.all() else int(same.argmin())
            held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size, b = [], 0, b.slice(cut)
            else:
                continue
        held.append(b)
        size += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


class Pieces:
    """Pieces of runs by sample, each sample's in order of place; places are numbers that rise over the bins at hand."""

    def __init__(self, sample: np.ndarray, lo: np.ndarray, hi: np.ndarray, code: np.ndarray, n_samples: int):
        order = np.lexsort((lo, sample))
        self.lo, self.hi, self.code = lo[order], hi[order], code[order]
        self.at = np.searchsorted(sample[order], np.arange(n_samples + 1), "left")

    def codes(self, places: np.ndarray) -> np.ndarray:
        """The code at each of the places (which rise) in each sample, 0 where it has none."""
        out = np.zeros((len(places), len(self.at) - 1), np.int64)
        for i, (a, b) in enumerate(zip(self.at[:-1], self.at[1:], strict=True)):
            if a < b:
                j = np.searchsorted(self.lo[a:b], places, "right") - 1
                hit = (j >= 0) & (places < self.hi[a:b][j])
                out[hit, i] = self.code[a:b][j[hit]]
        return out


def _calls(n_ref: np.ndarray, n_alt: np.ndarray) -> pa.Array:
    rows, n = n_ref.shape
    both = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x, np.int32).ravel()) for x in (n_ref, n_alt)], names=["n_ref", "n_alt"])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), both)


def swept(runs: DataFrame, n_samples: int, nout: int = 0, width: int = WIDTH, sites: bool = True, stretches: bool = False, grid: int | None = None, within: Sequence[DataFrame] = (), without: Sequence[DataFrame] = ()) -> DataFrame:
    """(chrom_ix, s, e, alt, calls) of runs of n_samples samples.

    sites: variants, at which a sample other than the first nout has an alternative allele; e is s + 1.
    stretches: of alt 255, over which every sample's call stays the same, somebody is called, and nobody differs; calls are
    reference counts. Stretches end with bins of `width` and, if given, with windows of `grid`.
    within, without: regions (chrom_ix, s, e) that sites and stretches must lie in, or must not; stretches are cut where
    regions begin and end, so no row stands for a single base. Regions go along as if they were samples of their own.
    """
    lo = F.greatest(F.col("run_start").cast("long") - F.col("bin") * width, F.lit(0)).cast("int")
    hi = F.least(F.col("run_end").cast("long") - F.col("bin") * width, F.lit(width)).cast("int")
    called = binned(runs.where((F.col("code") > S.NS) & (F.col("code") < 15)), width)
    pieces = called.select(F.col("chrom_ix").cast("int").alias("chrom_ix"), F.col("bin").cast("int").alias("bin"), F.col("sample_ix").cast("int").alias("sample_ix"), lo.alias("lo"), hi.alias("hi"), F.col("code").cast("int").alias("code"))
    n_all = n_samples + len(within) + len(without)
    for i, r in enumerate((*within, *without)):
        region = binned(merged_regions(r).select(F.lit(n_samples + i).alias("sample_ix"), "chrom_ix", F.col("s").alias("run_start"), F.col("e").alias("run_end"), F.lit(S.EQS1).alias("code")), width)
        pieces = pieces.unionByName(region.select(*(F.col(c).cast("int").alias(c) for c in ("chrom_ix", "bin", "sample_ix")), lo.alias("lo"), hi.alias("hi"), "code"))
    inside, outside = slice(n_samples, n_samples + len(within)), slice(n_samples + len(within), n_all)
    at_once = max(1, _CALLS // max(n_all, 1))

    def allowed(c: np.ndarray) -> np.ndarray:
        return (c[:, inside] > 0).all(1) & ~(c[:, outside] > 0).any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2, _PIECES):
            chrom, bin_, sample, lo, hi, code = (t.column(i).to_numpy().astype(np.int64) for i in range(6))
            new = np.append(True, (chrom[1:] != chrom[:-1]) | (bin_[1:] != bin_[:-1]))
            group = np.cumsum(new) - 1
            # a place is the group's number times the width, and the position within the bin
            chrom, first = chrom[new], bin_[new] * width
            lo, hi = lo + group * width, hi + group * width
            own = Pieces(sample, lo, hi, code, n_all)

            def rows(s: np.ndarray, e: np.ndarray, alt: np.ndarray, n_ref: np.ndarray, n_alt: np.ndarray) -> pa.RecordBatch:
                g = s // width
                shift = first[g] - g * width
                columns = [chrom[g], s + shift, e + shift, alt]
                return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), _calls(n_ref, n_alt)], names=["chrom_ix", "s", "e", "alt", "calls"])

            if sites:
                point = (sample >= nout) & (sample < n_samples) & _DIFFERS[code]
                where, what = lo[point], code[point]
                found = np.unique(np.concatenate([where[_N_ALT[what, a] > 0] * 4 + a for a in (1, 2, 3)]))
                for i in range(0, len(found), at_once):
                    place, alt = found[i : i + at_once] // 4, found[i : i + at_once] % 4
                    c = own.codes(place)
                    if n_all > n_samples:
                        keep = allowed(c)
                        place, alt, c = place[keep], alt[keep], c[keep, :n_samples]
                    yield rows(place, place + 1, alt, _N_REF[c, alt[:, None]], _N_ALT[c, alt[:, None]])
            if stretches:
                edges = [lo, hi]
                if grid:
                    for g, a in enumerate(first.tolist()):
                        edges.append(np.arange(-(-a // grid) * grid, a + width, grid) - a + g * width)
                edge = np.unique(np.concatenate(edges))
                for i in range(0, len(edge) - 1, at_once):
                    s, e = edge[i : i + at_once], edge[i + 1 : i + 1 + at_once]
                    s = s[: len(e)]
                    c = own.codes(s)
                    keep = (c[:, :n_samples] > 0).any(1) & ~_DIFFERS[c[:, :n_samples]].any(1) & allowed(c)
                    if keep.any():
                        s, e, c = s[keep], e[keep], c[keep, :n_samples]
                        yield rows(s, e, np.full(len(s), S.PSEUDO), _N_REF[c, 1], np.zeros_like(c))

    return dealt(pieces, "chrom_ix", "bin").sortWithinPartitions("chrom_ix", "bin").mapInArrow(run, SWEPT)
