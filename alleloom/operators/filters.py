"""Filters of variants, and the assignment of samples to populations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleloom.functions import scalars as X
from alleloom.operators.merge import WIDTH, in_pieces, per_site

#: Chromosome patterns of the command line.
AUTOSOMES, X_CHROMOSOME, Y_CHROMOSOME = r"^(chr)?[0-9]+[a-z]?$", r"^(chr)?X$", r"^(chr)?Y$"


def restrict_to_regions(df: DataFrame, bed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows whose position lies in a region, by a sweep: within a bin, rows and beginnings of regions in order of position,
    a row stays if a region that has begun reaches beyond it. So overlapping regions repeat nothing, and the work of a bin
    is that of sorting its rows and regions."""
    bins = F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))
    r = bed.where("e > s").select("chrom_ix", "s", "e", F.explode(bins).alias("_bin"))
    begun = r.select("chrom_ix", "_bin", F.greatest(F.col("s").cast("long"), F.col("_bin") * width).alias("_at"), F.col("e").cast("long").alias("_e"), F.lit(False).alias("_row"))
    rows = df.select("*", F.floor(F.col("pos") / width).alias("_bin"), F.col("pos").cast("long").alias("_at"), F.lit(None).cast("long").alias("_e"), F.lit(True).alias("_row"))
    # rows of equal place count as begun together, whichever comes first
    reach = F.max("_e").over(Window.partitionBy("chrom_ix", "_bin").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.unionByName(begun, allowMissingColumns=True).withColumn("_reach", reach).where("_row and _at < _reach").select(df.columns)


def transversions(variants: DataFrame) -> DataFrame:
    return variants.where(X.is_transversion(F.col("alt")))


def biallelic(variants: DataFrame) -> DataFrame:
    """Sites with exactly one variant."""
    return per_site(variants).where("at_site = 1").drop("at_site")


def informative(variants: DataFrame, nout: int = 0) -> DataFrame:
    """Wide variants at which the samples from nout on have both alleles."""
    own = F.slice("calls", nout + 1, F.greatest(F.size("calls") - nout, F.lit(0)))
    total = lambda f: F.aggregate(own, F.lit(0), lambda acc, c: acc + c[f])
    return variants.where((total("n_ref") != 0) & (total("n_alt") != 0))


def _lent(chunks: DataFrame, size: int) -> DataFrame:
    """(chrom_ix, start, seq): reference chunks of `size` bases with a base from each side, N at the ends, in capitals."""
    own = chunks.select("chrom_ix", "start", "seq")
    before = chunks.select("chrom_ix", (F.col("start") + size).alias("start"), F.expr(f"substring(seq, {size}, 1)").alias("last"))
    after = chunks.select("chrom_ix", (F.col("start") - size).alias("start"), F.substring("seq", 1, 1).alias("first"))
    lent = own.join(before, ["chrom_ix", "start"], "left").join(after, ["chrom_ix", "start"], "left")
    return lent.select("chrom_ix", "start", F.upper(F.concat(F.coalesce("last", F.lit("N")), "seq", F.coalesce("first", F.lit("N")))).alias("seq"))


def cpg_sites(chunks: DataFrame, size: int) -> DataFrame:
    """(chrom_ix, s, e) of every CG of the reference: a pair belongs to the chunk of its C."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chrom, start, seq in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
                c = np.flatnonzero((t[1:-1] == ord("C")) & (t[2:] == ord("G"))).astype(np.int32) + start
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), chrom, np.int32)), pa.array(c), pa.array(c + 2)], names=["chrom_ix", "s", "e"])

    return _lent(chunks, size).select(F.col("chrom_ix").cast("int").alias("chrom_ix"), F.col("start").cast("int").alias("start"), "seq").mapInArrow(run, "chrom_ix int, s int, e int")


def drop_cpg(variants: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Without sites whose reference base is the C or the G of a CG; sites at chromosome ends and on N stay.

    Sites look at their neighbours in the piece of the reference chunk (of `size` bases) that they lie in; pieces share two
    bases, and chunks are lent one from each side. Sites beyond the reference stay.
    """
    near = in_pieces(variants, _lent(chunks, size), size, more=2, how="left")
    pair = F.expr("cast(substring(_bytes, pos - _start + 1, 3) as string)")
    return near.where(F.coalesce(~F.contains(pair, F.lit("CG")), F.lit(True))).select(variants.columns)


def select_chroms(df: DataFrame, contigs: DataFrame, pattern: str) -> DataFrame:
    return df.join(contigs.where(F.col("name").rlike(pattern)).select("chrom_ix"), "chrom_ix", "left_semi")


def assign_populations(samples: DataFrame, individuals: DataFrame) -> DataFrame:
    """Samples (sample_ix, label) with the population of the individual whose name is their longest prefix.

    None, or two of equal length, is an error. Prefixes are looked up by equality: every prefix of a label is a key. Both sides
    grow with the samples, so they are sorted and merged, and a label's finds are settled by one grouping.
    """
    label, n = F.col("label"), F.length("name").alias("n")
    prefix = samples.select("sample_ix", "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("label")), lambda k: F.substring(label, F.lit(1), k))).alias("name"))
    met = prefix.join(individuals.select("name", "pop").hint("merge"), "name").select("sample_ix", "label", n, "pop")
    # a row of length -1 for every sample: what is left where nothing is found
    every = met.unionByName(samples.select("sample_ix", "label", F.lit(-1).alias("n"), F.lit(None).cast("string").alias("pop")))
    by_length = every.repartition("sample_ix", "label").groupBy("sample_ix", "label", "n").agg(F.min("pop").alias("pop"), F.count("*").alias("k"))
    out = by_length.groupBy("sample_ix", "label").agg(F.max(F.struct("n", "pop", "k")).alias("b"))
    problem = F.when(F.col("b.n") < 0, F.raise_error(F.concat(F.lit("no individual for "), "label"))).when(F.col("b.k") > 1, F.raise_error(F.concat(F.lit("several individuals for "), "label")))
    return out.select("sample_ix", "label", F.coalesce(problem.cast("string"), F.col("b.pop")).alias("pop"))


def population_counts(variants: DataFrame, populations: list[str]) -> DataFrame:
    """Wide variants with `pops`: per population, in order of first appearance, its (name, n_ref, n_alt).

    populations[i] is the population of sample i.
    """
    names = list(dict.fromkeys(populations))

    def total(pop: str, f: str):
        out = F.lit(0)
        for i, p in enumerate(populations):
            if p == pop:
                out = out + F.col("calls")[i][f]
        return out

    return variants.withColumn("pops", F.array(*(F.struct(F.lit(p).alias("pop"), total(p, "n_ref").alias("n_ref"), total(p, "n_alt").alias("n_alt")) for p in names)))
