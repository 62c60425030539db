"""From read bases to haploid calls: collating, deamination, picking schemes and sampling."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleloom.functions import scalars as X

COUNTS = ("a", "c", "g", "t", "ar", "cr", "gr", "tr")
SCHEMES = ("ostrich", "ignore_t", "ignore_a", "ignore_c", "ignore_g", "stranded", "udg", "kay", "mateja", "mateja2")


class Known(NamedTuple):
    reads: DataFrame
    skipped: list[str]


def known_contigs(reads: DataFrame, contigs: DataFrame) -> Known:
    """Read bases with chrom_ix, by name if they have `chrom` instead; contigs that the reference lacks are skipped and
    named, and if none is left that is an error."""
    if "chrom" not in reads.columns:
        return Known(reads, [])
    names = reads.select("chrom").distinct().join(contigs.select(F.col("name").alias("chrom"), "chrom_ix"), "chrom", "left").collect()  # one row for each contig
    if not any(r["chrom_ix"] is not None for r in names):
        raise ValueError("none of the contigs is one of the reference's")
    met = reads.join(contigs.select(F.col("name").alias("chrom"), "chrom_ix"), "chrom").drop("chrom")
    return Known(met, sorted(str(r["chrom"]) for r in names if r["chrom_ix"] is None))


def collate(reads: DataFrame, min_mapq: int = 0, min_baseq: int = 0, snip: int = 0, snap: int = 0) -> DataFrame:
    """Counts of bases by strand from (chrom_ix, pos, base, strand, baseq, mapq, read_pos).

    read_pos counts from the 5' end if it is not negative, else from the 3' end.
    """
    inside = F.when(F.col("read_pos") >= 0, F.col("read_pos") >= snip).otherwise(F.col("read_pos") < -snap)
    ok = reads.where((F.col("mapq") >= min_mapq) & (F.col("baseq") >= min_baseq) & inside)
    n = lambda base, strand: F.count(F.when((F.upper("base") == base) & (F.col("strand") == strand), 1)).cast("int")
    return ok.groupBy("chrom_ix", "pos").agg(*(n(b, "+").alias(b.lower()) for b in "ACGT"), *(n(b, "-").alias(b.lower() + "r") for b in "ACGT"))


def _random(seed: int, what: str) -> Column:
    """A reproducible number for a site, independent of partitioning."""
    return F.abs(F.xxhash64(F.lit(seed), F.lit(what), "chrom_ix", "pos"))


def deaminate(piles: DataFrame, share: int = 50, seed: int = 0) -> DataFrame:
    """Moves about 1 in `share` of forward C to `u` and of reverse G to `ur`, rounding at random."""
    moved = lambda c: (F.floor(F.col(c) / share) + (F.pmod(_random(seed, c), F.lit(share)) < F.col(c) % share).cast("int")).cast("int")
    return piles.withColumn("u", moved("c")).withColumn("ur", moved("gr")).withColumn("c", F.col("c") - F.col("u")).withColumn("gr", F.col("gr") - F.col("ur"))


def pick_weights(piles: DataFrame, scheme: str) -> DataFrame:
    """piles (counts, u, ur, ref 0..3) with weights w_a, w_c, w_g, w_t, w_n of a scheme."""
    p = {k: F.col(k) for k in (*COUNTS, "u", "ur")}
    none = F.lit(0)
    every = {"a": p["a"] + p["ar"] + p["ur"], "c": p["c"] + p["cr"], "g": p["g"] + p["gr"], "t": p["t"] + p["tr"] + p["u"], "n": none}
    is_c, is_g = F.coalesce(F.col("ref") == 1, F.lit(False)), F.coalesce(F.col("ref") == 3, F.lit(False))
    #: what a scheme counts otherwise than all bases
    if scheme == "ostrich":
        own = {}
    elif scheme == "ignore_t":
        own = {"a": p["a"], "t": p["tr"]}
    elif scheme == "ignore_a":  # as specified, it also leaves out reverse T
        own = {"a": p["ar"] + p["ur"], "t": p["t"] + p["u"]}
    elif scheme == "ignore_c":
        own = {"c": p["cr"], "g": p["g"]}
    elif scheme == "ignore_g":
        own = {"c": p["c"], "g": p["gr"]}
    elif scheme == "stranded":
        own = {"a": p["a"], "c": p["cr"], "g": p["g"], "t": p["tr"]}
    elif scheme == "udg":
        own = {"a": p["a"] + p["ar"], "t": p["t"] + p["tr"]}
    elif scheme == "kay":
        own = {"a": p["a"], "t": p["tr"], "n": p["t"] + p["ar"] + p["ur"] + p["u"]}
    elif scheme == "mateja":
        back = is_c & (p["t"] + p["u"] > 0)
        ahead = is_g & (p["ar"] + p["ur"] > 0)
        only = lambda b, f, o: F.when(back, b).when(ahead, f).otherwise(o)
        own = {"a": only(p["ar"] + p["ur"], p["a"], every["a"]), "c": only(p["cr"], p["c"], every["c"]), "g": only(p["gr"], p["g"], every["g"]), "t": only(p["tr"], p["t"] + p["u"], every["t"])}
    elif scheme == "mateja2":
        own = {"a": F.when(is_g, p["a"]).otherwise(every["a"]), "t": F.when(is_c, p["tr"]).otherwise(every["t"])}
    else:
        raise ValueError(f"unknown scheme {scheme}")
    return piles.withColumns({f"w_{k}": (own.get(k, every[k])).cast("int") for k in "acgtn"})


def pick(weights: DataFrame, number: Column) -> DataFrame:
    """weights with `base` (0..3, null for N): the allele whose cumulative weight, in the order A C G T N, holds number."""
    total = F.col("w_a") + F.col("w_c") + F.col("w_g") + F.col("w_t") + F.col("w_n")
    i = F.pmod(number, total)
    a, c, g, t = (sum((F.col(f"w_{k}") for k in "acgt"[1 : n + 1]), F.col("w_a")) for n in range(4))
    return weights.withColumn("base", F.when(total == 0, None).when(i < a, 2).when(i < c, 1).when(i < g, 3).when(i < t, 0).cast("int"))


def sample_base(weights: DataFrame, seed: int = 0) -> DataFrame:
    return pick(weights, _random(seed, "pick"))


def to_points(picked: DataFrame, sample_ix: int = 0) -> DataFrame:
    """(sample_ix, chrom_ix, pos, code): haploid calls; fill the gaps with NS to make runs."""
    none = F.lit(-1)
    return picked.select(F.lit(sample_ix).alias("sample_ix"), "chrom_ix", "pos", X.code_from(F.coalesce("ref", none), F.coalesce("base", none)).alias("code"))
