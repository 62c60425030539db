"""Merging samples into biallelic variants by a sweep over their runs (operators/sweep.py).

Long form: (chrom_ix, pos, alt, sample_ix, n_ref, n_alt), one row per sample. Wide form: `calls`, an array of
(n_ref, n_alt) by sample. Bins of a chromosome are dealt out, so partitions are even however long runs are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.functions import scalars as X
from alleloom.operators.sweep import WIDTH, dealt, swept


def point_calls(runs: DataFrame) -> DataFrame:
    """(sample_ix, chrom_ix, pos, alt, n_ref, n_alt): the three changes of every point call."""
    alts = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("alt")
    p = runs.select("sample_ix", "chrom_ix", F.col("run_start").alias("pos"), "code", alts)
    return p.select("sample_ix", "chrom_ix", "pos", "alt", X.n_ref(F.col("code"), F.col("alt")).alias("n_ref"), X.n_alt(F.col("code"), F.col("alt")).alias("n_alt"))


def sites_of(runs: DataFrame, nout: int = 0) -> DataFrame:
    """Distinct (chrom_ix, pos, alt) at which a sample other than the first nout has an alternative allele."""
    code = F.col("code")
    alts = F.filter(F.array(*(F.when(X.n_alt(code, a) > 0, F.lit(a)) for a in (1, 2, 3))), lambda x: x.isNotNull())
    points = runs.where((F.col("sample_ix") >= nout) & ~code.isin(*S.STRETCHES) & (code < 15))
    return points.select("chrom_ix", F.col("run_start").alias("pos"), F.explode(alts).alias("alt")).distinct()


def long(variants: DataFrame) -> DataFrame:
    """Wide variants, one row per sample."""
    rest = [c for c in variants.columns if c != "calls"]
    return variants.select(*rest, F.posexplode("calls").alias("sample_ix", "c")).select(*rest, "sample_ix", "c.n_ref", "c.n_alt")


def merge_sparse(runs: DataFrame, n_samples: int, nout: int = 0, width: int = WIDTH) -> DataFrame:
    """Wide variants at which a non-outgroup differs; outgroups contribute calls but define no site."""
    return swept(runs, n_samples, nout, width).select("chrom_ix", F.col("s").alias("pos"), "alt", "calls")


def intervals(runs: DataFrame, n_samples: int, width: int = WIDTH, grid: int | None = None, within: Sequence[DataFrame] = (), without: Sequence[DataFrame] = ()) -> DataFrame:
    """(chrom_ix, s, e, calls) of stretches over which every sample's call stays the same, somebody is called, and nobody
    differs; calls are reference counts. Stretches end with bins of `width` and, if given, windows of `grid`; they lie within
    all of some regions and without others."""
    return swept(runs, n_samples, 0, width, sites=False, stretches=True, grid=grid, within=within, without=without).drop("alt")


def merge_dense(runs: DataFrame, n_samples: int, width: int = WIDTH) -> DataFrame:
    """All variants of any sample, and a pseudo-variant at every other position that is called in some sample."""
    both = swept(runs, n_samples, 0, width, stretches=True)
    return both.select("chrom_ix", F.explode(F.expr("sequence(s, e - 1)")).alias("pos"), "alt", "calls")


def merge_ref(runs: DataFrame, ref_bases: DataFrame, n_samples: int, width: int = WIDTH) -> DataFrame:
    """At least one record at every known reference base (chrom_ix, pos, ref), called or not, with the base."""
    known = ref_bases.where(X.is_known(F.col("ref")))
    none = F.transform(F.sequence(F.lit(1), F.lit(n_samples)), lambda _: F.struct(F.lit(0).alias("n_ref"), F.lit(0).alias("n_alt")))
    met = dealt(known, "chrom_ix", "pos").join(dealt(merge_dense(runs, n_samples, width), "chrom_ix", "pos").hint("merge"), ["chrom_ix", "pos"], "left")
    return met.select("chrom_ix", "pos", F.coalesce("alt", F.lit(S.PSEUDO)).alias("alt"), F.coalesce("calls", none).alias("calls"), "ref")


#: Bases in a piece of a reference chunk that is looked into: a lookup moves a piece, not a chunk.
PIECE = 1024


def pieces_of(chunks: DataFrame, size: int, more: int = 0) -> tuple[DataFrame, int]:
    """(chrom_ix, _start, _bytes) pieces of reference chunks of `size` bases, as bytes, so any base is found at once, and the
    number of bases by which pieces start; a piece ends `more` bases later."""
    piece = PIECE if size % PIECE == 0 else size
    whole = chunks.select("chrom_ix", "start", F.col("seq").cast("binary").alias("b"))
    each = whole.where(F.octet_length("b") > more).select("*", F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1 - more, F.lit(piece))).alias("k"))
    return each.select("chrom_ix", (F.col("start") + F.col("k")).cast("int").alias("_start"), F.expr(f"substring(b, k + 1, {piece + more})").alias("_bytes")), piece


def in_pieces(variants: DataFrame, chunks: DataFrame, size: int, more: int = 0, how: str = "inner") -> DataFrame:
    """Variants with the piece of the reference that they lie in: _start and _bytes."""
    pieces, piece = pieces_of(chunks, size, more)
    return variants.withColumn("_start", (F.floor(F.col("pos") / piece) * piece).cast("int")).join(pieces, ["chrom_ix", "_start"], how)


def add_ref(variants: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Variants with `ref` (0..3, null for N) looked up in reference chunks of `size` bases; sites past the end go."""
    met = in_pieces(variants, chunks, size).where("pos - _start < octet_length(_bytes)")
    letter = F.expr("cast(substring(_bytes, pos - _start + 1, 1) as string)")
    return met.withColumn("ref", X.base_code(letter)).drop("_start", "_bytes")


def bases_of(chunks: DataFrame) -> DataFrame:
    """(chrom_ix, pos, ref) of every base of reference chunks; ref is null for N."""
    return chunks.select("chrom_ix", "start", F.posexplode(F.split("seq", "")).alias("i", "c")).where("c <> ''").select("chrom_ix", (F.col("start") + F.col("i")).alias("pos"), X.base_code(F.col("c")).alias("ref"))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The letter of every (reference byte, run code): the reference's own where a sample is as it, two bases as one letter."""
    out = np.full((256, 64), ord("N"), np.uint8)
    for code in (S.EQS1, S.EQS2, S.DELH):
        out[:, code] = np.arange(256)
    out[:, [S.DEL1, S.DEL2]] = ord("-")
    for base, letter in enumerate(S.BASES):
        for code, alleles in S.ALLELES.items():
            if code not in S.STRETCHES:
                pair = "".join(sorted(S.BASES[base ^ a] for a in (alleles * 2)[:2]))
                out[[ord(letter), ord(letter.lower())], code] = ord(S.LETTER_OF[pair])
    return out


def patch(runs: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """The samples' texts: runs applied to the reference, chunk by chunk: (sample_ix, chrom_ix, start, seq).

    Uncovered positions are N. A chunk's runs are painted over its bases, all positions of a chunk at once, by a table of
    reference letter and code.
    """
    r = runs.where("run_end > run_start").withColumn("start", F.explode(F.sequence(F.floor(F.col("run_start") / size), F.floor((F.col("run_end") - 1) / size))))
    r = r.withColumn("start", (F.col("start") * size).cast("int"))
    lo, hi = F.greatest("run_start", "start") - F.col("start"), F.least(F.col("run_end"), F.col("start") + size) - F.col("start")
    # a chunk's runs of a sample: at most one for each of its bases
    own = r.groupBy("sample_ix", "chrom_ix", "start").agg(F.collect_list(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.col("code").cast("int").alias("code"))).alias("x"))
    met = own.join(chunks.select("chrom_ix", "start", F.col("seq").cast("binary").alias("seq")), ["chrom_ix", "start"])

    def painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letters()
        for b in batches:
            out = []
            for x, seq in zip(b.column(3), b.column(4), strict=True):
                ref = np.frombuffer(seq.as_buffer(), np.uint8)
                text = np.full(len(ref), ord("N"), np.uint8)
                lo, hi, code = (x.values.field(i).to_numpy() for i in range(3))
                hi = np.minimum(hi, len(ref))
                n = np.maximum(hi - lo, 0)
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                text[at] = table[ref[at], np.repeat(code, n)]
                out.append(text.tobytes().decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], names=["sample_ix", "chrom_ix", "start", "seq"])

    have = met.select(*(F.col(c).cast("int").alias(c) for c in ("sample_ix", "chrom_ix", "start")), "x", "seq").mapInArrow(painted, f"sample_ix int, {S.CHUNKS}")
    # chunks that no run touches
    ids = runs.agg(F.collect_set("sample_ix").alias("ids")).first()["ids"]  # one number per sample
    every = chunks.select(F.explode(F.array(*(F.lit(i) for i in sorted(ids)))).alias("sample_ix"), "chrom_ix", "start", F.length("seq").alias("n"))
    bare = every.join(have, ["sample_ix", "chrom_ix", "start"], "left_anti").select("sample_ix", "chrom_ix", "start", F.expr("repeat('N', n)").alias("seq"))
    return have.unionByName(bare)


def per_site(variants: DataFrame) -> DataFrame:
    """Variants with `at_site`, the number of variants at their position."""
    return variants.withColumn("at_site", F.count("*").over(Window.partitionBy("chrom_ix", "pos")))
