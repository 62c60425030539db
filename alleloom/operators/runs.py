"""Making and shaping runs: from text, from calls, from alignment blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.functions import scalars as X
from alleloom.operators.greedy import kept_blocks
from alleloom.operators.sweep import WIDTH, binned, dealt, merged_regions, whole_groups

KEY = ("sample_ix", "chrom_ix")
_JOINABLE = (*S.STRETCHES, *S.INDELS)
#: What is not known yet of a gap: no code.
_GAP = -2
#: Letters in a piece of a text.
CHUNK = 65536


def _islands(r: DataFrame, part: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """Adjacent stretches (and indels) of equal code within a part as one."""
    return _touching(r, part, F.col("code").isin(*_JOINABLE))


def _touching(r: DataFrame, part: tuple[str, ...], which: Column | None = None) -> DataFrame:
    """Adjacent runs of equal code (`which`: of these) within a part as one: runs that begin one stay, and end where the run
    before the next beginning ends. One sort serves all windows, and nothing is grouped."""
    w = Window.partitionBy(*part).orderBy("run_start", "run_end")
    before = F.lag("run_end").over(w)
    joins = (F.col("code") == F.lag("code").over(w)) & (before == F.col("run_start"))
    joins = joins if which is None else which & joins
    last = F.last("run_end").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = r.withColumns({"_joins": F.coalesce(joins, F.lit(False)), "_before": before, "_last": last}).where("not _joins")
    end = F.coalesce(F.lead("_before").over(w), F.col("_last"))
    return begins.select(*part, "run_start", end.alias("run_end"), "code")


def normalize(runs: DataFrame, key: tuple[str, ...] = KEY, width: int = WIDTH) -> DataFrame:
    """Drops empty runs and joins adjacent stretches (and indels) of equal code, bin by bin: of a bin's joined runs only the
    first and the last can go on in another bin, so just these two of every bin are looked at along a chromosome."""
    columns = (*key, "run_start", "run_end", "code")
    r = runs.where("run_end > run_start").select(*columns, F.floor(F.col("run_start") / width).alias("_bin"))
    own = _islands(dealt(r, *key, "_bin"), (*key, "_bin"), key)
    w = Window.partitionBy(*key, "_bin")
    edge = (F.col("run_start") == F.min("run_start").over(w)) | (F.col("run_start") == F.max("run_start").over(w))
    own = own.withColumn("_edge", edge)
    return own.where("not _edge").select(*columns).unionByName(_islands(own.where("_edge").select(*columns), key, key))


def following(spans: DataFrame, key: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    """(key, run_start, run_end) of what follows each span (key, lo, hi) up to the next one's beginning, null after the last:
    within bins by a window, between bins from one row for each."""
    b = spans.select(*key, "lo", "hi", F.floor(F.col("lo") / width).alias("_bin"))
    inner = b.withColumn("to", F.lead("lo").over(Window.partitionBy(*key, "_bin").orderBy("lo", "hi"))).where("to is not null")
    ends = b.groupBy(*key, "_bin").agg(F.min("lo").alias("first"), F.max_by("hi", F.struct("lo", "hi")).alias("hi"))
    between = ends.withColumn("to", F.lead("first").over(Window.partitionBy(*key).orderBy("_bin")))
    return inner.select(*key, F.col("hi").alias("run_start"), F.col("to").alias("run_end")).unionByName(between.select(*key, F.col("hi").alias("run_start"), F.col("to").alias("run_end")))


def make_hap(runs: DataFrame) -> DataFrame:
    return runs.withColumn("code", X.make_hap(F.col("code")))


def gap_fill(points: DataFrame, contigs: DataFrame, gap: int, key: tuple[str, ...] = KEY, width: int = WIDTH) -> DataFrame:
    """Point calls (key, pos, code) as runs over whole contigs; what lies between is of code `gap` (NS or EQS2)."""
    p = points.join(contigs.select("chrom_ix"), "chrom_ix", "left_semi")
    open_ = following(p.select(*key, F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi")), key, width).join(contigs.select("chrom_ix", "length"), "chrom_ix")
    after = open_.select(*key, "run_start", F.coalesce("run_end", "length").alias("run_end"), F.lit(gap).alias("code"))
    first = p.groupBy(*key).agg(F.min("pos").alias("run_end")).select(*key, F.lit(0).alias("run_start"), "run_end", F.lit(gap).alias("code"))
    calls = p.select(*key, F.col("pos").alias("run_start"), (F.col("pos") + 1).alias("run_end"), "code")
    return calls.unionByName(after).unionByName(first).where("run_end > run_start")


def _cut_by_regions(gaps: DataFrame, regions: DataFrame, inside: int, outside: int, width: int, key: tuple[str, ...]) -> DataFrame:
    """(key, gap_start, run_start, run_end, code, edge): gaps (key, run_start, run_end), cut at bins and where merged regions
    begin and end; edge: a bin's border cuts the piece off.

    A bin's regions come first, and each of its gaps meets only those between its ends, which a search in their order finds.
    """
    others = [c for c in key if c != "chrom_ix"]
    lo, hi = F.greatest(F.col("run_start").cast("long"), F.col("bin") * width), F.least(F.col("run_end").cast("long"), (F.col("bin") + 1) * width)
    kinds = {f.name: f.dataType for f in gaps.schema.fields}
    r = binned(regions.select("chrom_ix", F.col("s").alias("run_start"), F.col("e").alias("run_end")), width).select("chrom_ix", "bin", F.lit(0).alias("kind"), lo.alias("lo"), hi.alias("hi"), *(F.lit(None).cast("int").alias(c) for c in ("gap_start", "gap_end")), *(F.lit(None).cast(kinds[c]).alias(c) for c in others))
    g = binned(gaps, width).select("chrom_ix", "bin", F.lit(1).alias("kind"), lo.alias("lo"), hi.alias("hi"), F.col("run_start").cast("int").alias("gap_start"), F.col("run_end").cast("int").alias("gap_end"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2, 1 << 17):
            chrom, bin_, kind, lo, hi = (t.column(i).to_numpy().astype(np.int64) for i in range(5))
            group = np.cumsum(np.append(True, (chrom[1:] != chrom[:-1]) | (bin_[1:] != bin_[:-1]))) - 1
            # places of one bin after those of the others, with room between
            shift = group * (width + 1) - bin_ * width
            gap = np.flatnonzero(kind == 1)
            s, e = (lo + shift)[kind == 0], (hi + shift)[kind == 0]
            a, z = (lo + shift)[gap], (hi + shift)[gap]
            first, last = np.searchsorted(e, a, "right"), np.searchsorted(s, z, "left")
            # a gap with n regions has n pieces inside, and n + 1 between and around them, some of them empty
            n = 2 * np.maximum(last - first, 0) + 1
            i = np.repeat(np.arange(len(gap)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at, good = first[i] + k // 2, k % 2 == 1
            s, e = np.append(s, 0), np.append(e, 0)
            begin = np.where(good, np.maximum(s[at], a[i]), np.where(k == 0, a[i], e[at - 1]))
            end = np.where(good, np.minimum(e[at], z[i]), np.where(k == n[i] - 1, z[i], s[at]))
            keep = end > begin
            i, begin, end, good = gap[i[keep]], begin[keep] - shift[gap[i[keep]]], end[keep] - shift[gap[i[keep]]], good[keep]
            own = t.take(pa.array(i))
            bin_ = bin_[i]
            edge = ((begin == bin_ * width) & (begin > own["gap_start"].to_numpy())) | ((end == (bin_ + 1) * width) & (end < own["gap_end"].to_numpy()))
            out = {"chrom_ix": own["chrom_ix"], **{c: own[c] for c in others}, "gap_start": own["gap_start"], "run_start": pa.array(begin.astype(np.int32)), "run_end": pa.array(end.astype(np.int32)), "code": pa.array(np.where(good, inside, outside).astype(np.int32)), "edge": pa.array(edge)}
            yield from pa.table({c: out[c] for c in (*key, "gap_start", "run_start", "run_end", "code", "edge")}).to_batches(1 << 16)

    schema = gaps.select(*key).schema.add("gap_start", "integer").add("run_start", "integer").add("run_end", "integer").add("code", "integer").add("edge", "boolean")
    return dealt(r.unionByName(g), "chrom_ix", "bin").sortWithinPartitions("chrom_ix", "bin", "kind", "lo").mapInArrow(run, schema)


def gap_fill_patches(points: DataFrame, contigs: DataFrame, bed: DataFrame, inside: int = S.EQS2, outside: int = S.NS, width: int = 1024, key: tuple[str, ...] = KEY) -> DataFrame:
    """Gap filling by region: `inside` of the merged regions, `outside` elsewhere. poor patches: swap the two codes.

    Gaps are cut bin by bin; of their pieces only those that a bin's border cuts off are looked at along a gap.
    """
    own = points.join(contigs.select("chrom_ix"), "chrom_ix", "left_semi")
    calls = own.select(*key, F.col("pos").alias("run_start"), (F.col("pos") + 1).alias("run_end"), "code")
    gaps = gap_fill(points, contigs, _GAP, key).where(F.col("code") == _GAP).drop("code")
    cut = _cut_by_regions(gaps, merged_regions(bed), inside, outside, max(width, WIDTH // 4), key)
    columns = (*key, "run_start", "run_end", "code")
    across = _touching(cut.where("edge").drop("edge"), (*key, "gap_start"))
    return calls.unionByName(cut.where("not edge").select(*columns)).unionByName(across.select(*columns))


def clean(raw: DataFrame) -> DataFrame:
    """Raw records on known chromosomes whose alleles are all single letters."""
    return raw.where((F.col("chrom_ix") >= 0) & (F.length("ref") == 1) & F.forall(F.coalesce("alts", F.array().cast("array<string>")), lambda a: F.length(a) == 1))


def dedup(raw: DataFrame, key: tuple[str, ...] = ("chrom_ix", "pos")) -> DataFrame:
    """The first record of each position, by input order; a keyed minimum, which combines before the shuffle."""
    others = [c for c in raw.columns if c not in (*key, "ord")]
    one = raw.groupBy(*key).agg(F.min_by(F.struct(*others), "ord").alias("_x"), F.min("ord").alias("ord"))
    return one.select(*key, "ord", *(F.col(f"_x.{c}").alias(c) for c in others)).select(raw.columns)


def contiguous(raw: DataFrame) -> DataFrame:
    """raw, if the records of every chromosome follow each other in input order (ord); a reappearing one is an error.

    They do if the ranges of ord of no two chromosomes overlap: two numbers a chromosome are looked at.
    """
    spans = raw.where("chrom_ix >= 0").groupBy("chrom_ix").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).orderBy("lo").collect()
    for a, b in zip(spans, spans[1:], strict=False):
        if b["lo"] < a["hi"]:
            raise ValueError(f"chromosome {a['chrom_ix']} reappears after another one; input must be sorted")
    return raw


def call_codes(raw: DataFrame) -> DataFrame:
    """(chrom_ix, pos 0-based, code) of raw records with ref, alts, a1, a2 (allele numbers, -1 missing, a2 null haploid).

    Any N allele is uncalled; "." and "./." are uncalled; the reference alone, or with a missing allele, counts as
    diploid reference; another allele alone, or with a missing one on either side, is haploid.
    """
    alleles = F.concat(F.array(F.col("ref")), F.coalesce("alts", F.array().cast("array<string>")))
    base = lambda a: X.base_code(F.try_element_at(alleles, a + 1))
    ref, a1, a2 = X.base_code(F.col("ref")), F.col("a1"), F.coalesce("a2", F.lit(-1))
    has_n = F.exists(alleles, lambda x: F.upper(x) == "N")
    first = F.when(a1 >= 0, a1).otherwise(a2)
    one = F.when(first == 0, S.EQS2).otherwise(X.code_from(ref, base(F.greatest(first, F.lit(0)))))
    code = F.when(has_n | (first < 0), S.NS).when((a1 < 0) | (a2 < 0), one).otherwise(X.code_from(ref, base(F.greatest(a1, F.lit(0))), base(F.greatest(a2, F.lit(0)))))
    return raw.select("chrom_ix", (F.col("pos") - 1).alias("pos"), F.coalesce(code, F.lit(S.NS)).cast("int").alias("code"))


def detect_density(raw: DataFrame, chunks: DataFrame, sample: int = 2048, dense: int = 128, sparse: int = 32) -> str | None:
    """"dense", "sparse" or None from the first records: long stretches of consecutive positions, or known bases without one.

    Of the reference chunks (chrom_ix, start, seq) only those that the first records lie in are looked into.
    """
    head = raw.where("chrom_ix >= 0").orderBy("ord").limit(sample).select("chrom_ix", "pos", "ord")
    w = Window.partitionBy("chrom_ix").orderBy("pos")
    one = head.select("chrom_ix", F.col("pos") - 1).toDF("chrom_ix", "pos").distinct()
    streak = one.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("chrom_ix", "g").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    # the head and its extent have `sample` rows at most
    span = F.broadcast(one.groupBy("chrom_ix").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    near = chunks.join(span, "chrom_ix").where((F.col("start") <= F.col("hi")) & (F.col("start") + F.length("seq") > F.col("lo")))
    base = near.select("chrom_ix", "lo", "hi", "start", F.posexplode(F.split("seq", "")).alias("i", "c")).where(X.base_code(F.col("c")).isNotNull())
    known = base.select("chrom_ix", "lo", "hi", (F.col("start") + F.col("i")).alias("pos")).where("pos between lo and hi")
    gaps = known.join(F.broadcast(one), ["chrom_ix", "pos"], "left_anti")
    before = gaps.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("chrom_ix", "g").agg(F.count("*").alias("n"), F.min("pos").alias("at")).where(F.col("n") >= sparse).agg(F.min(F.struct("chrom_ix", "at"))).first()[0]
    first = streak.where(F.col("n") >= dense).agg(F.min(F.struct("chrom_ix", "at"))).first()[0]
    if first and (not before or tuple(first) < tuple(before)):
        return "dense"
    return "sparse" if before else None


def cut_texts(texts: DataFrame, size: int = CHUNK, seq: str = "seq") -> DataFrame:
    """Rows with a text as rows of pieces of `size` letters: the other columns, start, seq."""
    keys = [c for c in texts.columns if c != seq]
    schema = texts.select(*keys).schema.add("start", "integer").add("seq", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f[[*keys, seq]].itertuples(index=False):
                for at in range(0, len(row[-1] or ""), size):
                    yield pd.DataFrame([(*row[:-1], at, row[-1][at : at + size])], columns=[*keys, "start", "seq"])

    return texts.mapInPandas(run, schema)


def diff(sample: DataFrame, reference: DataFrame, size: int = CHUNK) -> DataFrame:
    """Runs of a sample's text against the reference text, per chromosome: (sample_ix, chrom_ix, seq) and (chrom_ix, seq).

    White space and control characters are skipped. N and - are uncalled, Q and the reference's own base match it,
    two-base letters are heterozygous, any base is uncalled where the reference is N. The shorter text ends the run.
    """
    plain = lambda df: cut_texts(df.withColumn("seq", F.regexp_replace("seq", r"[\x00-\x20]", "")), size)
    return diff_chunks(plain(sample), plain(reference))


def diff_chunks(sample: DataFrame, reference: DataFrame) -> DataFrame:
    """diff() of texts that are already in chunks: (sample_ix, chrom_ix, start, seq) and (chrom_ix, start, seq)."""
    # texts are as large as the input, whatever their estimate says
    both = sample.withColumnRenamed("seq", "smp_seq").join(reference.select("chrom_ix", "start", F.col("seq").alias("ref_seq")).hint("merge"), ["chrom_ix", "start"])
    return normalize(coded(both.select("sample_ix", "chrom_ix", "start", "ref_seq", "smp_seq")))


_BAD = -9


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The run code of every (reference byte, sample byte); _BAD where a letter has no meaning."""
    out = np.full((256, 256), _BAD, np.int32)
    bases = {ord(c): i for i, b in enumerate(S.BASES) for c in (b, b.lower())}
    pairs = {ord(c): [S.BASES.index(x) for x in v] for k, v in S.IUPAC.items() for c in (k, k.lower())}
    for r in range(256):
        ref = bases.get(r)
        out[r, [ord(c) for c in "Nn-"]] = S.NS
        if ref is None:
            out[r] = S.NS
            continue
        for q, alleles in pairs.items():
            out[r, q] = S.code_of(ref, *alleles)
        out[r, [ord("Q"), ord("q")]] = S.EQS2
    return out


def coded(pairs: DataFrame) -> DataFrame:
    """Runs of (sample_ix, chrom_ix, start, ref_seq, smp_seq): texts side by side from position start on.

    A letter without meaning at a known reference base is an error. Each pair is looked up as a whole, so it gives a row
    for every run, not for every base; runs that go on in the next pair are left to normalize().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_codes()
        for b in batches:
            for sample, chrom, start, ref, smp in zip(*(b.column(i) for i in range(5)), strict=True):
                r, q = (np.frombuffer((x.as_py() or "").encode("latin-1", "replace"), np.uint8) for x in (ref, smp))
                n = min(len(r), len(q))
                code = table[r[:n], q[:n]]
                if (code == _BAD).any():
                    raise ValueError(f"unexpected letter {chr(q[int(np.argmax(code == _BAD))])}")
                new = np.ones(n, bool)
                new[1:] = (code[1:] != code[:-1]) | ~np.isin(code[1:], S.STRETCHES)
                at = np.flatnonzero(new)
                s = start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), sample.as_py(), np.int32)), pa.array(np.full(len(at), chrom.as_py(), np.int32)), pa.array((s + at).astype(np.int32)), pa.array((s + np.append(at[1:], n)[: len(at)]).astype(np.int32)), pa.array(code[at])], names=["sample_ix", "chrom_ix", "run_start", "run_end", "code"])

    return pairs.mapInArrow(run, S.RUNS)


def block_overlaps(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks (chrom_ix, start, len, ord) with what is wrong: replaced by a later one of the same start, or overlapping the last kept end."""
    others = [c for c in blocks.columns if c not in ("chrom_ix", "start", "ord")]
    last = blocks.groupBy("chrom_ix", "start").agg(F.max_by(F.struct(*others), "ord").alias("_x"), F.max("ord").alias("ord"))
    kept = last.select("chrom_ix", "start", "ord", *(F.col(f"_x.{c}").alias(c) for c in others)).select(blocks.columns)
    end = F.col("start") + F.col("len")
    binned_ = kept.withColumn("_bin", F.floor(F.col("start") / width))
    # a bin knows of the others how far those before reach and where the next one begins
    along = Window.partitionBy("chrom_ix").orderBy("_bin")
    bins = binned_.groupBy("chrom_ix", "_bin").agg(F.max(end).alias("reach"), F.min("start").alias("first"))
    known = bins.select("chrom_ix", "_bin", F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"), F.lead("first").over(along).alias("_next"))
    v = Window.partitionBy("chrom_ix", "_bin").orderBy("start")
    met = binned_.withColumn("_own", F.max(end).over(v.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.lead("start").over(v)).join(known, ["chrom_ix", "_bin"])
    before = F.greatest("_own", "_reach")  # nulls don't count
    out = met.withColumn("overlaps_before", F.coalesce(before > F.col("start"), F.lit(False))).withColumn("overlaps_after", F.coalesce(F.coalesce("_after", "_next") < end, F.lit(False)))
    return out.select(*blocks.columns, "overlaps_before", "overlaps_after")


def assemble(blocks: DataFrame, contigs: DataFrame, width: int = WIDTH, part: int | None = None) -> DataFrame:
    """Block extents on whole contigs: (chrom_ix, run_start, run_end, ord); a block that starts before the last kept end is skipped, gaps have a null ord.

    Which blocks are kept depends on those kept before; parts of a chromosome find out at the same time (operators/greedy.py).
    """
    kept = block_overlaps(blocks).select(F.col("chrom_ix").cast("int").alias("chrom_ix"), F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"), "ord")
    used = kept_blocks(kept, part).select("chrom_ix", F.col("s").cast("int").alias("run_start"), F.col("e").cast("int").alias("run_end"), "ord")
    kind = blocks.schema["ord"].dataType
    after = following(used.select("chrom_ix", F.col("run_start").alias("lo"), F.col("run_end").alias("hi")), ("chrom_ix",), width).join(contigs.select("chrom_ix", "length"), "chrom_ix")
    first = used.groupBy("chrom_ix").agg(F.min("run_start").alias("run_end")).select("chrom_ix", F.lit(0).alias("run_start"), "run_end")
    bare = contigs.join(used.select("chrom_ix").distinct(), "chrom_ix", "left_anti").select("chrom_ix", F.lit(0).alias("run_start"), F.col("length").alias("run_end"))
    gaps = after.select("chrom_ix", "run_start", F.coalesce("run_end", "length").alias("run_end")).unionByName(first).unionByName(bare).where("run_end > run_start").withColumn("ord", F.lit(None).cast(kind))
    return used.unionByName(gaps)


def listing(runs: DataFrame) -> DataFrame:
    """A readable listing of runs."""
    name = F.coalesce(*(F.when(F.col("code") == c, n) for c, n in S.NAMES.items()), F.lit("?"))
    return runs.select("sample_ix", "chrom_ix", "run_start", (F.col("run_end") - F.col("run_start")).alias("length"), name.alias("name"))
