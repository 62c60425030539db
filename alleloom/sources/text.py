"""Text inputs: contig tables, regions, individuals, FASTA and single-sample VCF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alleloom.sources.files import lines, split_lines


def _named(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """df (name, ...) with chrom_ix; -1 for names that the reference does not have."""
    return df.join(contigs.select("name", "chrom_ix"), "name", "left").withColumn("chrom_ix", F.coalesce("chrom_ix", F.lit(-1))).drop("name")


def read_bed(spark: SparkSession, paths: list[str], contigs: DataFrame) -> DataFrame:
    """(chrom_ix, s, e): the first three words of a line; unknown chromosomes and unreadable lines are dropped."""
    w = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    t = lines(spark, paths).select(F.get(w, 0).alias("name"), F.expr("try_cast(get(filter(split(line, '\\\\s+'), x -> x <> ''), 1) as int)").alias("s"), F.expr("try_cast(get(filter(split(line, '\\\\s+'), x -> x <> ''), 2) as int)").alias("e"))
    return _named(t.where("s is not null and e is not null"), contigs).where("chrom_ix >= 0").select("chrom_ix", "s", "e")


def read_individuals(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, pop): words 1 and 3; lines that start with # are comments."""
    w = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    return lines(spark, paths).where("not startswith(line, '#')").select(F.get(w, 0).alias("name"), F.get(w, 2).alias("pop")).where("pop is not null")


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rec, name, seq): what precedes the first header is ignored, a name ends at white space; order is kept by rec."""
    t = lines(spark, paths)
    w = Window.partitionBy("path").orderBy("ord")
    t = t.withColumn("rec", F.sum(F.startswith("line", F.lit(">")).cast("int")).over(w)).where("rec > 0")
    head = F.max(F.when(F.startswith("line", F.lit(">")), F.regexp_extract("line", r"^>\s*(\S*)", 1))).alias("name")
    body = F.array_sort(F.collect_list(F.when(~F.startswith("line", F.lit(">")), F.struct("ord", F.trim("line").alias("line")))))
    return t.groupBy("path", "rec").agg(head, F.array_join(F.transform(body, lambda x: x["line"]), "").alias("seq"))


def contigs_of(fasta: DataFrame) -> DataFrame:
    """(chrom_ix, name, length) of FASTA records, in their order."""
    w = Window.orderBy("rec")  # one row for each chromosome of a reference
    return fasta.select((F.row_number().over(w) - 1).cast("int").alias("chrom_ix"), "name", F.length("seq").alias("length"))


def chunks_of(fasta: DataFrame, contigs: DataFrame, size: int = 65536) -> DataFrame:
    """(chrom_ix, start, seq) reference chunks; letters other than T, C, A and G become N."""
    c = fasta.join(contigs.select("name", "chrom_ix"), "name").select("chrom_ix", F.regexp_replace(F.upper("seq"), "[^TCAG]", "N").alias("s"))
    i = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("s") - 1) / size), F.lit(0)))).alias("i")
    return c.select("chrom_ix", "s", i).select("chrom_ix", (F.col("i") * size).cast("int").alias("start"), F.expr(f"substring(s, cast(i * {size} + 1 as int), {size})").alias("seq"))


def import_hetfa(fasta: DataFrame, contigs: DataFrame, chunks: DataFrame, sample_ix: int = 0) -> DataFrame:
    """Runs of a sample given as FASTA with ambiguity letters. Unknown names are ignored, of a repeated name the last counts,
    chromosomes without a record stay uncalled; a file without any known name is an error."""
    from alleloom.operators.runs import cut_texts, diff_chunks

    last = fasta.groupBy("name").agg(F.max_by("seq", "rec").alias("seq")).join(contigs.select("name", "chrom_ix"), "name")
    if last.isEmpty():
        raise ValueError("no sequence of the reference's names was found")
    size = chunks.agg(F.max(F.length("seq"))).first()[0]  # chunks are of one size but for the last of a chromosome
    texts = last.select(F.lit(sample_ix).alias("sample_ix"), "chrom_ix", F.regexp_replace("seq", r"[\x00-\x20]", "").alias("seq"))
    return diff_chunks(cut_texts(texts, size), chunks)


def read_vcf(spark: SparkSession, paths: list[str], contigs: DataFrame, step: int | None = None) -> DataFrame:
    """(ord, chrom_ix, pos 1-based, ref, alts, a1, a2, phased) of single-sample VCF files, in the order of paths.

    The genotype is the first field of the sample column; -1 is a missing allele, a null a2 a haploid call. Files with
    another number of samples are an error. Plain files and those in blocks are read in parts of `step` compressed bytes.
    """
    t = split_lines(spark, paths, step)
    w = F.split("line", "\t")
    rows = t.where("not startswith(line, '#') and line <> ''").select("ord", w.alias("w"))
    one = F.when(F.size("w") != 10, F.raise_error(F.lit("exactly one sample is expected"))).otherwise(F.split(F.get("w", 9), ":")[0])
    g = rows.select("ord", F.get("w", 0).alias("name"), F.expr("try_cast(get(w, 1) as int)").alias("pos"), F.get("w", 3).alias("ref"), F.when(F.get("w", 4) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("w", 4), ",")).alias("alts"), F.coalesce(one.cast("string"), F.lit(".")).alias("gt"))
    return _named(_genotyped(g), contigs)


def _genotyped(g: DataFrame) -> DataFrame:
    number = lambda i: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(gt, '^([0-9.]+)(?:[/|]([0-9.]+))?', {i}), '') as int)"), F.lit(-1))
    two = F.col("gt").rlike(r"^[0-9.]+[/|]")
    return g.withColumn("a1", number(1)).withColumn("a2", F.when(two, number(2))).withColumn("phased", F.col("gt").contains("|")).drop("gt")


def import_vcf(raw: DataFrame, contigs: DataFrame, gap: str | DataFrame = "dense", sample_ix: int = 0, low: bool = False, inside_good: bool = True) -> DataFrame:
    """Runs of raw VCF or BCF records. gap: "dense" (uncalled), "sparse" (as the reference) or regions.

    inside_good: what lies in the regions is as the reference and the rest uncalled; else the other way round. A chromosome
    that reappears after another one is an error.
    """
    from alleloom import schema as S
    from alleloom.operators import runs as R

    calls = R.call_codes(R.dedup(R.contiguous(R.clean(raw)))).withColumn("sample_ix", F.lit(sample_ix)).select("sample_ix", "chrom_ix", "pos", "code")
    if isinstance(gap, str):
        filled = R.gap_fill(calls, contigs, {"dense": S.NS, "sparse": S.EQS2}[gap])
    else:
        filled = R.gap_fill_patches(calls, contigs, gap, *((S.EQS2, S.NS) if inside_good else (S.NS, S.EQS2)))
    return R.normalize(R.make_hap(filled) if low else filled)
