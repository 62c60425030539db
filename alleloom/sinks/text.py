"""Text and file sinks. Ordered single files come from a range-partitioned sort, whose tasks write parts of the file (committed.py)."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleloom.functions import scalars as X
from alleloom.operators.blocks import haplotype_lines, tumbling_blocks
from alleloom.sinks.committed import write_joined
from alleloom.sinks.wrap import wrapped
from alleloom.sources import runfile, twobit


def ordered_lines(lines: DataFrame, order: Sequence[str], path: str, header: str = "", compress: bool = False) -> None:
    """Writes column `line` of lines in order: to one file, whose parts tasks write (compressed: one gzip member each), to
    a folder of ordered part files (a path that ends in a slash; its header, if any, is the file _header), or to standard
    output (-), to which rows stream partition by partition."""
    if path != "-" and not path.endswith("/"):
        write_joined(lines.select(*order, F.encode(F.concat("line", F.lit("\n")), "utf-8").alias("data")), path, header.encode(), compress=compress)
        return
    rows = lines.orderBy(*order).select("line")
    if path.endswith("/"):
        rows.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)
        if header:
            lines.sparkSession.createDataFrame([(header.rstrip("\n"),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}_header")
        return
    sys.stdout.write(header)
    for r in rows.toLocalIterator(prefetchPartitions=True):
        sys.stdout.write(r["line"] + "\n")


def _per_call(calls: Column, one, sep: str) -> Column:
    return F.array_join(F.transform(calls, lambda c: one(c["n_ref"], c["n_alt"])), sep)


def vcf_lines(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """Lines of wide variants with ref."""
    v = variants.join(contigs.select("chrom_ix", "name"), "chrom_ix")
    line = F.concat_ws("\t", "name", (F.col("pos") + 1).cast("string"), F.lit("."), X.base_char(F.col("ref")), X.alt_char(F.col("ref"), F.col("alt")), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), _per_call(F.col("calls"), X.vcf_gt, "\t"))
    return v.select("chrom_ix", "pos", "alt", line.alias("line"))


def vcf_header(samples: Sequence[str]) -> str:
    return '##fileformat=VCFv4.1\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n' + "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples)) + "\n"


def eigenstrat_lines(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snp, geno) lines of wide variants with ref."""
    ab = X.alt_char(F.col("ref"), F.col("alt"))
    snp = F.concat_ws("\t", X.snp_name(F.col("chrom_ix"), F.col("pos"), ab), X.eigen_chrom(F.col("chrom_ix")).cast("string"), F.lit("0.0"), (F.col("pos") + 1).cast("string"), X.base_char(F.col("ref")), ab)
    return variants.select("chrom_ix", "pos", "alt", snp.alias("line")), variants.select("chrom_ix", "pos", "alt", _per_call(F.col("calls"), X.geno_char, "").alias("line"))


def treemix_lines(counted: DataFrame) -> DataFrame:
    """Lines of population_counts(): "ref,alt " for each population."""
    return counted.select("chrom_ix", "pos", "alt", F.array_join(F.transform("pops", lambda p: F.concat(p["n_ref"].cast("string"), F.lit(","), p["n_alt"].cast("string"), F.lit(" "))), "").alias("line"))


def treemix_header(populations: Sequence[str]) -> str:
    return "".join(f"{p} " for p in dict.fromkeys(populations)) + "\n"


def pseudo_ms_lines(variants: DataFrame, n_samples: int, size: int | None, min_informative: float = 90.0) -> DataFrame:
    """Block lines of wide variants with ref; without a size, one block a chromosome and no block heads."""
    b = tumbling_blocks(variants, size) if size else variants.withColumn("block", F.lit(0))
    h = haplotype_lines(b, n_samples, min_informative)
    head = [F.lit(""), F.lit("//"), F.lit(f"blockSize_{size}")] if size else []
    first = F.array(*head, F.when(F.col("enough"), F.col("line")).otherwise(F.lit("# Not enough of info in this block")))
    more = F.when(F.col("enough"), F.array("line")).otherwise(F.array().cast("array<string>"))
    each = h.select("chrom_ix", "block", "line_no", F.posexplode(F.when(F.col("line_no") == 0, first).otherwise(more)).alias("k", "line"))
    return each.select("chrom_ix", "block", F.when(F.col("line_no") == 0, F.col("k")).otherwise(len(head) + F.col("line_no")).alias("ord"), "line")


def fasta_lines(patched: DataFrame, contigs: DataFrame, width: int = 50) -> DataFrame:
    """(sample_ix, chrom_ix, ord, line) of patched texts."""
    return wrapped(patched.join(contigs.select("chrom_ix", "name"), "chrom_ix"), ["sample_ix", "chrom_ix"], width)


def write_runs(runs: DataFrame, path: str) -> None:
    """The primary store: runs as Parquet, partitioned by chromosome, sorted by sample and position."""
    runs.repartition("chrom_ix", "sample_ix").sortWithinPartitions("chrom_ix", "sample_ix", "run_start").write.mode("overwrite").partitionBy("chrom_ix").parquet(path)


def write_runfile(runs: DataFrame, path: str, reference_path: str, contigs: DataFrame) -> None:
    """One sample's runs as a run file; tasks write its chromosomes, and it is moved into place when complete."""
    c = contigs.orderBy("chrom_ix").collect()  # one row for each chromosome
    head = runfile.header(reference_path, runfile.token([r["name"] for r in c], [r["length"] for r in c]))
    data = runfile.encoded(runs).select("chrom_ix", "start", "data")
    every = contigs.select("chrom_ix").join(data, "chrom_ix", "left").select("chrom_ix", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("data", F.lit(b"\0")).alias("data"))
    write_joined(every, path, head)


def write_twobit(chunks: DataFrame, contigs: DataFrame, path: str) -> None:
    """A 2bit file; tasks write heads of records and coded chunks, the file's head is made of what they report."""
    names = [r["name"] for r in contigs.orderBy("chrom_ix").collect()]  # one for each chromosome
    write_joined(twobit.pieces(chunks, contigs), path, names=names)


def aligned(rows: Sequence[Sequence[tuple[bool, str]]]) -> str:
    """A text table of cells (whether to the right, text), padded to the widest of their column, without space between."""
    width = [max(len(r[i][1]) for r in rows) for i in range(len(rows[0]))] if rows else []
    return "".join("".join(c.rjust(w) if right else c.ljust(w) for (right, c), w in zip(r, width, strict=True)) + "\n" for r in rows)


#: How the label columns of a statistic are put into words.
FORMS = {
    "kayvergence": (("Kiv( ", "reference", "; "), ("", "sample", "; "), ("", "outgroup", "")),
    "dstatistics": (("D( ", "", ""), ("", "panel_a", ", "), ("", "panel_b", "; "), ("", "sample", ", "), ("", "outgroup", "")),
    "f4statistics": (("F4( ", "", ""), ("", "panel_a", ", "), ("", "panel_b", "; "), ("", "sample", ", "), ("", "outgroup", "")),
    "yaddayadda": (("Y( ", "", ""), ("", "ape", "; "), ("", "archaic_a", ", "), ("", "archaic_b", "; "), ("", "sample", ", "), ("", "african", "")),
}


def report_text(report: DataFrame, command: str) -> str:
    """A statistic's report (one row per combination) as aligned text: its labels, k/n = r and standard error in percent,
    and, but for kayvergence, p."""
    rows = []
    for r in report.collect():
        error = None if r["var"] is None else 100 * r["var"] ** 0.5
        cells = [(False, before + (r[name] if name else "") + after) for before, name, after in FORMS[command]] + [(False, " ) = ")]
        if command == "f4statistics":
            cells.append((True, X.scientific(r["f4"], 2) + ", D = "))
        cells += [(True, X.fixed(r["k"], 0) + "/"), (True, X.fixed(r["n"], 0) + " = "), (True, X.fixed(None if r["r"] is None else 100 * r["r"], 2) + "% ± ")]
        cells += [(True, X.fixed(error, 2) + "%")] if command == "kayvergence" else [(True, X.fixed(error, 2) + "%, p = "), (True, X.p_text(r["p"]))]
        rows.append(cells)
    return aligned(rows)
