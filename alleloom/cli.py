"""The command line: every command by its name or a unique prefix of it, in any case."""

from __future__ import annotations

import argparse
import sys
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom import ship
from alleloom.functions import scalars as X
from alleloom.functions.scalars import label_of, size_of
from alleloom.operators import filters as Q
from alleloom.operators import merge as M
from alleloom.operators import pileup as U
from alleloom.operators import runs as R
from alleloom.operators import stats as A
from alleloom.sinks import text as T
from alleloom.sources import alignments, bam, bcf, runfile, twobit
from alleloom.sources import text as read

CHUNK = 65536
COMMANDS = ("hetfa", "maf", "emf", "bcfin", "vcfin", "bamin", "patch", "treemix", "eigenstrat", "vcfexport", "pseudo_ms", "kayvergence", "dstatistics", "f4statistics", "yaddayadda", "twobitinfo", "twobittofa", "fatotwobit", "dumplump", "dumppatch")
#: Commands whose files are run files.
MERGED = ("patch", "treemix", "eigenstrat", "vcfexport", "pseudo_ms", "kayvergence", "dstatistics", "f4statistics", "yaddayadda", "dumplump", "dumppatch")


def command_of(name: str) -> str:
    found = [c for c in COMMANDS if c.startswith(name.lower())]
    if name.lower() in COMMANDS:
        return name.lower()
    if len(found) != 1:
        raise SystemExit(f"{'unknown' if not found else 'ambiguous'} command {name}; commands: {', '.join(COMMANDS)}")
    return found[0]


#: Numbers of genomes that each statistic takes from the front of its files, by option, and their defaults.
COUNTED = {
    "kayvergence": (("-n", "--numgood", "good", 1),),
    "dstatistics": (("-n", "--numoutgroups", "nout", 1), ("-k", "--numrefpanel", "panel", 2)),
    "f4statistics": (("-n", "--numoutgroups", "nout", 1), ("-k", "--numrefpanel", "panel", 2)),
    "yaddayadda": (("-n", "--numoutgroups", "nout", 1), ("-k", "--numafricans", "africans", 1), ("-l", "--numneandertals", "panel", 2)),
}


def parser(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"alleloom {command}")
    p.add_argument("files", nargs="*", help="input files; - is standard input")
    p.add_argument("-o", "--output", default="-", help="output file; a folder of parts if it ends in a slash")
    p.add_argument("-r", "--reference", help="reference (2bit); else the first one that an input names and that exists")
    p.add_argument("--no-check", action="store_true", help="take files that were written against another reference")
    if command in ("vcfin", "bcfin"):
        p.add_argument("-D", "--dense", action="store_const", const="dense", dest="gap")
        p.add_argument("-S", "--sparse", action="store_const", const="sparse", dest="gap")
        p.add_argument("-p", "--good-patches")
        p.add_argument("-P", "--poor-patches")
        p.add_argument("-L", "--low", action="store_true")
    elif command in ("maf", "emf"):
        p.add_argument("-R", "--ref-species", default="homo,sapiens")
        p.add_argument("-S", "--sample-species")
        p.add_argument("-A", "--ancestor-of", default="pan,troglodytes")
    elif command == "bamin":
        for names, what in ((("-q", "--min-qual"), "discard bases below this quality"), (("-m", "--min-mapq"), "discard reads below this mapping quality"), (("--snip",), "ignore so many bases at a read's beginning"), (("--snap",), "ignore so many bases at a read's end")):
            p.add_argument(*names, type=int, default=0, help=what)
        p.add_argument("--deaminate", action="store_true")
        p.add_argument("--pick", choices=U.SCHEMES, default="ostrich")
        for scheme in U.SCHEMES[1:]:  # of several, the last one counts
            p.add_argument(f"--{scheme.replace('_', '-')}", action="store_const", const=scheme, dest="pick", help=f"the same as --pick {scheme}")
        p.add_argument("--seed", type=int, default=0)
    elif command in COUNTED:
        for short, long, dest, default in COUNTED[command]:
            p.add_argument(short, long, dest=dest, type=int, default=default)
        p.add_argument("-J", "--blocksize", type=size_of, default=A.BLOCK)
        p.add_argument("-t", "--transversions", action="store_true")
        if command != "yaddayadda":
            p.add_argument("--ignore-cpg", action="store_true")
        p.add_argument("-R", "--regions")
    elif command in ("patch", "twobittofa"):
        p.add_argument("-w", "--width", type=int, default=50)
    elif command in ("treemix", "eigenstrat", "vcfexport", "pseudo_ms"):
        p.add_argument("-n", "--numoutgroups", dest="nout", type=int, default=0)
        p.add_argument("-R", "--regions")
        if command == "treemix":
            p.add_argument("-t", "--transversions", action="store_true")
            p.add_argument("-i", "--individuals")
            p.add_argument("-c", "--chromosomes")
            for short, long, pattern in (("-a", "--autosomes", Q.AUTOSOMES), ("-x", "--x-chromosome", Q.X_CHROMOSOME), ("-y", "--y-chromosome", Q.Y_CHROMOSOME)):
                p.add_argument(short, long, action="store_const", const=pattern, dest="chromosomes")
        else:
            p.add_argument("-t", "--only-transversions", action="store_true", dest="transversions")
            p.add_argument("-b", "--only-biallelic", action="store_true")
        if command in ("vcfexport", "pseudo_ms"):
            p.add_argument("-D", "--dense", action="store_true")
        if command == "pseudo_ms":
            p.add_argument("-l", "--blocklength", type=size_of)
            p.add_argument("-m", "--min-informative", type=float, default=90.0)
    return p


def _emit(text: str, path: str) -> None:
    if path == "-":
        sys.stdout.write(text)
    else:
        with open(path, "w") as f:
            f.write(text)


class Job:
    """A command's inputs, read on demand."""

    def __init__(self, spark: SparkSession, command: str, args: argparse.Namespace):
        self.spark, self.command, self.a = spark, command, args

    @cached_property
    def reference(self) -> tuple[str, DataFrame, DataFrame] | None:
        """(path, contigs, chunks) of the reference asked for, or of the first that a run file names and that exists."""
        named = [self.a.reference] if self.a.reference else []
        if not named and self.command in MERGED:
            named = list(dict.fromkeys(path for _, path, _ in runfile.headers(self.spark, self.a.files) if path))
        self.looked = ", ".join(named)
        for path in named:
            try:
                self.spark.read.format("binaryFile").load(path).select("path").first()
            except AnalysisException:
                if self.a.reference:
                    raise
                continue
            return (path, *twobit.read(self.spark, path, CHUNK))
        return None

    def _needed(self) -> tuple[str, DataFrame, DataFrame]:
        if self.reference is None:
            raise SystemExit(f"No reference found. Looked for it at {self.looked}." if self.looked else "No reference found; name one with -r.")
        return self.reference

    @property
    def contigs(self) -> DataFrame:
        return self._needed()[1]

    @property
    def chunks(self) -> DataFrame:
        return self._needed()[2]

    def runs(self) -> DataFrame:
        known = self.reference[1:] if self.reference else None
        return runfile.read_runs(self.spark, self.a.files, known, check=not self.a.no_check).where("run_end > run_start")

    def variants(self, nout: int, dense: bool = False) -> DataFrame:
        n = len(self.a.files)
        return M.merge_dense(self.runs(), n) if dense else M.merge_sparse(self.runs(), n, nout)

    def filtered(self, v: DataFrame) -> DataFrame:
        """In the fixed order: biallelic sites, chromosomes, regions, transversions, CpG sites."""
        wants = lambda name: getattr(self.a, name, None)
        if wants("only_biallelic"):
            v = Q.biallelic(v)
        if wants("chromosomes"):
            v = Q.select_chroms(v, self.contigs, self.a.chromosomes)
        if wants("regions"):
            v = Q.restrict_to_regions(v, read.read_bed(self.spark, [self.a.regions], self.contigs))
        if wants("transversions"):
            v = Q.transversions(v)
        if wants("ignore_cpg"):
            v = Q.drop_cpg(v, self.chunks, CHUNK)
        return v

    def statistic(self) -> None:
        a, n, labels = self.a, len(self.a.files), self.labels()
        match self.command:
            case "kayvergence":
                have = ((2, a.good, "good genomes"), (3, n, "genomes"))
                combos, patterns, nout = A.kay_combos(a.good, labels), A.KAY, 0
            case "yaddayadda":
                have = ((1, a.nout, "apes"), (1, a.africans, "africans"), (2, a.panel, "neanderthals"), (1, n - a.nout - a.africans - a.panel, "samples"))
                combos, patterns, nout = A.yadda_combos(a.nout, a.africans, a.panel, labels), A.YADDA, a.nout + a.africans
            case _:
                have = ((1, a.nout, "outgroups"), (2, a.panel, "members in reference panel"), (1, n - a.nout - a.panel, "samples"))
                combos, patterns, nout = A.patterson_combos(a.nout, a.panel, labels), A.PATTERSON, a.nout
        for want, got, what in have:
            if got < want:
                print(f"Need at least {want} {what}, got only {got}.\nNothing to do.", file=sys.stderr)
                return
        index = [c for c, _ in combos]
        if self.command == "f4statistics":
            regions = [read.read_bed(self.spark, [a.regions], self.contigs)] if a.regions else []
            pairs = [Q.cpg_sites(self.chunks, CHUNK)] if a.ignore_cpg else []
            only = X.is_transversion(F.col("alt")) if a.transversions else None
            blocks = A.dense_blocks(None, self.runs(), n, index, patterns, a.blocksize, M.WIDTH, grid=False, within=regions, without=pairs, sites=only)
        else:
            blocks = A.block_sums(self.filtered(self.variants(nout)), index, patterns, a.blocksize)
        _emit(T.report_text(A.report(self.spark, blocks, combos, A.NAMES[self.command]), self.command) + "\n", a.output)

    def labels(self) -> list[str]:
        return [label_of(f) for f in self.a.files]

    def save(self, runs: DataFrame) -> None:
        """As a run file, or (a path that ends in .parquet) as the table that merges read best."""
        if self.a.output.endswith(".parquet"):
            T.write_runs(runs, self.a.output)
        else:
            T.write_runfile(runs, self.a.output, self._needed()[0], self.contigs)

    def run(self) -> None:
        a, spark, n, labels = self.a, self.spark, len(self.a.files), self.labels()
        match self.command:
            case "hetfa":
                self.save(read.import_hetfa(read.read_fasta(spark, a.files), self.contigs, self.chunks))
            case "vcfin" | "bcfin":
                raw = read.read_vcf(spark, a.files, self.contigs) if self.command == "vcfin" else bcf.read_bcf(spark, a.files, self.contigs)
                patches = a.good_patches or a.poor_patches
                gap = read.read_bed(spark, [patches], self.contigs) if patches else a.gap or R.detect_density(raw, self.chunks)
                if gap is None:
                    raise SystemExit("can't tell dense from sparse input; use -D or -S")
                self.save(read.import_vcf(raw, self.contigs, gap, low=a.low, inside_good=bool(a.good_patches)))
            case "maf" | "emf":
                two = lambda s: tuple((s.lower().split(",") + [""])[:2])
                if self.command == "maf":
                    blocks = alignments.maf_blocks(alignments.read_maf(spark, a.files), a.ref_species, a.sample_species, self.contigs)
                else:
                    files = a.files[0] if n == 1 else a.files
                    blocks = alignments.read_emf(spark, files, two(a.ref_species), two(a.sample_species) if a.sample_species else None, two(a.ancestor_of), self.contigs)
                runs, warned = alignments.import_blocks(blocks, self.contigs)
                for w in warned.where("overlaps_before or overlaps_after").orderBy("chrom_ix", "start").toLocalIterator():
                    print(f"overlap at {w['chrom_ix']}:{w['start']}", file=sys.stderr)
                self.save(runs)
            case "bamin":
                tables = all(f.rstrip("/").endswith(".parquet") for f in a.files)
                bases = U.known_contigs(spark.read.parquet(*a.files) if tables else bam.read_bases(spark, a.files), self.contigs)
                for name in bases.skipped:
                    print(f"skipping {name}, which the reference doesn't have", file=sys.stderr)
                piles = U.deaminate(U.collate(bases.reads, a.min_mapq, a.min_qual, a.snip, a.snap))
                if not a.deaminate:
                    piles = piles.withColumns({"c": F.col("c") + F.col("u"), "gr": F.col("gr") + F.col("ur"), "u": F.lit(0), "ur": F.lit(0)})
                picked = U.sample_base(U.pick_weights(M.add_ref(piles, self.chunks, CHUNK), a.pick), a.seed)
                self.save(R.normalize(R.gap_fill(U.to_points(picked), self.contigs, S.NS)))
            case "patch":
                lines = T.fasta_lines(M.patch(self.runs(), self.chunks, CHUNK), self.contigs, a.width)
                T.ordered_lines(lines, ["sample_ix", "chrom_ix", "ord"], a.output)
            case "treemix":
                pops = labels
                if a.individuals:
                    who = spark.createDataFrame(list(enumerate(labels)), "sample_ix int, label string")
                    pops = [r["pop"] for r in Q.assign_populations(who, read.read_individuals(spark, [a.individuals])).orderBy("sample_ix").collect()]
                v = Q.informative(self.filtered(self.variants(a.nout)), a.nout)
                T.ordered_lines(T.treemix_lines(Q.population_counts(v, pops)), ["chrom_ix", "pos", "alt"], a.output, T.treemix_header(pops), compress=True)
            case "eigenstrat":
                v = Q.informative(self.filtered(M.add_ref(self.variants(a.nout), self.chunks, CHUNK)), a.nout)
                for lines, end in zip(T.eigenstrat_lines(v), (".snp", ".geno"), strict=True):
                    T.ordered_lines(lines, ["chrom_ix", "pos", "alt"], a.output + end)
            case "vcfexport":
                v = M.merge_ref(self.runs(), M.bases_of(self.chunks), n) if a.dense else M.add_ref(self.variants(a.nout), self.chunks, CHUNK)
                T.ordered_lines(T.vcf_lines(self.filtered(v), self.contigs), ["chrom_ix", "pos", "alt"], a.output, T.vcf_header(labels))
            case "pseudo_ms":
                v = self.filtered(M.add_ref(self.variants(a.nout, a.dense), self.chunks, CHUNK))
                T.ordered_lines(T.pseudo_ms_lines(v, n, a.blocklength, a.min_informative), ["chrom_ix", "block", "ord"], a.output)
            case "kayvergence" | "dstatistics" | "f4statistics" | "yaddayadda":
                self.statistic()
            case "twobitinfo":
                c, _ = twobit.read(spark, a.files[0])
                _emit("".join(f"{r['name']}\t{r['length']}\n" for r in c.orderBy("chrom_ix").collect()), a.output)
            case "twobittofa":
                for region in a.files[1:] or [None]:
                    c, ch = twobit.read(spark, a.files[0], CHUNK, region)
                    T.ordered_lines(twobit.fasta_lines(ch, c, region, a.width), ["chrom_ix", "ord"], a.output)
            case "fatotwobit":
                fa = read.read_fasta(spark, a.files)
                c = read.contigs_of(fa)
                T.write_twobit(read.chunks_of(fa, c), c, a.output)
            case "dumplump" | "dumppatch":
                l = R.listing(self.runs())
                lines = l.withColumn("line", F.concat_ws("\t", *(F.col(x).cast("string") for x in l.columns)))
                T.ordered_lines(lines, ["sample_ix", "chrom_ix", "run_start", "length"], a.output)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] in ("-h", "--help"):
        print("commands: " + ", ".join(COMMANDS))
        return
    if argv[0] == "--version":
        print("alleloom 1")
        return
    command = command_of(argv[0])
    args = parser(command).parse_args(argv[1:])
    spark = SparkSession.builder.appName(f"alleloom {command}").getOrCreate()
    ship(spark)
    Job(spark, command, args).run()


if __name__ == "__main__":
    main()
