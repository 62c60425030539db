"""Every command on the worked example, against golden text."""

import gzip
import struct

import pytest

from alleloom import schema as S
from alleloom.cli import main

REF = "TCAGNNTCGATT"
TEXTS = ["TCAGNNCCGATT", "CCAGNNTCGANT", "TYAGNNTCGATG", "CCRGNNTCAAT-"]


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    """A folder with the reference and four imported samples."""
    d = tmp_path_factory.mktemp("cli")
    (d / "ref.fa").write_text(f">1 first\n{REF[:7]}\n{REF[7:]}\n")
    main(["fatotwobit", str(d / "ref.fa"), "-o", str(d / "ref.2bit")])
    for i, t in enumerate(TEXTS):
        (d / f"s.{i}.fa").write_text(f">1\n{t}\n>unknown\nTTT\n")
        main(["hetfa", str(d / f"s.{i}.fa"), "-r", str(d / "ref.2bit"), "-o", str(d / f"s.{i}.hef")])
    return d


@pytest.fixture(scope="module")
def files(at):
    return [str(at / f"s.{i}.hef") for i in range(4)]


def test_vcf(at, files):
    main(["vcfexport", "-n", "1", *files, "-o", str(at / "o.vcf")])
    head, *rows = (at / "o.vcf").read_text().splitlines()[2:]
    assert head == "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts.0\ts.1\ts.2\ts.3"
    dot = "\t.\t.\t.\tGT\t"
    assert rows == [f"1\t{p}\t.\t{r}\t{a}{dot}{g}" for p, r, a, g in ((1, "T", "C", "0/0\t1/1\t0/0\t1/1"), (2, "C", "T", "0/0\t0/0\t0/1\t0/0"), (3, "A", "G", "0/0\t0/0\t0/0\t0/1"), (9, "G", "A", "0/0\t0/0\t0/0\t1/1"), (12, "T", "G", "0/0\t0/0\t1/1\t./."))]
    main(["vcfexport", "-D", *files, "-o", str(at / "d.vcf")])
    dense = [x.split("\t") for x in (at / "d.vcf").read_text().splitlines()[3:]]
    assert [int(x[1]) for x in dense] == [1, 2, 3, 4, 7, 8, 9, 10, 11, 12] and [x[4] for x in dense if x[1] in ("4", "8", "10", "11")] == ["."] * 4
    (at / "r.bed").write_text("1 0 2\n1 8 9\n")
    main(["vcfexport", "-n", "1", "-R", str(at / "r.bed"), *files, "-o", str(at / "r.vcf")])
    assert [x.split("\t")[1] for x in (at / "r.vcf").read_text().splitlines()[3:]] == ["1", "2", "9"]
    main(["vcfexport", "-n", "1", "-t", *files, "-o", str(at / "parts") + "/"])
    parts = sorted(p for p in (at / "parts").glob("part-*") if not p.name.endswith(".crc"))
    assert "".join(p.read_text() for p in parts).splitlines() == [f"1\t12\t.\tT\tG{dot}0/0\t0/0\t1/1\t./."]


def test_eigenstrat_and_treemix(at, files):
    main(["eigenstrat", "-n", "1", *files, "-o", str(at / "e")])
    assert (at / "e.geno").read_text().split() == ["2020", "2212", "2221", "2220", "2209"]
    assert (at / "e.snp").read_text().splitlines()[0] == "10\t1\t0.0\t1\tT\tC"
    main(["treemix", "-n", "1", *files, "-o", str(at / "t.gz")])
    lines = gzip.decompress((at / "t.gz").read_bytes()).decode().splitlines()
    assert lines[:3] == ["s.0 s.1 s.2 s.3 ", "2,0 0,2 2,0 0,2 ", "2,0 2,0 1,1 2,0 "] and len(lines) == 6
    (at / "i.ind").write_text("s.0 F out\ns M rest\n")
    main(["treemix", "-n", "1", "-i", str(at / "i.ind"), "-a", *files, "-o", str(at / "p.gz")])
    assert gzip.decompress((at / "p.gz").read_bytes()).decode().splitlines()[:2] == ["out rest ", "2,0 2,4 "]


def test_statistics(at, files, capsys):
    main(["dstatistics", *files])
    assert capsys.readouterr().out == "D( s.1, s.2; s.3, s.0 ) = 1/1 = 100.00% ± NaN%, p = 0.0e0\n\n"
    main(["dstatistics", "-J", "4", *files, "-o", str(at / "d.txt")])
    assert (at / "d.txt").read_text().startswith("D( s.1, s.2; s.3, s.0 ) = 1/1 = 100.00% ± ")
    main(["f4statistics", *files])
    whole = capsys.readouterr().out
    assert whole.startswith("F4( s.1, s.2; s.3, s.0 ) = 1.25e-1, D = 1/1 = 100.00% ± ")
    (at / "all.bed").write_text("1 0 12\n")
    main(["f4statistics", "-R", str(at / "all.bed"), *files])
    assert capsys.readouterr().out == whole
    main(["kayvergence", "-n", "2", *files])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 10 and lines[0].split()[:4] == ["Kiv(", "reference;", "s.1;", "s.0"] and len({len(x) for x in lines[:9]}) == 1
    main(["yaddayadda", "-k", "1", "-l", "2", "-n", "1", *files])
    assert capsys.readouterr().err.endswith("Need at least 1 samples, got only 0.\nNothing to do.\n")
    main(["yaddayadda", *files, files[0]])
    assert capsys.readouterr().out.startswith("Y( s.0; s.2, s.3; s.0, s.1 ) = ")


def test_what_is_missing_is_named(files, capsys):
    main(["kayvergence", *files])
    assert capsys.readouterr().err.endswith("Need at least 2 good genomes, got only 1.\nNothing to do.\n")
    main(["dstatistics", "-n", "0", *files])
    assert "Need at least 1 outgroups, got only 0." in capsys.readouterr().err


def test_texts(at, files, capsys):
    main(["patch", files[2], "-w", "5"])
    assert capsys.readouterr().out == ">1\nTYAGN\nNTCGA\nTG\n"
    main(["twobitinfo", str(at / "ref.2bit")])
    assert capsys.readouterr().out == "1\t12\n"
    main(["twobittofa", str(at / "ref.2bit"), "1:2-4", "-w", "2"])
    assert capsys.readouterr().out == ">1\nCA\nG\n"
    main(["dumplump", files[0]])
    assert capsys.readouterr().out.splitlines() == ["0\t0\t0\t4\tEqs2", "0\t0\t4\t2\tNs", "0\t0\t6\t1\tTrans2", "0\t0\t7\t5\tEqs2"]
    main(["pseudo_ms", "-n", "1", "-l", "4", "-m", "20", *files])
    assert capsys.readouterr().out.split("\n//\n")[1].splitlines() == ["blockSize_4", "TCA", "TCA", "CCA", "CCA", "TCA", "TTA", "CCA", "CCG"]


def test_imports(spark, at, capsys):
    ref = ["-r", str(at / "ref.2bit")]
    (at / "a.vcf").write_text("#CHROM\tPOS\n" + "".join(f"1\t{p}\t.\t{r}\t{a}\t.\t.\t.\tGT\t{g}\n" for p, r, a, g in ((1, "T", "C", "1/1"), (3, "A", "G", "0/1"))))
    main(["vcfin", "-S", *ref, str(at / "a.vcf"), "-o", str(at / "a.hef")])
    main(["patch", str(at / "a.hef")])
    assert capsys.readouterr().out == ">1\nCCRGNNTCGATT\n"
    (at / "a.maf").write_text("a\ns hg.chr1 1 4 + 12 CAG-N\ns pt.7 0 5 + 9 TAGTT\n\n")
    main(["maf", "-R", "hg", "-S", "pt", *ref, str(at / "a.maf"), "-o", str(at / "m.hef")])
    main(["patch", str(at / "m.hef")])
    assert capsys.readouterr().out == ">1\nNTAGNNNNNNNN\n"
    bases = [("1", 0, "C", "+", 30, 60, 3), ("zz", 0, "C", "+", 30, 60, 3), ("1", 1, "C", "-", 30, 60, 3)]
    spark.createDataFrame(bases, "chrom string, pos int, base string, strand string, baseq int, mapq int, read_pos int").write.parquet(str(at / "bases.parquet"))
    main(["bamin", *ref, str(at / "bases.parquet"), "-o", str(at / "b.hef")])
    main(["patch", str(at / "b.hef")])
    said = capsys.readouterr()
    assert said.out == ">1\nCCNNNNNNNNNN\n" and "skipping zz" in said.err
    (at / "x.bam").write_bytes(gzip.compress(_bam([("1", 0), ("zz", 0)], [(0, 3, 20, 0, [(1, 0), (2, 3), (2, 0)], "GTC"), (1, 0, 20, 0, [(2, 0)], "AA"), (0, 0, 5, 0, [(2, 0)], "TT")])))
    main(["bamin", *ref, "--min-mapq", "10", str(at / "x.bam"), "-o", str(at / "x.hef")])
    main(["patch", str(at / "x.hef")])
    assert capsys.readouterr().out == ">1\nNNNGNNTCNNNN\n"


def _bam(refs, reads):
    """A BAM file of (reference, position, mapq, flag, CIGAR as (length, operation), bases)."""
    out = b"BAM\1" + struct.pack("<ii", 0, len(refs))
    for name, _ in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", 1000)
    for ref, pos, mapq, flag, cigar, bases in reads:
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in bases] + [0] * (len(bases) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, 2, mapq, 0, len(cigar), flag, len(bases), -1, -1, 0) + b"r\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(range(30, 30 + len(bases)))
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam(spark, tmp_path):
    """Soft clips, deletions, insertions, both strands and both ends; unmapped and secondary alignments are left out."""
    from alleloom.sources.bam import read_bases

    reads = [(0, 3, 20, 0, [(3, 4), (2, 0), (1, 2), (2, 7)], "NNNGCTC"), (0, 1, 9, 0x10, [(1, 0), (1, 1), (2, 0)], "CAGT"), (-1, -1, 0, 4, [], "AC"), (0, 8, 20, 0x100, [(1, 0)], "A")]
    (tmp_path / "a.bam").write_bytes(gzip.compress(_bam([("1", 0)], reads)))
    got = sorted(tuple(r) for r in read_bases(spark, [str(tmp_path / "a.bam")]).collect())
    assert got == sorted([
        ("1", 3, "G", "+", 33, 20, 3), ("1", 4, "C", "+", 34, 20, -3), ("1", 6, "T", "+", 35, 20, -2), ("1", 7, "C", "+", 36, 20, -1),
        ("1", 1, "C", "-", 30, 9, -1), ("1", 2, "G", "-", 32, 9, 1), ("1", 3, "T", "-", 33, 9, 0),
    ])


def test_a_wrong_reference_is_noticed(spark, at, files):
    (at / "other.fa").write_text(">1\nTTT\n")
    main(["fatotwobit", str(at / "other.fa"), "-o", str(at / "other.2bit")])
    with pytest.raises(ValueError, match="incompatible"):
        main(["patch", "-r", str(at / "other.2bit"), files[0]])
    from alleloom.sinks.text import write_runfile

    contigs = spark.createDataFrame([(0, "1", 12)], S.CONTIGS)
    write_runfile(spark.createDataFrame([(0, 0, 0, 12, S.EQS2)], S.RUNS), str(at / "lost.hef"), "nowhere.2bit", contigs)
    with pytest.raises(SystemExit, match="nowhere.2bit"):
        main(["patch", str(at / "lost.hef")])
