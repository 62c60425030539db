"""Tiles, wrapped lines, standard input, options of BAM import, deamination."""

import gzip
import io
import random
import struct
import types

import pytest
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.cli import main, parser
from alleloom.operators import blocks as B
from alleloom.operators import pileup as U
from alleloom.sinks.text import pseudo_ms_lines
from alleloom.sinks.wrap import wrapped
from alleloom.sources import files, twobit


@pytest.mark.parametrize("size", [1, 7, 50, 64])
def test_wrapping(spark, size):
    """Chunks of any size, smaller than a line or ending with one, empty texts, and starts that don't begin at nothing."""
    rng = random.Random(size)
    texts = {("a", k): "".join(rng.choice("TCAGN") for _ in range(n)) for k, n in enumerate((0, 1, 49, 50, 51, 500, 333))}
    rows = [(*key, f"n{key[1]}", 1000 + i, t[i : i + size]) for key, t in texts.items() for i in range(0, max(len(t), 1), size)]
    df = spark.createDataFrame(rows, "g string, k int, name string, start int, seq string").repartition(5)
    got = {}
    for r in wrapped(df, ["g", "k"], 50).orderBy("g", "k", "ord").collect():
        got.setdefault((r["g"], r["k"]), []).append((r["ord"], r["line"]))
    assert got == {key: [(0, f">n{key[1]}")] + [(i // 50 + 1, t[i : i + 50]) for i in range(0, len(t), 50)] for key, t in texts.items()}
    assert wrapped(df.limit(0), ["g", "k"], 50).count() == 0


@pytest.mark.parametrize("tile", [1, 13, 65536])
def test_haplotypes_by_tiles(spark, tile):
    rng, n = random.Random(5), 4
    rows = [(c, p, a, rng.choice([None, 0, 1, 2, 3]), [(rng.randrange(2), rng.randrange(2)) for _ in range(n)]) for c in (0, 1) for p in sorted(rng.sample(range(300), 80)) for a in rng.sample((1, 2, 3), rng.choice((1, 1, 2)))]
    v = spark.createDataFrame(rows, "chrom_ix int, pos int, alt int, ref int, calls array<struct<n_ref:int,n_alt:int>>").repartition(3)
    want, known = {}, {}
    for c, p, a, ref, calls in sorted(rows, key=lambda r: r[:3]):
        letters = "N" if ref is None else S.BASES[ref], "N" if ref is None else S.BASES[ref ^ a]
        for i, (r, x) in enumerate(calls):
            pair = ("N", "N") if not r and not x else (letters[1] if not r else letters[0], letters[0] if not x else letters[1])
            for h in (0, 1):
                want.setdefault((c, p // 100), [""] * 2 * n)[2 * i + h] += pair[h]
        known.setdefault((c, p // 100), []).append(ref is not None and all(r or x for r, x in calls))
    got = {}
    for r in B.haplotype_lines(B.tumbling_blocks(v, 100), n, 25.0, tile).orderBy("line_no").collect():
        got.setdefault((r["chrom_ix"], r["block"]), []).append((r["enough"], r["line"]))
    assert got == {k: [(100 * sum(known[k]) >= 25 * len(known[k]), x) for x in lines] for k, lines in want.items()}
    out = [r["line"] for r in pseudo_ms_lines(v, n, 100, 25.0).orderBy("chrom_ix", "block", "ord").collect()]
    plain = []
    for k in sorted(want):
        plain += ["", "//", "blockSize_100"] + (want[k] if got[k][0][0] else ["# Not enough of info in this block"])
    assert out == plain
    whole = [r["line"] for r in pseudo_ms_lines(v, n, None, 0.0).orderBy("chrom_ix", "block", "ord").collect()]
    assert whole == ["".join(want[k][i] for k in sorted(want) if k[0] == c) for c in (0, 1) for i in range(2 * n)]


def test_standard_input(spark, tmp_path, capsys, monkeypatch):
    """- is standard input, compressed or not; its head and its body are looked at, and it can be read once."""
    (tmp_path / "r.2bit").write_bytes(twobit.write(["1"], [twobit.pack("TCAGTCAG")]))
    (tmp_path / "s.fa").write_text(">1\nTCYGTCAN\n")
    main(["hetfa", str(tmp_path / "s.fa"), "-r", str(tmp_path / "r.2bit"), "-o", str(tmp_path / "s.hef")])
    for data in ((tmp_path / "s.hef").read_bytes(), gzip.compress((tmp_path / "s.hef").read_bytes())):
        monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(data)))
        files.stdin.cache_clear()
        main(["patch", "-"])
        assert capsys.readouterr().out == ">1\nTCYGTCAN\n"
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(b"#x\n1\t2\t.\tC\tT\t.\t.\t.\tGT\t1/1\n")))
    files.stdin.cache_clear()
    main(["vcfin", "-S", "-r", str(tmp_path / "r.2bit"), "-", "-o", str(tmp_path / "v.hef")])
    main(["patch", str(tmp_path / "v.hef")])
    assert capsys.readouterr().out == ">1\nTTAGTCAG\n"
    files.stdin.cache_clear()


def test_options_of_bam_import():
    of = lambda *o: parser("bamin").parse_args([*o, "x.bam"])
    a = of("-q", "20", "-m", "30", "--snip", "2", "--snap", "3", "--udg")
    assert (a.min_qual, a.min_mapq, a.snip, a.snap, a.pick, a.deaminate) == (20, 30, 2, 3, "udg", False)
    for scheme in U.SCHEMES[1:]:
        assert of(f"--{scheme.replace('_', '-')}").pick == scheme
    assert of().pick == "ostrich" and of("--udg", "--ignore-t").pick == "ignore_t" and of("--min-qual", "7").min_qual == 7


def test_bam_import_options(spark, tmp_path, capsys):
    """Qualities and schemes by their short names, on reads of both strands."""
    (tmp_path / "r.2bit").write_bytes(twobit.write(["1"], [twobit.pack("TCAG" * 3)]))

    def read(pos, mapq, flag, bases, quality):
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in bases] + [0] * (len(bases) % 2)
        body = struct.pack("<iiBBHHHiiii", 0, pos, 2, mapq, 0, 1, flag, len(bases), -1, -1, 0) + b"r\0" + struct.pack("<I", len(bases) << 4)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(quality)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<iiii", 0, 1, 2, 0)[:8] + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 12)
    reads = read(0, 30, 0, "TTTT", [30] * 4) + read(0, 5, 0, "GGGG", [30] * 4) + read(6, 30, 16, "AA", [30, 3])
    (tmp_path / "a.bam").write_bytes(gzip.compress(head + reads))

    def imported(*options):
        main(["bamin", "-r", str(tmp_path / "r.2bit"), *options, str(tmp_path / "a.bam"), "-o", str(tmp_path / "a.hef")])
        main(["patch", str(tmp_path / "a.hef")])
        return capsys.readouterr().out.split()[1]

    assert imported("-m", "20") == "TTTTNNAANNNN" and imported("-m", "20", "-q", "10") == "TTTTNNANNNNN"
    assert imported("-m", "20", "--ignore-t") == "NNNNNNNNNNNN"  # forward T and reverse A are left out
    assert imported("-m", "20", "--snip", "1", "--snap", "1") == "NTTNNNNNNNNN"


def test_deaminate(spark):
    """One in fifty of forward C and reverse G moves, the rest at random; nothing is lost, and other bases stay."""
    piles = spark.range(4000).select(F.lit(0).alias("chrom_ix"), F.col("id").cast("int").alias("pos"), *(F.lit(n).alias(c) for c, n in zip(U.COUNTS, (3, 100, 4, 5, 6, 7, 75, 8), strict=True)))
    rows = U.deaminate(piles, seed=3).collect()
    assert {(r["a"], r["g"], r["t"], r["ar"], r["cr"], r["tr"]) for r in rows} == {(3, 4, 5, 6, 7, 8)}
    assert {(r["c"], r["u"]) for r in rows} == {(98, 2)} and {(r["gr"], r["ur"]) for r in rows} == {(74, 1), (73, 2)}
    share = sum(r["ur"] for r in rows) / 4000
    assert 1.45 < share < 1.55 and rows == U.deaminate(piles.repartition(7), seed=3).orderBy("pos").collect()
    assert sum(r["ur"] for r in U.deaminate(piles, seed=4).collect()) != 4000 * share
    few = U.deaminate(piles.withColumns({"c": F.lit(1), "gr": F.lit(0)}), seed=1).agg(F.avg("u"), F.sum("ur"), F.min(F.col("c") + F.col("u"))).first()
    assert 0.01 < few[0] < 0.03 and few[1] == 0 and few[2] == 1
