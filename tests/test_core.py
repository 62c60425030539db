"""The worked example, the formats, and properties of runs and merges."""

import gzip
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.functions.beta import incomplete_beta, p_value
from alleloom.functions import scalars as X
from alleloom.operators import filters as Q
from alleloom.operators import merge as M
from alleloom.operators import runs as R
from alleloom.operators import stats as A
from alleloom.sources import alignments, runfile, twobit
from alleloom.sources.files import decompressed

REF = "TCAGNNTCGATT"
TEXTS = ["TCAGNNCCGATT", "CCAGNNTCGANT", "TYAGNNTCGATG", "CCRGNNTCAAT-"]
BYTES = ["c4 42 06 c5 00", "06 c3 42 c4 41 c1 00", "c1 05 c2 42 c5 0d 00", "06 c1 05 c1 42 c2 06 c2 41 00"]


@pytest.fixture(scope="module")
def runs(spark):
    s = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "sample_ix int, chrom_ix int, seq string")
    r = spark.createDataFrame([(0, REF)], "chrom_ix int, seq string")
    return R.diff(s, r).cache()


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(0, 0, REF[:8]), (0, 8, REF[8:])], S.CHUNKS)


def test_example_bytes(runs):
    got = {r["sample_ix"]: bytes(r["data"]).hex(" ") for r in runfile.encoded(runs).collect()}
    assert [got[i] for i in range(4)] == BYTES


def test_example_merge(runs, chunks):
    v = M.add_ref(M.merge_sparse(runs, 4, 1), chunks, 8)
    rows = v.orderBy("pos").select("pos", X.base_char(F.col("ref")), X.alt_char(F.col("ref"), F.col("alt")), F.array_join(F.transform("calls", lambda c: X.geno_char(c["n_ref"], c["n_alt"])), ""), F.array_join(F.transform("calls", lambda c: X.vcf_gt(c["n_ref"], c["n_alt"])), " ")).collect()
    assert [tuple(r) for r in rows] == [
        (0, "T", "C", "2020", "0/0 1/1 0/0 1/1"), (1, "C", "T", "2212", "0/0 0/0 0/1 0/0"), (2, "A", "G", "2221", "0/0 0/0 0/0 0/1"),
        (8, "G", "A", "2220", "0/0 0/0 0/0 1/1"), (11, "T", "G", "2209", "0/0 0/0 1/1 ./."),
    ]
    assert Q.informative(v, 1).count() == 5
    assert [r["pos"] for r in Q.transversions(v).collect()] == [11]
    assert {r["pos"] for r in Q.drop_cpg(v, chunks, 8).collect()} == {0, 1, 2, 11}
    assert sorted((r["block"], r["pos"]) for r in A.greedy_blocks(v, 4).collect()) == [(0, 0), (0, 1), (0, 2), (8, 8), (8, 11)]


def test_example_dense_and_ref(runs, chunks):
    dense = {(r["pos"], r["alt"]) for r in M.merge_dense(runs, 4).collect()}
    assert sorted({p for p, _ in dense}) == [0, 1, 2, 3, 6, 7, 8, 9, 10, 11]
    assert {p for p, a in dense if a == S.PSEUDO} == {3, 7, 9, 10}
    ref = M.merge_ref(runs, M.bases_of(chunks), 4).collect()
    assert sorted({r["pos"] for r in ref}) == [0, 1, 2, 3, 6, 7, 8, 9, 10, 11]


def test_example_statistics(runs):
    combos = A.patterson_combos(1, 2, ["s0", "s1", "s2", "s3"])
    index = [c for c, _ in combos]
    one = A.totals(A.block_sums(M.merge_sparse(runs, 4, 1), index, A.PATTERSON, 4)).first()
    assert (one["k"], one["n"], one["t"]) == (1, 1, 4)
    dense = A.totals(A.dense_blocks(M.merge_sparse(runs, 4, 0), runs, 4, index, A.PATTERSON, 1000, 64)).first()
    assert dense["t"] == 8 and (2 * dense["k"] - dense["n"]) / dense["t"] == 0.125
    slow = A.totals(A.block_sums(M.merge_dense(runs, 4), index, A.PATTERSON, 1000, grid=True)).first()
    assert (slow["k"], slow["n"], slow["t"]) == (dense["k"], dense["n"], dense["t"])


def _random_runs(seed, samples, length=400):
    """Runs of random codes and lengths over two chromosomes, with gaps."""
    rng, rows = random.Random(seed), []
    for i in range(samples):
        for c in (0, 1):
            at = rng.randrange(30)
            while at < length:
                code = rng.choice([S.NS, S.EQS1, S.EQS2, S.EQS2, S.EQS2, S.TRANS2, S.REFCOMPL, S.TCOMPL1, S.TRANSCOMPL])
                n = rng.randrange(1, 60) if code in S.STRETCHES else 1
                rows.append((i, c, at, min(at + n, length), code))
                at += n + (rng.randrange(40) if rng.random() < 0.1 else 0)
    return rows


def test_statistics_against_brute_force(spark):
    """More samples than one packed number holds; every combination of a small panel, by position and in blocks of both kinds."""
    n, size = 17, 90
    rows = _random_runs(4, n)
    runs = spark.createDataFrame(rows, S.RUNS).repartition(3).cache()
    at = {(i, c, p): code for i, c, s, e, code in rows for p in range(s, e)}
    sites = {(c, p) for (_, c, p), code in at.items() if code != S.NS}
    dense, sparse = [], []
    for c, p in sorted(sites):
        alts = [a for a in (1, 2, 3) if any(S.counts(at.get((i, c, p), 0), a)[1] for i in range(n))]
        for a in alts or [S.PSEUDO]:
            calls = [S.counts(at.get((i, c, p), 0), 1 if a == S.PSEUDO else a) for i in range(n)]
            dense.append((c, p, a, [x if a != S.PSEUDO else (x[0], 0) for x in calls]))
            if a != S.PSEUDO:
                sparse.append(dense[-1])
    rows_of = lambda df: sorted((r["chrom_ix"], r["pos"], r["alt"], [tuple(c) for c in r["calls"]]) for r in df.collect())
    assert rows_of(M.merge_sparse(runs, n, 0, 64)) == sorted(sparse) and rows_of(M.merge_dense(runs, n, 64)) == sorted(dense)

    def blocks_of(records, grid):
        out, start = {}, {}
        for c, p, _, calls in records:
            if c not in start or p >= start[c] + size:
                start[c] = p
            key = (c, p // size if grid else start[c])
            for k, (x, o, g, h) in enumerate(combos):
                (u1, v1), (u2, v2), (u3, v3), (u4, v4) = (calls[j] for j in (x, o, g, h))
                nn = (u1 + v1) * (u2 + v2) * (u3 + v3) * (u4 + v4)
                baba, abba = v1 * u2 * v3 * u4 + u1 * v2 * u3 * v4, u1 * v2 * v3 * u4 + v1 * u2 * u3 * v4
                t = out.setdefault((*key, k), [0, 0, 0])
                if nn:
                    t[0] += baba / nn
                    t[1] += (abba + baba) / nn
                    t[2] += 1
        return out

    combos = [c for c, _ in A.patterson_combos(1, 2, [f"s{i}" for i in range(n)])] + [(16, 3, 7, 9)]
    got = lambda df: {(r["chrom_ix"], r["block"], r["combo"]): [r["k"], r["n"], r["t"]] for r in df.collect()}
    v = M.merge_sparse(runs, n, 0, 64)
    for grid in (True, False):
        assert got(A.block_sums(v, combos, A.PATTERSON, size, grid)) == blocks_of(sparse, grid)
        assert got(A.dense_blocks(v, runs, n, combos, A.PATTERSON, size, 64, grid)) == blocks_of(dense, grid)
    assert A.block_sums(v, [], A.PATTERSON, size).count() == 0 and A.block_sums(v.limit(0), combos, A.PATTERSON, size).count() == 0


def test_cpg_across_chunks(spark):
    """CG pairs within and across chunks, at the ends and beside N, for sites inside and beyond the reference."""
    seq = "CGTCCGNCGACGGTNGCGC"
    chunks = spark.createDataFrame([(0, i, seq[i : i + 4]) for i in range(0, len(seq), 4)], S.CHUNKS)
    sites = spark.createDataFrame([(c, p, 1) for c in (0, 1) for p in range(25)], "chrom_ix int, pos int, alt int")
    gone = {p for p in range(len(seq)) if seq[p : p + 2] == "CG" or p and seq[p - 1 : p + 1] == "CG"}
    kept = sorted((r["chrom_ix"], r["pos"]) for r in Q.drop_cpg(sites, chunks, 4).collect())
    assert kept == [(c, p) for c in (0, 1) for p in range(25) if c or p not in gone]


def test_patch_is_the_inverse_of_diff(runs, chunks):
    got = {(r["sample_ix"], r["start"]): r["seq"] for r in M.patch(runs, chunks, 8).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i, 0] + got[i, 8] == t.replace("-", "N")


@pytest.mark.parametrize(("blocks", "v"), [([(1, 2), (3, 4), (2, 2)], 0.01388888888888889), ([(1, 2), (3, 4), (2, 2), (0, 0)], 0.010416666666666666)])
def test_jackknife(spark, blocks, v):
    df = spark.createDataFrame([(0, i, 0, float(k), float(m), 1.0) for i, (k, m) in enumerate(blocks)], "chrom_ix int, block long, combo int, k double, n double, t double")
    r = A.summarize(df).first()
    assert r["r"] == 0.5 and r["var"] == pytest.approx(4 * v) and r["g"] == len(blocks)


def test_jackknife_of_one_block_is_undefined(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 1.0)], "chrom_ix int, block long, combo int, k double, n double, t double")
    assert A.summarize(df).first()["var"] is None


def test_beta():
    assert incomplete_beta(0.3, 2, 2) == pytest.approx(0.216) and incomplete_beta(0.4, 1, 1) == pytest.approx(0.4)
    assert p_value(0.5, 0.01, 3) == pytest.approx(0.5) and p_value(1.0, 0.01, 3) == 0 == p_value(0.0, None, 3) and p_value(0.5, 0.3, 3) is None


def test_snp_names(spark):
    cases = [(0, 0, "A", "0"), (0, 0, "C", "10"), (0, 8, "A", "010"), (1, 1000, "G", "2X31"), (22, 123456, "T", "382FP")]
    df = spark.createDataFrame(cases, "c int, p int, a string, n string")
    assert df.where(X.snp_name(F.col("c"), F.col("p"), F.col("a")) != F.col("n")).count() == 0


def test_genotypes(spark):
    cases = [(-1, None, S.NS), (-1, -1, S.NS), (0, None, S.EQS2), (0, 0, S.EQS2), (0, -1, S.EQS2), (1, None, S.TRANS1), (1, -1, S.TRANS1), (0, 1, S.REFTRANS), (1, 1, S.TRANS2), (-1, 1, S.TRANS1), (2, 1, S.TRANSCOMPL)]
    df = spark.createDataFrame([(i, 0, i + 1, "T", ["C", "A"], a, b) for i, (a, b, _) in enumerate(cases)], "ord long, chrom_ix int, pos int, ref string, alts array<string>, a1 int, a2 int")
    assert [r["code"] for r in R.call_codes(df).orderBy("pos").collect()] == [c for _, _, c in cases]


_runs = st.lists(st.one_of(st.tuples(st.sampled_from([S.NS, S.EQS1, S.EQS2]), st.sampled_from([1, 5, 59, 60, 61, 255, 256, 70000, 20000000])), st.tuples(st.sampled_from([c for c in S.ALLELES if c not in S.STRETCHES]), st.just(1)), st.tuples(st.sampled_from([S.DEL1, S.DELH, S.DEL2]), st.sampled_from([1, 7, 8, 255]))), max_size=30)


@given(_runs, st.text(alphabet="TCAG", min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_codec(items, ins):
    one = [(c, n, None) for c, n in items] + [(S.INSH, len(ins), ins)]
    assert list(runfile.decode(runfile.encode(one) * 2)) == [one, one]


def test_codec_refuses():
    with pytest.raises(ValueError):
        list(runfile.decode(b"\x04"))
    with pytest.raises(ValueError):
        runfile.encode([(S.DEL1, 256, None)])


def test_old_formats(spark, tmp_path):
    # T and C as one pair, 3 * 2 matches, a two-byte stretch of 2 * 100 uncalled, the end
    body = bytes([4 + 11 * 2, 0xC0 + 3, 0xA0 | (100 & 15), 100 >> 4, 0x80])
    files = [("a", runfile.MAGIC + b"\0" + body), ("b", runfile.MAGIC + b"\1" + body), ("c", gzip.compress(runfile.MAGIC + b"\0" + bytes([3 + 11 * 9]))), ("d", b"\xb0\x71\x02")]
    for name, data in files:
        (tmp_path / name).write_bytes(data)
    paths = [str(tmp_path / name) for name, _ in files]
    contigs = spark.createDataFrame([(0, "1", 180)], S.CONTIGS)
    chunks = spark.createDataFrame([(0, 0, "TT" + "A" * 98), (0, 100, "A" * 80)], S.CHUNKS)
    got = sorted(tuple(r)[:5] for r in runfile.read_runs(spark, paths, (contigs, chunks)).collect())
    assert got[:8] == [(0, 0, 0, 1, S.EQS2), (0, 0, 1, 2, S.TRANS2), (0, 0, 2, 8, S.EQS2), (0, 0, 8, 180, S.NS), (1, 0, 0, 1, S.EQS1), (1, 0, 1, 2, S.TRANS1), (1, 0, 2, 8, S.EQS1), (1, 0, 8, 180, S.NS)]
    assert got[8:10] == [(2, 0, 0, 1, S.code_of(0, 3, 3)), (2, 0, 1, 2, S.code_of(0, 0, 1))] and {r[0] for r in got} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="without its reference"):
        runfile.read_runs(spark, paths)
    (tmp_path / "e").write_bytes(b"something else")
    with pytest.raises(ValueError, match="not recognised"):
        runfile.read_runs(spark, [str(tmp_path / "e")])


def test_run_file(spark, runs, tmp_path):
    from alleloom.sinks.text import write_runfile

    contigs = spark.createDataFrame([(0, "1", 12), (1, "2", 5)], S.CONTIGS)
    chunks = spark.createDataFrame([(0, 0, REF)], S.CHUNKS)
    write_runfile(runs.where("sample_ix = 1"), str(tmp_path / "a.run"), "ref.2bit", contigs)
    path = [str(tmp_path / "a.run")]
    assert [h[:2] for h in runfile.headers(spark, path)] == [(3, "ref.2bit")]
    back = runfile.read_runs(spark, path, (contigs, chunks)).drop("ins").where("run_end > run_start")
    want = runs.where("sample_ix = 1").select(F.lit(0).alias("sample_ix"), "chrom_ix", "run_start", "run_end", "code")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    other = contigs.where("chrom_ix = 0")
    with pytest.raises(ValueError, match="incompatible"):
        runfile.read_runs(spark, path, (other, chunks))
    assert runfile.read_runs(spark, path, (other, chunks), check=False).count() == back.count() + 0


def test_a_chromosome_must_not_reappear(spark, tmp_path):
    from alleloom.sources.text import import_vcf, read_vcf

    contigs = spark.createDataFrame([(0, "1", 6), (1, "2", 3)], S.CONTIGS)
    head = "##x\n#CHROM\tPOS\n"
    line = lambda c, p: f"{c}\t{p}\t.\tC\tT\t.\t.\t.\tGT\t0/1\n"
    for name, text in (("good", line("1", 1) + line("1", 2) + line("2", 1)), ("more", line("9", 1)), ("bad", line("1", 1) + line("2", 1) + line("1", 2))):
        (tmp_path / name).write_text(head + text)
    assert import_vcf(read_vcf(spark, [str(tmp_path / "good"), str(tmp_path / "more")], contigs), contigs).count() > 0
    with pytest.raises(ValueError, match="reappears"):
        import_vcf(read_vcf(spark, [str(tmp_path / "bad")], contigs), contigs)


def test_gzip_members():
    assert decompressed(gzip.compress(b"ab") + gzip.compress(b"cd") + b"junk") == b"abcd" and decompressed(b"xy") == b"xy"


@given(st.text(alphabet="TCAGN", max_size=60))
@settings(max_examples=100, deadline=None)
def test_twobit(seq):
    data = twobit.write(["c"], [twobit.pack(seq)])
    (_, at, n) = twobit.index(data)[0]
    assert n == len(seq) and twobit.unpack(data, at) == seq


def test_twobit_of_chunks(spark):
    """Records of chunks are those of whole texts, also where blocks of N cross chunks."""
    rng = random.Random(2)
    texts = {i: "".join(rng.choice("TCAGNNNN") for _ in range(n)) + "N" * 9 + "TC" for i, n in enumerate((0, 5, 40, 41))}
    chunks = spark.createDataFrame([(c, i, t[i : i + 8]) for c, t in texts.items() for i in range(0, len(t), 8)], S.CHUNKS).repartition(5)
    contigs = spark.createDataFrame([(c, f"c{c}", len(t)) for c, t in texts.items()], S.CONTIGS)
    assert {r["chrom_ix"]: bytes(r["record"]) for r in twobit.packed(chunks, contigs).collect()} == {c: twobit.pack(t) for c, t in texts.items()}


def test_bcf(spark):
    from alleloom.sources.bcf import records

    text = b"##fileformat=VCFv4.2\n##contig=<ID=zz>\n##contig=<ID=1>\n\0"

    def record(chrom, pos, alleles, gt):
        shared = struct.pack("<iiifII", chrom, pos, 1, 0.0, len(alleles) << 16, 1 | 1 << 24) + b"\x07" + b"".join(bytes([len(a) << 4 | 7]) + a for a in alleles)
        own = b"\x11\x01" + bytes([len(gt) << 4 | 1]) + bytes(gt)
        return struct.pack("<II", len(shared), len(own)) + shared + own

    data = b"BCF\2\2" + struct.pack("<I", len(text)) + text + record(1, 9, [b"T", b"C"], [2, 5]) + record(0, 3, [b"A"], [0, 0x81])
    assert list(records(gzip.compress(data), {"1": 0})) == [(0, 10, "T", ["C"], 0, 1, True), (-1, 4, "A", [], -1, None, False)]


def test_vcf_import(spark, tmp_path):
    from alleloom.sources.text import import_vcf, read_vcf

    contigs = spark.createDataFrame([(0, "1", 6), (1, "2", 3)], S.CONTIGS)
    rows = [("1", 2, "C", "T", "0/1"), ("1", 2, "C", "A", "1/1"), ("1", 4, "G", ".", "0/0"), ("9", 1, "A", "C", "1/1"), ("2", 1, "A", "CC", "1/1"), ("2", 3, "T", "C", "1|1")]
    text = "##x\n#CHROM\tPOS\n" + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t.\tGT:X\t{g}:1\n" for c, p, r, a, g in rows)
    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(text.encode()))
    got = import_vcf(read_vcf(spark, [str(tmp_path / "a.vcf.gz")], contigs), contigs, "sparse").orderBy("chrom_ix", "run_start").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 1, S.EQS2), (0, 1, 2, S.REFTRANS), (0, 2, 6, S.EQS2), (1, 0, 2, S.EQS2), (1, 2, 3, S.TRANS2)]


def test_regions_and_individuals(spark, tmp_path):
    from alleloom.sources.text import read_bed, read_individuals

    contigs = spark.createDataFrame([(0, "1", 60)], S.CONTIGS)
    (tmp_path / "a.bed").write_text("1 5 10\n1\tx\t3\n7 1 2\n1 8 12 name\n")
    bed = read_bed(spark, [str(tmp_path / "a.bed")], contigs)
    assert sorted(map(tuple, bed.collect())) == [(0, 5, 10), (0, 8, 12)]
    pts = spark.createDataFrame([(0, p) for p in range(20)], "chrom_ix int, pos int")
    assert sorted(r["pos"] for r in Q.restrict_to_regions(pts, bed).collect()) == list(range(5, 12))
    (tmp_path / "a.ind").write_text("# c\nab F P1\nabc M P2\n")
    who = spark.createDataFrame([(0, "abX"), (1, "abcd")], "sample_ix int, label string")
    assert [r["pop"] for r in Q.assign_populations(who, read_individuals(spark, [str(tmp_path / "a.ind")])).orderBy("sample_ix").collect()] == ["P1", "P2"]


def test_maf(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "1", 40), (1, "MT", 9)], S.CONTIGS)
    (tmp_path / "a.maf").write_text("##maf\na score=1\ns hg.chr1 2 4 + 40 TC-AG\ns pt.chr1 0 5 + 9 TCCAA\n\na\ns hg.chr1 10 3 - 40 TCA\ns pt.chr1 0 3 + 9 TTA\n")
    b = alignments.maf_blocks(alignments.read_maf(spark, [str(tmp_path / "a.maf")]), "hg", "pt", contigs)
    assert sorted((r["chrom_ix"], r["start"], r["ref_seq"], r["smp_seq"]) for r in b.collect()) == [(0, 2, "TCAG", "TCAA"), (0, 27, "TGA", "TAA")]
    runs, _ = alignments.import_blocks(b, contigs)
    assert (0, 5, 6, S.TRANS2) in {tuple(r)[1:] for r in runs.collect()}


def test_many_blocks_lie_where_they_belong(spark, tmp_path):
    """Two files of many blocks, some of one start: a later block replaces an earlier one, the same in every evaluation."""
    rng = random.Random(3)
    contigs = spark.createDataFrame([(0, "1", 4000), (1, "X", 4000)], S.CONTIGS)
    files, want = [], {}
    for f in range(2):
        text = ""
        for _ in range(150):
            chrom, start = rng.choice("1X"), rng.randrange(200) * 20
            ref = "".join(rng.choice("TCAG") for _ in range(20))
            smp = "".join(rng.choice("TCAG") for _ in range(20))
            text += f"a\ns hg.chr{chrom} {start} 20 + 4000 {ref}\ns pt.z 0 20 + 20 {smp}\n\n"
            want[chrom, start] = ref, smp
        files.append(str(tmp_path / f"{9 - f}.maf"))
        (tmp_path / f"{9 - f}.maf").write_text(text)
    points = {(0 if c == "1" else 1, s + i, S.code_of(S.BASES.index(a), S.BASES.index(b), S.BASES.index(b))) for (c, s), (r, q) in want.items() for i, (a, b) in enumerate(zip(r, q, strict=True)) if a != b}
    blocks = alignments.maf_blocks(alignments.read_maf(spark, files), "hg", "pt", contigs).repartition(7)
    for _ in range(3):
        rows = alignments.import_blocks(blocks, contigs)[0].collect()
        assert {(r["chrom_ix"], r["run_start"], r["code"]) for r in rows if r["code"] not in S.STRETCHES} == points
        for c in (0, 1):
            spans = sorted((r["run_start"], r["run_end"]) for r in rows if r["chrom_ix"] == c)
            assert spans[0][0] == 0 and spans[-1][1] == 4000 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_emf(spark, tmp_path):
    text = (
        "##c\nSEQ homo_sapiens 1 3 6 1 (chr)\nSEQ pan_troglodytes 1 11 14 1 (chr)\nSEQ ancestral_sequences Anc 1 4 1 (chr)\n"
        "TREE (Hsap_1_3_6[+]:0.1,Ptro_1_11_14[+]:0.1)Aseq_Anc_1_4[+]:0.1;\nDATA\ntct\nccc\n-aa\nagg\n//\n"
    )
    (tmp_path / "x.emf.gz").write_bytes(gzip.compress(text.encode()))
    got = alignments.read_emf(spark, str(tmp_path), ancestor_of=("pan", "troglodytes")).collect()
    assert [(r["chrom"], r["start"], r["ref_seq"], r["smp_seq"]) for r in got] == [("1", 2, "TCA", "TCG")]
    got = alignments.read_emf(spark, str(tmp_path), sample=("pan", "troglodytes")).collect()
    assert [(r["ref_seq"], r["smp_seq"]) for r in got] == [("TCA", "CCG")]


def test_normalise_twice(runs):
    assert sorted(map(tuple, R.normalize(R.normalize(runs)).collect())) == sorted(map(tuple, R.normalize(runs).collect()))


def test_assemble(spark):
    contigs = spark.createDataFrame([(0, "1", 30), (1, "2", 4)], S.CONTIGS)
    b = spark.createDataFrame([(0, 5, 5, 1), (0, 8, 10, 2), (0, 10, 3, 3), (0, 20, 2, 4), (0, 20, 4, 5)], "chrom_ix int, start int, len int, ord long")
    got = sorted(map(tuple, R.assemble(b, contigs).collect()), key=lambda x: x[:2])
    assert got == [(0, 0, 5, None), (0, 5, 10, 1), (0, 10, 13, 3), (0, 13, 20, None), (0, 20, 24, 5), (0, 24, 30, None), (1, 0, 4, None)]


def test_density(spark):
    bases = spark.createDataFrame([(0, i, "TCAG" * 250) for i in range(0, 4000, 1000)], S.CHUNKS)
    raw = lambda p: spark.createDataFrame([(i, 0, x + 1) for i, x in enumerate(p)], "ord long, chrom_ix int, pos int")
    assert R.detect_density(raw(range(200)), bases) == "dense"
    assert R.detect_density(raw(range(0, 4000, 50)), bases) == "sparse"
    assert R.detect_density(raw(range(0, 40, 2)), bases) is None
    none = spark.createDataFrame([(0, 0, "N" * 4000)], S.CHUNKS)
    assert R.detect_density(raw(range(0, 4000, 50)), none) is None


def test_errors_in_text(spark):
    bad = spark.createDataFrame([(0, 0, "Z")], "sample_ix int, chrom_ix int, seq string")
    with pytest.raises(Exception, match="unexpected letter"):
        R.diff(bad, spark.createDataFrame([(0, "T")], "chrom_ix int, seq string")).collect()


def test_small_functions(spark):
    assert X.size_of("5M") == 5_000_000 and X.size_of("12k") == 12_000 and X.size_of("7") == 7
    # the exponent form is that of the original's printer, without padding
    assert X.p_text(0.25) == "0.250" and X.p_text(0.0001) == "1.0e-4" and X.p_text(None) == "NaN" and X.p_text(0.0) == "0.0e0"
    assert X.fixed(2.5, 0) == "3" and X.fixed(-0.125, 2) == "-0.13" and X.scientific(0.125, 2) == "1.25e-1" and X.scientific(9.996, 2) == "1.00e1"
    assert X.label_of("a/HG.1.hef") == "HG.1" and X.label_of("x") == "x"
    from alleloom.cli import command_of

    assert command_of("TREE") == "treemix" and command_of("vcfi") == "vcfin"
    with pytest.raises(SystemExit):
        command_of("twobit")


def test_stream_equals_batch(spark, tmp_path):
    from alleloom.streaming.positions import block_counts, stream_calls

    calls = spark.createDataFrame([(i % 3, 0, i * 7, i % 15) for i in range(60)], "sample_ix int, chrom_ix int, pos int, code int")
    calls.repartition(4).write.parquet(str(tmp_path / "calls"))
    q = block_counts(stream_calls(spark, str(tmp_path / "calls"), 1), 100).writeStream.format("memory").queryName("blocks").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("blocks").collect())) == sorted(map(tuple, block_counts(calls, 100).collect()))
