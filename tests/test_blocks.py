"""Files read in parts: for every size of part the rows are those of the whole file, in its order."""

import gzip
import random
import struct
import zlib

import pytest

from alleloom import schema as S
from alleloom.sources import bam, bcf, blocks
from alleloom.sources.files import lines, split_lines
from alleloom.sources.text import import_vcf, read_vcf


def blocked(data, sizes, rng):
    """Data as blocked gzip with blocks of random sizes, and the block that ends a file."""
    out, at = [], 0
    while at < len(data):
        n = rng.choice(sizes)
        out.append(_member(data[at : at + n]))
        at += n
    return b"".join([*out, _member(b"")])


def _member(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def whole(path, step, form):
    """(place, record) over all parts of `step` bytes."""
    from alleloom.sources.store import opened_range

    out = []
    with opened_range(str(path)) as (f, size):
        for lo in range(0, size, step):
            out += [(o, bytes(d[at : at + form.length(d, at)])) for _, o, d, at in blocks.records_of(blocks.Blocks(f, size), form, lo, min(lo + step, size))]
    return out


def bcf_data(n, rng):
    text = b"##fileformat=VCFv4.2\n##contig=<ID=zz>\n##contig=<ID=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n\0"
    out = [b"BCF\2\2" + struct.pack("<I", len(text)) + text]
    for i in range(n):
        alleles = [rng.choice([b"A", b"C"]), rng.choice([b"G", b"T", b"G" * 20])][: rng.choice([1, 2, 2])]
        one = lambda a: (bytes([len(a) << 4 | 7]) if len(a) < 15 else b"\xf7\x11" + bytes([len(a)])) + a
        info = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        shared = struct.pack("<iiifII", rng.choice([0, 1, 1]), i * 3, 1, 0.0, len(alleles) << 16 | 1, 1 | 1 << 24) + rng.choice([b"\x07", b"\x37rs1"]) + b"".join(map(one, alleles)) + info
        own = b"\x11\x01" + b"\x21" + bytes([2 * rng.randrange(3), 2 * rng.randrange(3) + rng.randrange(2)])
        out.append(struct.pack("<II", len(shared), len(own)) + shared + own)
    return b"".join(out)


def bam_data(n, rng):
    text = b"@HD\tVN:1.6\n"
    refs = [(b"1\0", 500_000), (b"chrX\0", 9000)]
    out = [b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r)) + r + struct.pack("<i", k) for r, k in refs)]
    for i in range(n):
        k = rng.randrange(1, 60)
        name = b"read%d\0" % i
        cigar = struct.pack("<I", k << 4)
        flag = rng.choice([0, 16, 16, 4, 256])
        rec = struct.pack("<iiBBHHHiiii", 0, rng.randrange(400_000), len(name), rng.randrange(60), 0, 1, flag, k, -1, -1, 0) + name + cigar
        rec += bytes(rng.choice([0x11, 0x24, 0x88, 0x18]) for _ in range((k + 1) // 2)) + bytes(rng.randrange(2, 40) for _ in range(k)) + b"NMC" + bytes([rng.randrange(256)])
        out.append(struct.pack("<i", len(rec)) + rec)
    return b"".join(out)


@pytest.mark.parametrize("sizes", [[5, 40, 300], [2000], [65_000]])
@pytest.mark.parametrize(("form", "make"), [(bcf.FORMAT, bcf_data), (bam.FORMAT, bam_data)])
def test_records_of_every_part(tmp_path, sizes, form, make):
    rng = random.Random(sizes[0])
    data = make(400, rng)
    (tmp_path / "a").write_bytes(blocked(data, sizes, rng))
    (tmp_path / "plain").write_bytes(data)
    _, at = form.head(data)
    want = []
    while at < len(data):
        want.append(data[at : at + form.length(data, at)])
        at += len(want[-1])
    size = (tmp_path / "a").stat().st_size
    for step in (97, 1000, 7001, size // 2, size + 5):
        got = whole(tmp_path / "a", step, form)
        assert [r for _, r in got] == want and [o for o, _ in got] == sorted({o for o, _ in got})
    assert [r for _, r in whole(tmp_path / "plain", 6000, form)] == want


def test_a_cut_file_is_an_error(tmp_path):
    rng = random.Random(1)
    data = bcf_data(50, rng)
    (tmp_path / "cut").write_bytes(blocked(data[:-3], [500], rng))
    (tmp_path / "torn").write_bytes(blocked(data, [500], rng)[:-60])
    for name, error in (("cut", "short record"), ("torn", "cut short|short record")):
        with pytest.raises(ValueError, match=error):
            whole(tmp_path / name, 400, bcf.FORMAT)


@pytest.mark.parametrize("step", [50, 777, 1 << 20])
def test_lines(spark, tmp_path, step):
    rng = random.Random(2)
    text = "".join(rng.choice(["", "x", "é" * 30, "word " * 50]) + "\n" for _ in range(120))
    files = {"a.gz": blocked(text.encode(), [3, 90, 1000], rng), "b": text.encode(), "c.gz": gzip.compress(text.encode()), "d": (text + "no end").encode(), "e": b"", "f.gz": blocked(b"one\ntwo", [4], rng)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = [str(tmp_path / n) for n in files]
    got = [(r["file"], r["line"]) for r in split_lines(spark, paths, step).orderBy("ord").collect()]
    assert got == [(r["file"], r["line"]) for r in lines(spark, paths).orderBy("file", "ord").collect()]
    assert [blocks.can_split(p) for p in paths] == [True, True, False, True, True, True]


def test_files_in_many_tasks(spark, tmp_path):
    """VCF, BCF and BAM in blocks: equal rows for every size of part, and more than one task."""
    rng = random.Random(5)
    contigs = spark.createDataFrame([(0, "1", 9000), (1, "zz", 9000)], S.CONTIGS)
    vcf = "##x\n#CHROM\tPOS\n" + "".join(f"1\t{i * 2 + 1}\t.\t{rng.choice('AC')}\t{rng.choice('GT')}\t.\t.\t.\tGT\t{rng.choice(['0/1', '1|1', '.'])}\n" for i in range(900))
    (tmp_path / "a.vcf.gz").write_bytes(blocked(vcf.encode(), [300, 700], rng))
    (tmp_path / "a.bcf").write_bytes(blocked(bcf_data(600, rng), [300, 700], rng))
    (tmp_path / "a.bam").write_bytes(blocked(bam_data(500, rng), [300, 700], rng))
    for name in ("a.vcf.gz", "a.bcf", "a.bam"):
        (tmp_path / f"whole-{name}").write_bytes(gzip.compress(gzip.decompress((tmp_path / name).read_bytes())))
    reads = {"a.vcf.gz": lambda p, s: read_vcf(spark, [p], contigs, s), "a.bcf": lambda p, s: bcf.read_bcf(spark, p, contigs, s), "a.bam": lambda p, s: bam.read_bases(spark, [p], s)}
    for name, read in reads.items():
        rows = lambda df: sorted(map(str, df.drop("ord").collect()))
        want = rows(read(str(tmp_path / f"whole-{name}"), 1 << 20))
        for step in (4001, 1 << 20):
            df = read(str(tmp_path / name), step)
            assert rows(df) == want and len(want) >= 500
        if name != "a.vcf.gz":
            assert read(str(tmp_path / name), 4001).rdd.getNumPartitions() > 3
    by_ord = [r["pos"] for r in read_vcf(spark, [str(tmp_path / "a.vcf.gz")], contigs, 999).orderBy("ord").collect()]
    assert by_ord == [i * 2 + 1 for i in range(900)]
    runs = lambda p: sorted(map(tuple, import_vcf(read_vcf(spark, [str(tmp_path / p)], contigs, 2000), contigs).collect()))
    assert runs("a.vcf.gz") == runs("whole-a.vcf.gz")
