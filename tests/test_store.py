"""References read by range: any span equals the whole file's, and only its bytes are read."""

import gzip
import random
from contextlib import contextmanager

import numpy as np
import pytest

from alleloom import schema as S
from alleloom.operators import filters as Q
from alleloom.operators import merge as M
from alleloom.sources import store, twobit


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rng = random.Random(3)
    texts = {n: "".join(rng.choice("TCAG") if rng.random() < 0.97 else "N" * rng.randrange(1, 40) for _ in range(k)) for n, k in (("1", 5000), ("2", 37), ("X", 12_345), ("empty", 0))}
    path = tmp_path_factory.mktemp("ref") / "a.2bit"
    path.write_bytes(twobit.write(list(texts), [twobit.pack(t) for t in texts.values()]))
    return str(path), texts


@pytest.mark.parametrize("size", [64, 1000, 65536])
def test_chunks(spark, genome, size):
    path, texts = genome
    contigs, chunks = twobit.read(spark, path, size)
    assert [tuple(r) for r in contigs.orderBy("chrom_ix").collect()] == [(i, n, len(t)) for i, (n, t) in enumerate(texts.items())]
    want = {(i, a): t[a : a + size] for i, t in enumerate(texts.values()) for a in range(0, len(t), size)}
    assert {(r["chrom_ix"], r["start"]): r["seq"] for r in chunks.collect()} == want
    some = twobit.read(spark, path, size, "X:2001-7000")[1]
    near = {k: v for k, v in want.items() if k[0] == 2 and k[1] > 2000 - size and k[1] < 7000}
    assert {(r["chrom_ix"], r["start"]): r["seq"] for r in some.collect()} == near
    assert twobit.read(spark, path, size, "2")[1].count() == -(-37 // size) and twobit.read(spark, path, size, "9")[1].count() == 0
    assert {(r["chrom_ix"], r["start"]): r["seq"] for r in chunks.where("chrom_ix = 0").collect()} == {k: v for k, v in want.items() if k[0] == 0}
    assert chunks.count() == len(want)


def test_spans(genome):
    path, texts = genome
    r = twobit.TwoBitReader(path, 16, {2}, 4016, 4033)
    (span,) = r.partitions()
    assert (span.chrom_ix, span.lo, span.hi) == (2, 4016, 4048)
    (batch,) = r.read(span)
    assert "".join(batch.column(2).to_pylist()) == texts["X"][4016:4048]
    none = twobit.TwoBitReader(path, 16, {7})
    assert [b for p in none.partitions() for b in none.read(p)] == []


def test_a_region_reads_few_bytes(spark, tmp_path, monkeypatch):
    """name:a-b of 40 million bases reads some kilobytes, the head and the N blocks included."""
    path = tmp_path / "big.2bit"
    n = 40_000_000
    none = np.array([], int)
    path.write_bytes(twobit.write(["z"], [twobit.record(n, none, none, bytes(n // 4))]))
    read = []
    plain = store.opened_range

    class Counted:
        def __init__(self, f):
            self.f = f

        def read_at(self, count, at):
            read.append(count)
            return self.f.read_at(count, at)

    @contextmanager
    def counted(p):
        with plain(p) as (f, size):
            yield Counted(f), size

    monkeypatch.setattr(twobit, "opened_range", counted)
    r = twobit.TwoBitReader(str(path), 4096, {0}, 29_999_104, 30_001_000)
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 1 and sum(read) < 80_000
    monkeypatch.undo()
    contigs, chunks = twobit.read(spark, str(path), 65536, "z:30000001-30000060")
    lines = twobit.fasta_lines(chunks, contigs, "z:30000001-30000060").orderBy("ord").collect()
    assert [r["line"] for r in lines] == [">z", "T" * 50, "T" * 10] and chunks.rdd.getNumPartitions() == 1
    assert twobit.read(spark, str(path), 65536)[1].rdd.getNumPartitions() == 10


def test_other_stores_and_compressed_files(spark, genome, tmp_path):
    path, texts = genome
    packed = tmp_path / "a.2bit.gz"
    packed.write_bytes(gzip.compress(open(path, "rb").read()))
    want = sorted(tuple(r) for r in twobit.read(spark, path, 512)[1].collect())
    assert sorted(tuple(r) for r in twobit.read(spark, str(packed), 512, "X:600-1100")[1].collect()) == [r for r in want if r[0] == 2 and r[1] in (512, 1024)]
    for other in (str(packed), f"file://{path}", f"file:{path}"):
        assert sorted(tuple(r) for r in twobit.read(spark, other, 512)[1].collect()) == want
    assert store.located("viewfs://x/y") is None and store.located(str(tmp_path)) is None and not store.can_range(str(packed))


@pytest.mark.parametrize("size", [8, 1024, 4096, 65536])
def test_lookups_by_piece(spark, genome, size):
    """Reference bases, CpG sites and patched texts don't depend on the size of chunks."""
    path, texts = genome
    _, chunks = twobit.read(spark, path, size)
    rng = random.Random(size)
    sites = [(c, p, 1) for c, t in enumerate(texts.values()) for p in {rng.randrange(len(t) + 3) for _ in range(300)} | {0, len(t) - 1, len(t), 1023, 1024} if p >= 0]
    v = spark.createDataFrame(sites, "chrom_ix int, pos int, alt int").cache()
    of = list(texts.values())
    got = {(r["chrom_ix"], r["pos"]): r["ref"] for r in M.add_ref(v, chunks, size).collect()}
    assert got == {(c, p): S.BASES.index(of[c][p]) if of[c][p] in S.BASES else None for c, p, _ in sites if p < len(of[c])}
    pair = lambda t, p: t[p : p + 2] == "CG" or (p > 0 and t[p - 1 : p + 1] == "CG")
    assert sorted((r["chrom_ix"], r["pos"]) for r in Q.drop_cpg(v, chunks, size).collect()) == sorted((c, p) for c, p, _ in sites if not pair(of[c], p))
    runs = [(0, 0, 0, 700, S.EQS2), (0, 0, 700, 701, S.TRANS2), (0, 0, 701, 720, S.DEL2), (0, 0, 1023, 1024, S.REFCOMPL), (1, 2, 5, 9000, S.EQS1), (1, 2, 12_000, 99_999, S.DELH)]
    texts_of = {}
    for r in M.patch(spark.createDataFrame(runs, S.RUNS), chunks, size).orderBy("sample_ix", "chrom_ix", "start").collect():
        key = r["sample_ix"], r["chrom_ix"]
        texts_of[key] = texts_of.get(key, "") + r["seq"]
    one, x = of[0], of[2]
    letter = lambda code, b: "N" if b == "N" else S.LETTER_OF["".join(sorted(S.BASES[S.BASES.index(b) ^ a] for a in (S.ALLELES[code] * 2)[:2]))]
    assert texts_of[0, 0] == one[:700] + letter(S.TRANS2, one[700]) + "-" * 19 + "N" * 303 + letter(S.REFCOMPL, one[1023]) + "N" * (len(one) - 1024)
    assert texts_of[1, 2] == "N" * 5 + x[5:9000] + "N" * 3000 + x[12_000:] and texts_of[0, 1] == "N" * len(of[1])
