"""BAM alignments as a table of read bases, which pileups are made of."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from alleloom.sources.blocks import STEP, Blocks, Format, Range, RangeReader, load, parted, records_of
from alleloom.sources.files import decompressed, opened

BASES = "chrom string, pos int, base string, strand string, baseq int, mapq int, read_pos int"
#: Fixed values of the format: letters of four-bit bases, and which CIGAR operations (MIDNSHP=X) use up the read, the reference.
_LETTERS = "=ACMGRSVTWYHKDBN"
_READ, _REFERENCE = frozenset((0, 1, 4, 7, 8)), frozenset((0, 2, 3, 7, 8))
_ALIGNED = frozenset((0, 7, 8))
_UNMAPPED, _REVERSE, _SECONDARY = 0x4, 0x10, 0x100
#: Bases in an Arrow batch.
_BATCH = 200_000


def head(data: bytes) -> tuple[list[tuple[str, int]], int] | None:
    """(contigs with their lengths, where alignments begin), or None if data end before."""
    if len(data) < 8:
        return None
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    if len(data) < at + 4:
        return None
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    contigs = []
    for _ in range(n):
        if len(data) < at + 4 or len(data) < at + 8 + (k := struct.unpack_from("<i", data, at)[0]):
            return None
        contigs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return contigs, at


def length(data: bytes, at: int) -> int:
    return 4 + struct.unpack_from("<i", data, at)[0]


def sensible(contigs: list[tuple[str, int]], data: bytes, at: int) -> bool:
    """Whether an alignment's fixed fields are what they can be and its parts have room in it."""
    size, ref, pos, name_size, _, _, n_cigar, _, bases, other, other_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fits = lambda r, p: -1 <= r < len(contigs) and -1 <= p and (r < 0 or p < contigs[r][1])
    if not fits(ref, pos) or not fits(other, other_pos) or name_size < 1 or bases < 0:
        return False
    if 32 + name_size + 4 * n_cigar + (bases + 1) // 2 + bases > size:
        return False
    name = data[at + 36 : at + 36 + name_size]
    return name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1])


FORMAT = Format(36, head, length, sensible)


def alignment(contigs: list[tuple[str, int]], data: bytes, at: int) -> tuple[str, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(contig, mapq, flag, positions, base codes, qualities, places from the read's 5' end or, if negative, its 3' end; the
    nearer end counts) of a mapped primary alignment with aligned bases; else None."""
    _, ref, pos, name_size, mapq, _, n_cigar, flag, bases_ = struct.unpack_from("<iiiBBHHHi", data, at)
    if ref < 0 or flag & (_UNMAPPED | _SECONDARY):
        return None
    p = at + 36 + name_size
    cigar = np.frombuffer(bytes(data[p : p + 4 * n_cigar]), "<u4")
    p += 4 * n_cigar
    packed = np.frombuffer(bytes(data[p : p + (bases_ + 1) // 2]), np.uint8)
    bases = np.stack([packed >> 4, packed & 15], 1).ravel()[:bases_]
    p += len(packed)
    quality = np.frombuffer(bytes(data[p : p + bases_]), np.uint8)
    here, there, reads, places = 0, pos, [], []
    for c in cigar.tolist():
        k, op = c >> 4, c & 15
        if op in _ALIGNED:
            reads.append(np.arange(here, here + k))
            places.append(np.arange(there, there + k))
        here += k if op in _READ else 0
        there += k if op in _REFERENCE else 0
    if not reads:
        return None
    r = np.concatenate(reads)
    begin = bases_ - 1 - r if flag & _REVERSE else r
    return contigs[ref][0], mapq, flag, np.concatenate(places), bases[r], quality[r], np.where(2 * begin < bases_, begin, begin - bases_)


def alignments(data: bytes) -> Iterator[tuple]:
    """alignment() of every alignment of a whole file that has one."""
    data = decompressed(data)
    known = head(data)
    if known is None:
        raise ValueError("short record")
    contigs, at = known
    while at < len(data):
        if at + 36 > len(data) or at + length(data, at) > len(data):
            raise ValueError("short record")
        if a := alignment(contigs, data, at):
            yield a
        at += length(data, at)


def _batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for a in found:
        held.append(a)
        size += len(a[3])
        if size >= _BATCH:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _range_rows(blocks: Blocks, r: Range, options: dict) -> Iterator[pa.RecordBatch]:
    yield from _batches(a for known, _, data, at in records_of(blocks, FORMAT, r.lo, r.hi) if (a := alignment(known, data, at)))


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_bam"

    def schema(self) -> str:
        return BASES

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options, _range_rows)


def read_bases(spark: SparkSession, paths: list[str], step: int = STEP) -> DataFrame:
    """(chrom, pos, base, strand, baseq, mapq, read_pos) of every aligned base of BAM files; bases are those of the forward
    strand. Files in blocks, as BAM files are, are read in parts of `step` compressed bytes, others whole, by one task each;
    the order of rows doesn't matter, as pileups group by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _batches(alignments(content.as_buffer().to_pybytes()))

    split, whole = parted(paths)
    parts = [load(spark, Bam, split, step)] if split else []
    parts += [opened(spark, [p]).select("content").mapInArrow(run, BASES) for _, p in whole]
    return reduce(DataFrame.unionByName, parts)


_LETTER = np.array(list(_LETTERS))


def _rows(held: list[tuple]) -> pa.RecordBatch:
    count = [len(a[3]) for a in held]
    whole = lambda i: np.concatenate([a[i] for a in held])
    each = lambda values: np.repeat(np.array(values), count)
    columns = [each([a[0] for a in held]), whole(3).astype(np.int32), _LETTER[whole(4)], each(["-" if a[2] & _REVERSE else "+" for a in held]), whole(5).astype(np.int32), each([a[1] for a in held]).astype(np.int32), whole(6).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chrom", "pos", "base", "strand", "baseq", "mapq", "read_pos"])
