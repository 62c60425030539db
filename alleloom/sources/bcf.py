"""Binary VCF (version 2): one sample, genotypes first among its fields."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from alleloom.sources.blocks import FILE_BITS, STEP, Blocks, Format, Range, RangeReader, load, parted, records_of
from alleloom.sources.files import decompressed, opened

RAW = "ord long, chrom_ix int, pos int, ref string, alts array<string>, a1 int, a2 int, phased boolean"
#: Fixed values of the format: bytes of integer types 1, 2 and 3, and the type of text.
_INT = {1: "<b", 2: "<h", 3: "<i"}
_TEXT = 7


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, count, next offset) of a typed value."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        k = data[at] & 15
        n = struct.unpack_from(_INT[k], data, at + 1)[0]
        at += 1 + struct.calcsize(_INT[k])
    return kind, n, at


def head(data: bytes) -> tuple[tuple[list[str], int], int] | None:
    """((contigs, number of samples), where records begin), or None if data end before."""
    if len(data) < 9:
        return None
    if data[:4] != b"BCF\2":
        raise ValueError("not a BCF version 2 file")
    size = struct.unpack_from("<I", data, 5)[0]
    if len(data) < 9 + size:
        return None
    text = data[9 : 9 + size].decode("utf-8", "replace")
    columns = re.findall(r"(?m)^#CHROM\t.*$", text)
    return (re.findall(r"(?m)^##contig=<ID=([^,>]+)", text), max(0, columns[-1].count("\t") - 8) if columns else 1), 9 + size


def length(data: bytes, at: int) -> int:
    shared, own = struct.unpack_from("<II", data, at)
    return 8 + shared + own


def sensible(known: tuple[list[str], int], data: bytes, at: int) -> bool:
    """Whether a record's fixed fields, its identifier and its alleles are what they can be."""
    shared, _, chrom, pos, size, _, counts, formats = struct.unpack_from("<IIiiiIII", data, at)
    if shared < 24 or not 0 <= chrom < len(known[0]) or pos < -1 or size < 0 or formats & 0xFFFFFF != known[1] or not counts >> 16:
        return False
    p, end = at + 32, at + 8 + shared
    for k in range(1 + (counts >> 16)):
        if p >= end:
            return False
        if p + 6 > len(data):
            return True  # further than what is looked at
        kind = data[p] & 15
        if not (kind == _TEXT or (k == 0 and data[p] == 0)) or (data[p] >> 4 == 15 and data[p + 1] & 15 not in _INT):
            return False
        _, n, p = _typed(data, p)
        p += n
    return p <= end


FORMAT = Format(32, head, length, sensible)


def record(data: bytes, at: int, table: list[int]) -> tuple:
    """(chrom_ix, 1-based pos, ref, alts, a1, a2, phased) of the record at a place; table has the numbers of contigs."""
    shared, own = struct.unpack_from("<II", data, at)
    chrom, pos = struct.unpack_from("<ii", data, at + 8)
    n_alleles = struct.unpack_from("<I", data, at + 24)[0] >> 16
    _, n, p = _typed(data, at + 32)
    p += n  # the identifier
    alleles = []
    for _ in range(n_alleles):
        kind, n, p = _typed(data, p)
        if kind != _TEXT:
            raise ValueError("text expected")
        alleles.append(bytes(data[p : p + n]).decode())
        p += n
    kind, n, q = _typed(data, _key(data, at + 8 + shared))
    if kind not in (1, 2) or n not in (1, 2):
        raise ValueError("haploid or diploid genotypes of one or two bytes are expected")
    v = [struct.unpack_from(_INT[kind], data, q + i * struct.calcsize(_INT[kind]))[0] for i in range(n)]
    end = -127 if kind == 1 else -32767
    one = [None if x == end else (x >> 1) - 1 for x in v]
    return table[chrom], pos + 1, alleles[0], alleles[1:], one[0] if one[0] is not None else -1, one[1] if n == 2 else None, n == 2 and bool(v[1] & 1) and one[1] is not None


def records(data: bytes, names: dict[str, int]) -> Iterator[tuple]:
    """Every record of a whole file; contigs that the reference does not have are -1."""
    data = decompressed(data)
    known = head(data)
    if known is None:
        raise ValueError("short record")
    (contigs, _), at = known
    table = [names.get(n, -1) for n in contigs]
    while at < len(data):
        if at + 32 > len(data) or at + length(data, at) > len(data):
            raise ValueError("short record")
        yield record(data, at, table)
        at += length(data, at)


def _key(data: bytes, at: int) -> int:
    """The offset after a field's key."""
    kind, n, at = _typed(data, at)
    return at + n * struct.calcsize(_INT[kind])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["ord", "chrom_ix", "pos", "ref", "alts", "a1", "a2", "phased"])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, 20_000):
        yield _batch(list(some))


def _range_rows(blocks: Blocks, r: Range, options: dict) -> Iterator[pa.RecordBatch]:
    names = json.loads(options["names"])

    def rows() -> Iterator[tuple]:
        table = None
        for known, place, data, at in records_of(blocks, FORMAT, r.lo, r.hi):
            table = table or [names.get(n, -1) for n in known[0]]
            yield ((r.file << FILE_BITS) + place, *record(data, at, table))

    yield from _batches(rows())


class Bcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_bcf"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options, _range_rows)


def read_bcf(spark: SparkSession, paths: str | list[str], contigs: DataFrame, step: int = STEP) -> DataFrame:
    """Raw records, as read_vcf, in the order of paths. Files in blocks are read in parts of `step` compressed bytes, others
    whole, by one task each."""
    names = {r["name"]: r["chrom_ix"] for r in contigs.select("name", "chrom_ix").collect()}  # one row per chromosome
    split, whole = parted([paths] if isinstance(paths, str) else paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _batches(((file << FILE_BITS) + i, *r) for i, r in enumerate(records(content.as_buffer().to_pybytes(), names)))

    parts = [load(spark, Bcf, split, step, names=json.dumps(names))] if split else []
    parts += [opened(spark, [p]).select(F.lit(i).alias("file"), "content").mapInArrow(run, RAW) for i, p in whole]
    return reduce(DataFrame.unionByName, parts)
