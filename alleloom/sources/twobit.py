"""The 2bit reference format: little-endian, blocks of N honoured, mask blocks read over and never written."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from alleloom import schema as S
from alleloom.sources.files import decompressed
from alleloom.sources.store import can_range, opened_range

#: Fixed value of the format.
MAGIC = 0x1A412743
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(S.BASES):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
CODED = pa.schema([("chrom_ix", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("starts", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
_LETTER = np.frombuffer(S.BASES.encode(), np.uint8)


def coded(seq: str) -> tuple[int, np.ndarray, np.ndarray, bytes]:
    """A text's length, where its blocks of N start and how long they are, and its bases, four to a byte from the high
    bits, the last byte padded low."""
    raw = np.frombuffer(seq.upper().encode(), np.uint8)
    none = ~np.isin(raw, _LETTER)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], none.astype(np.int8), [0]])))
    code = np.where(none, 0, _CODE[raw]).astype(np.uint8)
    code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    body = (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).astype(np.uint8)
    return len(raw), edge[::2], edge[1::2] - edge[::2], body.tobytes()


def record(length: int, starts: np.ndarray, sizes: np.ndarray, body: bytes) -> bytes:
    """One sequence's record: length, N blocks, no masks, bases."""
    return struct.pack("<II", length, len(starts)) + starts.astype("<u4").tobytes() + sizes.astype("<u4").tobytes() + struct.pack("<II", 0, 0) + body


def pack(seq: str) -> bytes:
    return record(*coded(seq))


def unpack(data: bytes, at: int = 0) -> str:
    size, n = struct.unpack_from("<II", data, at)
    starts = np.frombuffer(data, "<u4", n, at + 8)
    sizes = np.frombuffer(data, "<u4", n, at + 8 + 4 * n)
    masks = struct.unpack_from("<I", data, at + 8 + 8 * n)[0]
    body = np.frombuffer(data, np.uint8, -(-size // 4), at + 16 + 8 * n + 8 * masks)
    code = np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], 1).ravel()[:size]
    out = _LETTER[code].copy()
    for a, k in zip(starts, sizes, strict=True):
        out[a : a + k] = ord("N")
    return out.tobytes().decode()


def write(names: list[str], records: list[bytes]) -> bytes:
    """A whole file of packed records."""
    at = 16 + sum(5 + len(n.encode()) for n in names)
    index = b""
    for n, r in zip(names, records, strict=True):
        index += bytes([len(n.encode())]) + n.encode() + struct.pack("<I", at)
        at += len(r)
    return struct.pack("<IIII", MAGIC, 0, len(names), 0) + index + b"".join(records)


def index(data: bytes) -> list[tuple[str, int, int]]:
    """(name, offset, length) of each sequence."""
    magic, version, n, _ = struct.unpack_from("<IIII", data)
    if (magic, version) != (MAGIC, 0):
        raise ValueError("this does not look like a 2bit file")
    out, at = [], 16
    for _ in range(n):
        k = data[at]
        name = data[at + 1 : at + 1 + k].decode()
        offset = struct.unpack_from("<I", data, at + 1 + k)[0]
        out.append((name, offset, struct.unpack_from("<I", data, offset)[0]))
        at += 5 + k
    return out


def record_head(pdf: pd.DataFrame) -> bytes:
    """What comes before the bases in a record, from the lengths and N blocks of a chromosome's coded chunks."""
    pdf = pdf.sort_values("start")
    if (pdf["n"].to_numpy()[:-1] % 4).any():
        raise ValueError("chunks must hold a multiple of four bases")
    at = np.frombuffer(b"".join(pdf["starts"]), "<i8")
    end = at + np.frombuffer(b"".join(pdf["sizes"]), "<i8")
    new = np.append(True, at[1:] != end[:-1])[: len(at)]  # a block may go on in the next chunk
    last = np.append(new[1:], True)[: len(at)]
    return record(int(pdf["n"].sum()), at[new], end[last] - at[new], b"")


def pieces(chunks: DataFrame, contigs: DataFrame) -> DataFrame:
    """(chrom_ix, start, data): records in pieces, to be put together by chromosome and start: a head (start -1) and each
    chunk's bases. Only lengths and N blocks of a chromosome come together. A chromosome without chunks has an empty record;
    all chunks but a chromosome's last must hold a multiple of four bases."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, s, seq in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n, a, k, body = coded(seq)
                yield pa.RecordBatch.from_pylist([{"chrom_ix": c, "start": s, "n": n, "starts": (a + s).astype("<i8").tobytes(), "sizes": k.astype("<i8").tobytes(), "body": body}], CODED)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chrom_ix": pdf["chrom_ix"].iloc[:1], "start": pdf["start"].iloc[:1] * 0 - 1, "data": [record_head(pdf)]})

    parts = chunks.select("chrom_ix", "start", "seq").mapInArrow(code, "chrom_ix int, start int, n int, starts binary, sizes binary, body binary")
    none = contigs.join(chunks, "chrom_ix", "left_anti").select("chrom_ix", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(b"").alias("starts"), F.lit(b"").alias("sizes"))
    heads = parts.drop("body").unionByName(none).groupBy("chrom_ix").applyInPandas(one, "chrom_ix int, start int, data binary")
    return heads.unionByName(parts.select("chrom_ix", "start", F.col("body").alias("data")))


def packed(chunks: DataFrame, contigs: DataFrame) -> DataFrame:
    """(chrom_ix, name, record): each chromosome's record as one row."""
    whole = pieces(chunks, contigs).groupBy("chrom_ix").agg(F.array_sort(F.collect_list(F.struct("start", "data"))).alias("p"))
    return whole.join(contigs.select("chrom_ix", "name"), "chrom_ix").select("chrom_ix", "name", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("record"))


def chunks_of(records: DataFrame, size: int) -> DataFrame:
    """(chrom_ix, start, seq) chunks of packed records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c, r in zip(f["chrom_ix"], f["record"], strict=True):
                seq = unpack(bytes(r))
                yield pd.DataFrame({"chrom_ix": c, "start": range(0, len(seq), size), "seq": [seq[i : i + size] for i in range(0, len(seq), size)]})

    return records.mapInPandas(run, S.CHUNKS)


# --- by range ---------------------------------------------------------------------------------

#: Chunks that a task reads, and the bytes of a file's head that are read at once.
_CHUNKS_A_TASK, _HEAD = 64, 1 << 16


def _head(f, size: int) -> list[tuple[str, int, int]]:
    """(name, offset, length) of each sequence, from the head of the file and a few bytes of each record."""
    n, at = _HEAD, None
    while at is None:
        data = f.read_at(min(n, size), 0)
        magic, version, count, _ = struct.unpack_from("<IIII", data)
        if (magic, version) != (MAGIC, 0):
            raise ValueError("this does not look like a 2bit file")
        entries, at = [], 16
        for _ in range(count):
            if at + 260 > len(data) < size:
                n, at = 4 * n, None
                break
            k = data[at]
            entries.append((data[at + 1 : at + 1 + k].decode(), struct.unpack_from("<I", data, at + 1 + k)[0]))
            at += 5 + k
    return [(name, offset, struct.unpack("<I", f.read_at(4, offset))[0]) for name, offset in entries]


@dataclass
class _Span(InputPartition):
    """Positions [lo, hi) of a sequence, lo at the beginning of a chunk."""

    chrom_ix: int
    offset: int
    lo: int
    hi: int


class TwoBitReader(DataSourceReader):
    """Chunks of a 2bit file, of some chromosomes (all: None) and of starts in [lo, hi): a task reads the bytes of its span."""

    def __init__(self, path: str, size: int, chroms: set[int] | None = None, lo: int = 0, hi: int = 1 << 62):
        self.path, self.size, self.chroms, self.lo, self.hi = path, size, chroms, lo, hi

    def partitions(self) -> list[_Span]:
        out, step = [], self.size * _CHUNKS_A_TASK
        with opened_range(self.path) as (f, size):
            for i, (_, offset, length) in enumerate(_head(f, size)):
                if self.chroms is None or i in self.chroms:
                    first = -(-self.lo // self.size) * self.size
                    top = min(length, max(first, -(-self.hi // self.size) * self.size))  # chunks that start before hi
                    out += [_Span(i, offset, a, min(a + step, top)) for a in range(first, top, step)]
        return out or [_Span(-1, 0, 0, 0)]

    def read(self, span: _Span) -> Iterator[pa.RecordBatch]:
        if span.lo >= span.hi:
            return
        with opened_range(self.path) as (f, _):
            length, n = struct.unpack("<II", f.read_at(8, span.offset))
            blocks = np.frombuffer(f.read_at(8 * n, span.offset + 8), "<u4").astype(np.int64).reshape(2, n)
            masks = struct.unpack("<I", f.read_at(4, span.offset + 8 + 8 * n))[0]
            body = span.offset + 16 + 8 * n + 8 * masks
            packed_ = np.frombuffer(f.read_at(-(-span.hi // 4) - span.lo // 4, body + span.lo // 4), np.uint8)
        code = np.stack([packed_ >> 6, packed_ >> 4 & 3, packed_ >> 2 & 3, packed_ & 3], 1).ravel()
        text = _LETTER[code[span.lo % 4 :][: span.hi - span.lo]].copy()
        ends = blocks[0] + blocks[1]
        for k in np.flatnonzero((ends > span.lo) & (blocks[0] < span.hi)):
            text[max(blocks[0, k] - span.lo, 0) : ends[k] - span.lo] = ord("N")
        yield _cut(span.chrom_ix, text.tobytes().decode(), span.lo, self.size)


class TwoBit(DataSource):
    """Spark's source of reference chunks: options path, size and, if not all are wanted, chroms, lo and hi.

    The part wanted comes as options, not as filters that Spark pushes: Spark keeps what was pushed with the relation, so a
    frame that is used again without filters, or twice in a plan, would see the filters of another use.
    """

    @classmethod
    def name(cls) -> str:
        return "twobit_chunks"

    def schema(self) -> str:
        return S.CHUNKS

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        chroms = {int(x) for x in o["chroms"].split(",") if x} if "chroms" in o else None
        return TwoBitReader(o["path"], int(o["size"]), chroms, int(o.get("lo", 0)), int(o.get("hi", 1 << 62)))


def spans_of(region: str | None) -> tuple[str | None, int, int]:
    """(name, lo, hi) of "name" or "name:start-end" (1-based, both ends in)."""
    name, _, span = (region or "").partition(":")
    a, b = map(int, span.split("-")) if span else (1, 1 << 62)
    return name or None, a - 1, b


def read(spark: SparkSession, path: str, size: int = 65536, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(contigs, chunks) of a 2bit file, or the chunks that a region touches ("name" or "name:start-end"). Where ranges of the
    file can be read, tasks read the bytes of their chunks; a compressed file, or one that only Spark can open, is read whole."""
    name, lo, hi = spans_of(region)
    if not can_range(path):
        contigs, chunks = _read_whole(spark, path, size)
        if name:
            chunks = chunks.join(contigs.where(F.col("name") == name), "chrom_ix", "left_semi").where((F.col("start") > lo - size) & (F.col("start") < hi))
        return contigs, chunks
    with opened_range(path) as (f, length):
        rows = [(i, n, k) for i, (n, _, k) in enumerate(_head(f, length))]  # one for each chromosome
    spark.dataSource.register(TwoBit)
    chunks = spark.read.format("twobit_chunks").option("path", path).option("size", size)
    if name:
        chunks = chunks.option("chroms", ",".join(str(i) for i, n, _ in rows if n == name)).option("lo", max(0, lo // size * size)).option("hi", hi)
    return spark.createDataFrame(rows, S.CONTIGS), chunks.load()


def _read_whole(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, DataFrame]:
    """read() of a file as one row."""
    content = spark.read.format("binaryFile").load(path).select("content")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for c in b.column(0):
                yield decompressed(c.as_buffer().to_pybytes())

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in files(batches):
            found = index(data)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([n for n, _, _ in found]), pa.array([k for _, _, k in found], pa.int32())], names=["chrom_ix", "name", "length"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in files(batches):
            for i, (_, offset, _) in enumerate(index(data)):
                yield _cut(i, unpack(data, offset), 0, size)

    return content.mapInArrow(names, S.CONTIGS), content.mapInArrow(texts, S.CHUNKS)


def _cut(chrom_ix: int, text: str, lo: int, size: int) -> pa.RecordBatch:
    """A text that begins at position lo, as chunks."""
    at = range(0, len(text), size)
    return pa.RecordBatch.from_arrays([pa.array([chrom_ix] * len(at), pa.int32()), pa.array([lo + a for a in at], pa.int32()), pa.array([text[a : a + size] for a in at], pa.string())], names=["chrom_ix", "start", "seq"])


def fasta_lines(chunks: DataFrame, contigs: DataFrame, region: str | None = None, width: int = 50) -> DataFrame:
    """(ord, line): FASTA of all, of "name", or of "name:start-end" (1-based, both ends in)."""
    from alleloom.sinks.wrap import region as part_of
    from alleloom.sinks.wrap import wrapped

    if region:
        name, lo, hi = spans_of(region)
        contigs = contigs.where(F.col("name") == name)
        chunks = part_of(chunks, lo, hi) if ":" in region else chunks
    return wrapped(chunks.join(contigs.select("chrom_ix", "name"), "chrom_ix"), ["chrom_ix"], width)
