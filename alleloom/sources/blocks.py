"""Files read in parts: a task takes a range of the compressed bytes and finds its records itself.

Blocked gzip consists of members of at most 64 KB that say how long they are, so reading can begin at any of them: a task
looks for the first one in its range, which another one must follow. Plain files count as blocks of fixed size. A task owns
what begins in its blocks and reads on to the end of its last record. Lines begin after a line break. Binary records (BCF,
BAM) have no marks; a place is taken as a beginning if CHAIN records in a row, or all up to the end of the file, make sense
there, which every field of fixed meaning and every length must do.

Order is by `ord`: the file's number, the block's place and the place in the block, as one rising number.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from alleloom.sources.store import located, opened_range

#: Compressed bytes of a part, bytes of a block of a plain file, and records that must make sense in a row.
STEP, PLAIN, CHAIN = 8 << 20, 60_000, 5
#: Bytes of a record at most, in the search for a beginning.
_LONGEST = 1 << 26
#: Bits of `ord` below the file's number: a file has at most 2^38 bytes.
FILE_BITS = 54
LINES = "file int, path string, ord long, line string"
#: Rows in an Arrow batch.
_BATCH = 20_000


class Blocks:
    """A file's blocks: members of blocked gzip, or pieces of a plain file."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        head = f.read_at(min(size, 1 << 16), 0)
        self.blocked = self._length(head, 0) is not None
        if head[:2] == b"\x1f\x8b" and not self.blocked:
            raise ValueError("a compressed file without blocks can't be read in parts")

    @staticmethod
    def _length(data: bytes, at: int) -> int | None:
        """The length of the member at a place, None if there is none that says so."""
        if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
            return None
        extra, p = struct.unpack_from("<H", data, at + 10)[0], at + 12
        end = p + extra
        while p + 4 <= min(end, len(data)):
            n = struct.unpack_from("<H", data, p + 2)[0]
            if data[p : p + 2] == b"BC" and n == 2 and p + 6 <= len(data):
                return struct.unpack_from("<H", data, p + 4)[0] + 1
            p += 4 + n
        return None

    def first(self, lo: int) -> int:
        """The first block that begins at lo or later; the size of the file if there is none."""
        if not self.blocked:
            return min(self.size, -(-lo // PLAIN) * PLAIN)
        if lo == 0:
            return 0
        at = lo
        while at < self.size:
            data = self.f.read_at(min(self.size - at, 1 << 18), at)
            i = data.find(b"\x1f\x8b\x08\x04")
            while 0 <= i < 1 << 17:
                n = self._length(data, i)
                if n and (at + i + n == self.size or self._length(self.f.read_at(18 + 256, at + i + n), 0)):
                    return at + i
                i = data.find(b"\x1f\x8b\x08\x04", i + 1)
            at += 1 << 17
        return self.size

    def block(self, at: int) -> tuple[bytes, int]:
        """(contents, place of the next one) of the block at a place."""
        if not self.blocked:
            data = self.f.read_at(min(PLAIN, self.size - at), at)
            return data, at + len(data)
        data = self.f.read_at(min(self.size - at, 1 << 16), at)
        n = self._length(data, 0)
        if n is None or n > len(data):
            if data[:2] != b"\x1f\x8b":
                return b"", self.size  # what follows the last member is dropped
            raise ValueError("compressed data are cut short")
        return zlib.decompressobj(31).decompress(data[:n]), at + n


class Part:
    """The contents of the blocks that begin in [lo, hi), and of later ones as they are needed."""

    def __init__(self, blocks: Blocks, lo: int, hi: int):
        self.blocks = blocks
        self.next = blocks.first(lo)
        self.begin: list[int] = []  # of blocks, in data
        self.places: list[int] = []  # of blocks, in the file
        self.data = bytearray()
        while self.next < min(hi, blocks.size):
            self.more()
        self.own = len(self.data)

    def more(self) -> bool:
        """Reads another block; False at the end of the file."""
        if self.next >= self.blocks.size:
            return False
        self.begin.append(len(self.data))
        self.places.append(self.next)
        data, self.next = self.blocks.block(self.next)
        self.data += data
        return True

    def has(self, upto: int) -> bool:
        while len(self.data) < upto:
            if not self.more():
                return False
        return True

    def ord(self, at: int) -> int:
        i = bisect.bisect_right(self.begin, at) - 1
        return (self.places[i] << 16) + at - self.begin[i]


def lines_of(part: Part, first: bool) -> Iterator[tuple[int, str]]:
    """(ord, line) of the lines that begin in the part; one that begins right after it is the part's as well."""
    at = 0
    if not first:
        at = part.data.find(b"\n", 0, part.own) + 1
        if not at:
            return
    while at <= part.own:
        end = part.data.find(b"\n", at)
        while end < 0:
            tried = len(part.data)
            if not part.more():
                break
            end = part.data.find(b"\n", tried)
        if end < 0:
            if at < len(part.data):
                yield part.ord(at), part.data[at:].decode("utf-8", "replace").rstrip("\r")
            return
        yield part.ord(at), part.data[at:end].decode("utf-8", "replace").rstrip("\r")
        at = end + 1


@dataclass
class Format:
    """A binary format: its head, how long a record is, and whether one may begin at a place.

    head(data) gives what records need and where they begin, or None if data end before; length(data, at) is a record's
    length, from its first `least` bytes; sensible(head, data, at) looks at a record's first kilobyte, or as much as there is.
    """

    least: int
    head: Callable[[bytes], tuple[object, int] | None]
    length: Callable[[bytes, int], int]
    sensible: Callable[[object, bytes, int], bool]


def _follows(part: Part, form: Format, head: object, at: int) -> bool:
    for _ in range(CHAIN):
        if at == len(part.data) and not part.more():
            return True
        if not part.has(at + form.least):
            return at == len(part.data)
        n = form.length(part.data, at)
        # the fields come first: a length that makes no sense isn't read on for
        if not form.least <= n <= _LONGEST or not part.has(at + min(n, 1024)) or not form.sensible(head, part.data, at) or not part.has(at + n):
            return False
        at += n
    return True


def records_of(blocks: Blocks, form: Format, lo: int, hi: int) -> Iterator[tuple[object, int, bytearray, int]]:
    """(head, ord, data, place in data) of the records that begin in blocks of [lo, hi)."""
    front = Part(blocks, 0, 1)
    while (found := form.head(bytes(front.data))) is None:
        if not front.more():
            raise ValueError("the file ends in its head")
    head, start = found
    while len(front.data) <= start and front.more():
        pass
    body = front.ord(start)  # where the first record begins, or the end of the file
    part = Part(blocks, lo, hi)
    at = 0
    if not part.places or part.ord(0) <= body:  # the part may hold the head, or some of it
        if not part.places or part.ord(max(part.own - 1, 0)) < body:
            return
        i = part.places.index(body >> 16) if body >> 16 in part.places else 0
        at = part.begin[i] + (body & 0xFFFF)
    else:
        while at < part.own and not _follows(part, form, head, at):
            at += 1
    while at < part.own:
        if not part.has(at + form.least) or not part.has(at + form.length(part.data, at)):
            raise ValueError("short record")
        n = form.length(part.data, at)
        yield head, part.ord(at), part.data, at
        at += n


# --- as sources of Spark ------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    file: int
    path: str
    lo: int
    hi: int


class RangeReader(DataSourceReader):
    """Files in ranges of `step` compressed bytes. rows(blocks, range, options) gives a range's Arrow batches."""

    def __init__(self, options: dict, rows: Callable[[Blocks, Range, dict], Iterator[pa.RecordBatch]]):
        self.options, self.rows = dict(options), rows
        self.paths, self.step = json.loads(options["paths"]), int(options["step"])

    def partitions(self) -> list[Range]:
        out = []
        for file, path in self.paths:
            with opened_range(path) as (_, size):
                out += [Range(file, path, a, min(a + self.step, size)) for a in range(0, max(size, 1), self.step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with opened_range(part.path) as (f, size):
            if size:
                yield from self.rows(Blocks(f, size), part, self.options)


def _line_rows(blocks: Blocks, r: Range, options: dict) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, str]] = []

    def out() -> pa.RecordBatch:
        ords, lines = zip(*held, strict=True)
        n = len(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r.file] * n, pa.int32()), pa.array([r.path] * n), pa.array([(r.file << FILE_BITS) + o for o in ords], pa.int64()), pa.array(lines, pa.string())], names=["file", "path", "ord", "line"])

    for x in lines_of(Part(blocks, r.lo, r.hi), r.lo == 0):
        held.append(x)
        if len(held) == _BATCH:
            yield out()
    if held:
        yield out()


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options, _line_rows)


def can_split(path: str) -> bool:
    """Whether a file can be read in parts: one that ranges can be read of, plain or in blocks."""
    if path == "-" or located(path) is None:
        return False
    with opened_range(path) as (f, size):
        try:
            Blocks(f, size)
        except ValueError:
            return False
    return True


def load(spark: SparkSession, source: type[DataSource], paths: list[tuple[int, str]], step: int = STEP, **options: str) -> DataFrame:
    """A source's rows of (number, path) files."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("paths", json.dumps(paths)).option("step", step).options(**options).load()


def parted(paths: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Numbered paths that can be read in parts, and the others."""
    numbered = list(enumerate(paths))
    can = {p: can_split(p) for p in set(paths)}
    return [x for x in numbered if can[x[1]]], [x for x in numbered if not can[x[1]]]
