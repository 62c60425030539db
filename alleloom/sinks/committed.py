"""One file out of many tasks: a data source whose tasks write parts and whose commit joins them.

Rows come sorted by all columns but the last, `data`, whose bytes go one after another. Every task writes its bytes to a
part of its own as they come and reports the part's name, size and first key; no row goes to the driver. When all tasks are
done, the commit puts head and parts one after another, copying by pieces of 4 MB, and moves the file into place, so a
reader sees a whole file or none. Attempts that failed or were repeated leave parts that no report names; they go with the
folder of parts, as do all parts if the job fails.

Parts lie in spark.checkpoint.dir, which driver and executors share, or, where that is not set, beside the file.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_PIECE = 4 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Part(WriterCommitMessage):
    """What a task reports: its part's name, size and first key (None: no rows), and bytes by the key's first column, if
    the head needs them."""

    name: str
    size: int
    first: tuple | None
    sums: dict[int, int] = field(default_factory=dict)


def twobit_head(names: list[str], sizes: dict[int, int]) -> bytes:
    """A 2bit file's head: the sequences' names and where their records begin."""
    fixed = 16 + sum(5 + len(n.encode()) for n in names)
    at = accumulate([fixed, *(sizes.get(i, 0) for i in range(len(names)))])
    from alleloom.sources.twobit import MAGIC

    offsets = [o for o, _ in zip(at, names, strict=False)]
    if offsets and offsets[-1] >= 1 << 32:
        raise ValueError("a 2bit file's records must begin within 4 GB")
    return struct.pack("<IIII", MAGIC, 0, len(names), 0) + b"".join(bytes([len(n.encode())]) + n.encode() + struct.pack("<I", o) for n, o in zip(names, offsets, strict=True))


class JoinedWriter(DataSourceArrowWriter):
    """Writes the parts of one file and joins them."""

    def __init__(self, path: str, parts: str, head: bytes, names: list[str] | None, compress: bool):
        self.path, self.parts, self.head, self.names, self.compress = path, parts, head, names, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        where, at = _place(self.parts)
        name, out, first, sums = uuid.uuid4().hex, None, None, {}
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/{name}", buffer_size=_PIECE) as raw:
            for b in iterator:
                if not b.num_rows:
                    continue
                if first is None:
                    first = tuple(c[0].as_py() for c in b.columns[:-1])
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.compress else raw
                for row in b.column(b.num_columns - 1):
                    if row.is_valid:
                        out.write(row.as_buffer())
                if self.names is not None:
                    for k, row in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1), strict=True):
                        sums[k] = sums.get(k, 0) + len(row.as_buffer())
            if self.compress and out is not None:
                out.close()
            size = raw.tell()
        return Part(name, size, first, sums)

    def commit(self, messages: list[Part | None]) -> None:
        where, at = _place(self.parts)
        to, path = _place(self.path)
        told = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.first)
        head = self.head
        if self.names is not None:
            sums: dict[int, int] = {}
            for m in told:
                for k, n in m.sums.items():
                    sums[k] = sums.get(k, 0) + n
            head = twobit_head(self.names, sums)
        unready = f"{path}.{uuid.uuid4().hex}"
        try:
            with to.open_output_stream(unready) as out:
                out.write(gzip.compress(head, mtime=0) if self.compress else head)
                for m in told:
                    copied = 0
                    with where.open_input_stream(f"{at}/{m.name}") as part:
                        while piece := part.read(_PIECE):
                            out.write(piece)
                            copied += len(piece)
                    if copied != m.size:
                        raise OSError(f"a part of {self.path} has {copied} bytes of {m.size}")
            to.move(unready, path)
        except BaseException:
            if to.get_file_info(unready).type == fs.FileType.File:
                to.delete_file(unready)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        where, at = _place(self.parts)
        if where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)


class Joined(DataSource):
    """Options: path, parts (their folder), head (hex), names (JSON: a 2bit head is made of them), compress."""

    @classmethod
    def name(cls) -> str:
        return "joined_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return JoinedWriter(o["path"], o["parts"], bytes.fromhex(o.get("head", "")), json.loads(o["names"]) if "names" in o else None, o.get("compress") == "true")


def write_joined(rows: DataFrame, path: str, head: bytes = b"", names: list[str] | None = None, compress: bool = False) -> None:
    """Writes column `data` (binary, the last) of rows, in the order of the columns before it, as one file after `head`.

    names: the head is a 2bit file's, for these sequences; the first column is then a sequence's index. The columns that
    order must not be null. No rows: just the head.
    """
    spark = rows.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    parts = f"{shared.rstrip('/')}/parts-{uuid.uuid4().hex}" if shared else f"{path}.parts-{uuid.uuid4().hex}"
    spark.dataSource.register(Joined)
    w = rows.orderBy(*rows.columns[:-1]).write.format("joined_parts").mode("append").option("path", str(path)).option("parts", parts).option("head", head.hex()).option("compress", str(compress).lower())
    (w if names is None else w.option("names", json.dumps(names))).save()
