"""Compressed input, by its first bytes rather than its name."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decompressed(data: bytes) -> bytes:
    """gzip and blocked gzip, member after member; what follows the last member is dropped. Other data as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        part = d.decompress(data) + d.flush()
        if not d.eof:
            raise ValueError("compressed data are cut short")
        out.append(part)
        data = d.unused_data
    # members may themselves hold compressed data
    return decompressed(b"".join(out))


@lru_cache(maxsize=1)
def stdin() -> bytes:
    """All of standard input, which can be read once: a command looks at a file's head before its body."""
    return sys.stdin.buffer.read()


def opened(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    """(file, path, content): whole files; file is the place of its path among those given. The path - is standard input."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    piped = lambda: spark.createDataFrame([("-", bytearray(stdin()))], "path string, content binary")
    files = [(piped() if p == "-" else reader.load(p)).select(F.lit(i).alias("file"), "path", "content") for i, p in enumerate(paths)]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, path, ord, line) of text files, compressed or not; (file, path, ord) is the order of paths and lines.

    A file is one row of the scan and one task reads it: a compressed file can't be split.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for file, path, content in zip(f["file"], f["path"], f["content"], strict=True):
                text = decompressed(bytes(content)).decode("utf-8", "replace").splitlines()
                for i in range(0, len(text), 50_000):
                    part = text[i : i + 50_000]
                    yield pd.DataFrame({"file": file, "path": path, "ord": range(i, i + len(part)), "line": part})

    return opened(spark, paths).mapInPandas(run, "file int, path string, ord long, line string")


def split_lines(spark: SparkSession, paths: list[str], step: int | None = None) -> DataFrame:
    """(file, path, ord, line) as lines(), but plain files and those in blocks are read in parts; ord rises over all files
    and says nothing else."""
    from alleloom.sources import blocks

    split, whole = blocks.parted(paths)
    parts = [blocks.load(spark, blocks.Lines, split, step or blocks.STEP)] if split else []
    for i, p in whole:
        parts.append(lines(spark, [p]).select(F.lit(i).alias("file"), "path", (F.lit(i << blocks.FILE_BITS) + F.col("ord")).alias("ord"), "line"))
    return reduce(DataFrame.unionByName, parts)
