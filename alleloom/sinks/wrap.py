"""Texts in lines: chunks of a text, in order, as FASTA lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wrapped(texts: DataFrame, keys: list[str], width: int = 50) -> DataFrame:
    """(keys, ord, line) of texts (keys, name, start, seq): a header for each, then lines of `width` letters.

    Chunks wrap alone: what precedes a chunk is a sum over the lengths of a text's chunks, so each knows its line and column.
    Lines within a chunk come out whole; of those that cross chunks, the parts are put together.
    """
    n = len(keys)
    lengths = texts.select(*keys, "start", F.length("seq").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    at = lengths.select(*keys, "start", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))  # a number for each chunk
    placed = texts.select(*keys, "start", "seq").join(at, [*keys, "start"]).select(*keys, "offset", "seq")
    schema = placed.select(*keys).schema.add("ord", "integer").add("column", "integer").add("line", "string").add("whole", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (offset, seq) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)):
                column = offset % width
                cuts = [0, *range(width - column, len(seq), width)]
                lines = [seq[x:y] for x, y in zip(cuts, [*cuts[1:], len(seq)], strict=True) if y > x]
                if not lines:
                    continue
                m = len(lines)
                columns = pa.array([column] + [0] * (m - 1), pa.int32())
                own = [pa.array([b.column(k)[i].as_py()] * m, b.schema.field(k).type) for k in range(n)]
                ords = pa.array(range(offset // width + 1, offset // width + 1 + m), pa.int32())
                yield pa.RecordBatch.from_arrays([*own, ords, columns, pa.array(lines, pa.string()), pa.array([len(x) == width for x in lines])], names=[*b.schema.names[:n], "ord", "column", "line", "whole"])

    pieces = placed.mapInArrow(run, schema)
    parts = F.sort_array(F.collect_list(F.struct("column", "line")))
    crossing = pieces.where("not whole").groupBy(*keys, "ord").agg(F.array_join(parts["line"], "").alias("line"))
    heads = texts.groupBy(*keys).agg(F.concat(F.lit(">"), F.first("name")).alias("line")).select(*keys, F.lit(0).alias("ord"), "line")
    return heads.unionByName(pieces.where("whole").select(*keys, "ord", "line")).unionByName(crossing)


def region(chunks: DataFrame, lo: int, hi: int) -> DataFrame:
    """The part [lo, hi) of chunked texts: only chunks that it touches are read further."""
    near = chunks.where((F.col("start") < hi) & (F.col("start") + F.length("seq") > lo))
    first = F.greatest(F.lit(lo) - F.col("start"), F.lit(0))
    part = F.substr("seq", (first + 1).cast("int"), (F.least(F.lit(hi) - F.col("start"), F.length("seq")) - first).cast("int"))
    return near.withColumn("seq", part)
