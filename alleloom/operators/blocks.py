"""Tumbling blocks of positions and their pseudo-haplotypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.operators.sweep import whole_groups


def tumbling_blocks(variants: DataFrame, size: int) -> DataFrame:
    """`block` is the number of the window [i * size, (i + 1) * size); empty windows do not appear."""
    return variants.withColumn("block", F.floor(F.col("pos") / size).cast("int"))


_LETTERS = np.frombuffer(f"{S.BASES}N".encode(), np.uint8)
_SMASHED = "chrom_ix int, block int, pos int, alt int, bases string, known boolean"


def _smashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chrom_ix, block, pos, alt, ref, calls) with each sample's two bases, N where it is missing, and whether all are called."""
    for b in batches:
        if not b.num_rows:
            continue
        alt = b.column(3).to_numpy(zero_copy_only=False).astype(int)
        ref = b.column(4).fill_null(4).to_numpy(zero_copy_only=False).astype(int)
        ref = np.where((ref >= 0) & (ref < 4), ref, 4)
        other = np.where((ref < 4) & (alt < 4), ref ^ np.minimum(alt, 3), 4)
        r, v = _LETTERS[ref][:, None], _LETTERS[other][:, None]
        flat = b.column(5).flatten()
        n_ref, n_alt = (flat.field(k).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in ("n_ref", "n_alt"))
        none = (n_ref == 0) & (n_alt == 0)
        first = np.where(none, ord("N"), np.where(n_ref == 0, v, r))
        second = np.where(none, ord("N"), np.where(n_alt == 0, r, v))
        both = np.stack([first, second], 2).astype(np.uint8).reshape(b.num_rows, -1)
        bases = [row.tobytes().decode() for row in both]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bases, pa.string()), pa.array(~none.any(1) & (ref < 4))], names=["chrom_ix", "block", "pos", "alt", "bases", "known"])


#: Bases of a tile: a block's variants there, by individuals, are turned together.
TILE = 65536


def haplotype_tiles(variants: DataFrame, n_samples: int, tile: int = TILE) -> DataFrame:
    """(chrom_ix, block, tile, line_no, piece, n, known) from wide variants with ref: each tile of variants by individuals is
    turned where it is, and gives a piece of every line; n of its variants are in it, known of them called in every sample."""
    rows = variants.select("chrom_ix", F.col("block").cast("int").alias("block"), F.col("pos").cast("int").alias("pos"), F.col("alt").cast("int").alias("alt"), F.col("ref").cast("int").alias("ref"), "calls").mapInArrow(_smashed, _SMASHED)
    dealt = rows.select("chrom_ix", "block", F.floor(F.col("pos") / tile).cast("int").alias("tile"), "pos", "alt", "bases", "known")
    names = ["chrom_ix", "block", "tile", "line_no", "piece", "n", "known"]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3, 1 << 14):
            keys = [t.column(i).to_numpy() for i in range(3)]
            new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            edge = np.append(np.flatnonzero(new), t.num_rows)
            bases, known = t["bases"].combine_chunks(), t["known"].to_numpy(zero_copy_only=False)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                letters = np.frombuffer("".join(bases.slice(lo, hi - lo).to_pylist()).encode(), np.uint8).reshape(hi - lo, 2 * n_samples)
                pieces = [x.tobytes().decode() for x in np.ascontiguousarray(letters.T)]
                m = len(pieces)
                numbers = [np.full(m, k[lo], np.int32) for k in keys] + [np.arange(m, dtype=np.int32)]
                counts = [np.full(m, x, np.int64) for x in (hi - lo, int(known[lo:hi].sum()))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(pieces, pa.string()), *map(pa.array, counts)], names=names)

    order = ("chrom_ix", "block", "tile")
    return dealt.repartition(*order).sortWithinPartitions(*order, "pos", "alt").mapInArrow(turned, "chrom_ix int, block int, tile int, line_no int, piece string, n long, known long")


def haplotype_lines(variants: DataFrame, n_samples: int, min_informative: float = 90.0, tile: int = TILE) -> DataFrame:
    """(chrom_ix, block, enough, line_no, line): two lines a sample, of one base a variant in order, put together from tiles.

    enough: at least min_informative percent of the block's variants are called in every sample. A row holds a line of a
    block, never all of a block's individuals.
    """
    pieces = F.sort_array(F.collect_list(F.struct("tile", "piece")))
    g = haplotype_tiles(variants, n_samples, tile).groupBy("chrom_ix", "block", "line_no").agg(pieces.alias("x"), F.sum("n").alias("n"), F.sum("known").alias("known"))
    return g.select("chrom_ix", "block", (F.col("known") * 100 >= F.col("n") * min_informative).alias("enough"), "line_no", F.array_join("x.piece", "").alias("line"))
