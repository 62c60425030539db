"""Greedy blocks in parallel: a part of a chromosome as a function from where blocks may go on to where they may go on next.

A block starts at the first position that is left and takes what lies within `size`, so each start depends on the one before.
What a part of a chromosome does to that is a function all the same: given the first free place x, the next start in the
part is the first position from x on, and so forth, and out comes the first free place after the part. On integers it is
made of pieces that are constant (x lies in a gap: the block starts where the gap ends) or add a number (x lies in a
stretch). Functions of neighbouring parts are composed, in two levels of a tree, single places are handed down again, and
every part finds its own starts. Of a part's function only what can come in is kept: places less than `size` into it, so
what goes up is bounded by the positions of one block out of FAN parts, not by a chromosome's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleloom.operators.sweep import dealt, whole_groups

#: Bases of a part at least, and parts whose functions are composed at once.
PART, FAN = 1 << 20, 16
_LOW = -(1 << 62)

#: A step function: on [lo[i], lo[i + 1]) it is slope[i] * x + add[i], slopes are 0 or 1.
Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def _plain(lo: np.ndarray, slope: np.ndarray, add: np.ndarray) -> Steps:
    """Without empty pieces and without borders between equal ones."""
    keep = np.append(lo[1:] > lo[:-1], True)
    lo, slope, add = lo[keep], slope[keep], add[keep]
    new = np.append(True, (slope[1:] != slope[:-1]) | (add[1:] != add[:-1]))
    return lo[new], slope[new], add[new]


def step_of(s: np.ndarray, e: np.ndarray, size: int) -> Steps:
    """The function of stretches [s, e) (in order, apart) that together are no longer than `size`: one block at most."""
    n = len(s)
    lo = np.empty(2 * n + 1, np.int64)
    slope, add = np.ones(2 * n + 1, np.int64), np.full(2 * n + 1, size, np.int64)
    lo[0], lo[1::2], lo[2::2] = _LOW, s + 1, e
    slope[0::2], add[:-1:2], slope[-1], add[-1] = 0, s + size, 1, 0
    return _plain(lo, slope, add)


def composed(f: Steps, g: Steps, top: int) -> Steps:
    """g after f, for places below `top`."""
    (fl, fs, fa), (gl, gs, ga) = f, g
    hi = np.append(fl[1:], top)
    # a constant piece has one value; a piece that adds is cut where its values cross a border of g
    first = np.searchsorted(gl, np.where(fs == 0, fa, np.where(fl == _LOW, _LOW, fl + fa)), "right") - 1
    last = np.where(fs == 0, first, np.searchsorted(gl, hi - 1 + fa, "right") - 1)
    count = np.maximum(last - first, 0) + 1
    i = np.repeat(np.arange(len(fl)), count)
    j = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    head = np.append(True, i[1:] != i[:-1])
    lo = np.where(head, fl[i], gl[j] - fa[i])
    slope = fs[i] * gs[j]
    add = np.where(gs[j] == 1, fa[i] + ga[j], ga[j])
    keep = lo < top
    return _plain(lo[keep], slope[keep], add[keep])


def value(f: Steps, x: int) -> int:
    i = int(np.searchsorted(f[0], x, "right")) - 1
    return int(f[1][i] * x + f[2][i])


IDENTITY: Steps = (np.array([_LOW]), np.array([1]), np.array([0]))


def function_of(s: np.ndarray, e: np.ndarray, size: int, begin: int) -> Steps:
    """The function of a part's stretches, for places that can come in: those less than size after its beginning."""
    # touching stretches are one, and stretches are cut where windows of `size` begin
    new = np.append(True, s[1:] > np.maximum.accumulate(e)[:-1])
    s, e = s[new], np.maximum.reduceat(e, np.flatnonzero(new))
    n = (e - 1 - begin) // size - (s - begin) // size + 1
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    window = np.repeat((s - begin) // size, n) + k
    lo, hi = np.maximum(np.repeat(s, n), begin + window * size), np.minimum(np.repeat(e, n), begin + (window + 1) * size)
    out = IDENTITY
    edge = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(window)], strict=True):
        out = composed(out, step_of(lo[a:b], hi[a:b], size), begin + size)
    return out


def starts_of(s: np.ndarray, e: np.ndarray, size: int, free: int) -> np.ndarray:
    """The starts of blocks in stretches (in order), given the first free place."""
    out, i = [], 0
    reach = np.maximum.accumulate(e)
    while True:
        i += int(np.searchsorted(reach[i:], free, "right"))  # the first stretch that ends after it
        if i >= len(s):
            return np.concatenate([np.zeros(0, np.int64), *out])
        own = np.arange(max(int(s[i]), free), int(e[i]), size)
        if len(own):
            out.append(own)
            free = int(own[-1]) + size
        else:
            i += 1


# --- in Spark -----------------------------------------------------------------------------------

_FUNCTION = "chrom_ix int, part int, lo binary, slope binary, add binary"


def _packed(chrom: int, part: int, f: Steps) -> dict:
    return {"chrom_ix": chrom, "part": part, "lo": f[0].astype("<i8").tobytes(), "slope": f[1].astype("<i8").tobytes(), "add": f[2].astype("<i8").tobytes()}


def _unpacked(r: dict) -> Steps:
    return tuple(np.frombuffer(r[c], "<i8").astype(np.int64) for c in ("lo", "slope", "add"))


_PACKED = pa.schema([("chrom_ix", pa.int32()), ("part", pa.int32()), ("lo", pa.binary()), ("slope", pa.binary()), ("add", pa.binary())])
_ENTRY = pa.schema([("chrom_ix", pa.int32()), ("part", pa.int32()), ("free", pa.int64())])


def cut_at_parts(stretches: DataFrame, width: int) -> DataFrame:
    """(chrom_ix, part, s, e): stretches cut where parts of `width` begin, dealt out by part, in order."""
    cut = stretches.where("e > s").select("chrom_ix", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("part"))
    lo, hi = F.greatest(F.col("s").cast("long"), F.col("part") * width), F.least(F.col("e").cast("long"), (F.col("part") + 1) * width)
    return _dealt(cut.select(F.col("chrom_ix").cast("int").alias("chrom_ix"), F.col("part").cast("int").alias("part"), lo.alias("s"), hi.alias("e")))


def _dealt(parts: DataFrame) -> DataFrame:
    return dealt(parts, "chrom_ix", "part").sortWithinPartitions("chrom_ix", "part", "s")


def greedy_starts_of(stretches: DataFrame, size: int, part: int | None = None) -> DataFrame:
    """(chrom_ix, block): the starts of greedy blocks of `size` over the positions of stretches (chrom_ix, s, e)."""
    width = max(part or PART, size)

    def walk(t: pa.Table, free: int) -> pa.RecordBatch:
        at = starts_of(t["s"].to_numpy(), t["e"].to_numpy(), size, free)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t["chrom_ix"][0].as_py(), np.int32)), pa.array(at.astype(np.int32))], names=["chrom_ix", "block"])

    # what can come into a part lies less than `size` in it
    return stepped(cut_at_parts(stretches, width), lambda s, e, k: function_of(s, e, size, k * width), walk, "chrom_ix int, block int", lambda group: group * FAN * width + size)


def kept_blocks(blocks: DataFrame, part: int | None = None) -> DataFrame:
    """Of blocks (chrom_ix, s, e, ...; no two of one start) those that start at or after the end of the last kept one."""
    width = part or PART

    def function(s: np.ndarray, e: np.ndarray, _: int) -> Steps:
        after = np.maximum(np.searchsorted(s, e, "left"), np.arange(len(s)) + 1)
        out = np.append(e, 0)
        for i in range(len(s) - 1, -1, -1):
            if after[i] < len(s):
                out[i] = out[after[i]]
        slope = np.append(np.zeros(len(s), np.int64), 1)
        return _plain(np.concatenate([[_LOW], s + 1]), slope, out)

    def walk(t: pa.Table, free: int) -> pa.RecordBatch:
        stays = []
        for s, e in zip(t["s"].to_pylist(), t["e"].to_pylist(), strict=True):
            stays.append(s >= free)
            free = e if s >= free else free
        return pa.RecordBatch.from_struct_array(t.drop_columns(["part", "free"]).filter(pa.array(stays, pa.bool_())).to_struct_array().combine_chunks())

    parts = blocks.withColumn("part", F.floor(F.col("s") / width).cast("int")).withColumns({c: F.col(c).cast("long") for c in ("s", "e")})
    order = ["chrom_ix", "part", "s", "e", *(c for c in blocks.columns if c not in ("chrom_ix", "s", "e"))]
    parts = _dealt(parts.select(*order))
    return stepped(parts, function, walk, parts.drop("part").schema, lambda _: 1 << 62)


def stepped(parts: DataFrame, function: Callable[[np.ndarray, np.ndarray, int], Steps], walk: Callable[[pa.Table, int], pa.RecordBatch], schema, top: Callable[[int], int]) -> DataFrame:
    """walk() of every part (chrom_ix, part, s, e, ...), given the first free place that function() of the parts before it
    leads to; of a group's function the places below top(group) count."""
    columns = parts.columns

    def groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
        """The rows of each part."""
        for t in whole_groups(batches, 2, least):
            chrom, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, (chrom[1:] != chrom[:-1]) | (part[1:] != part[:-1]))), t.num_rows)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield t.slice(a, b - a)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            chrom, part = t.column(0)[0].as_py(), t.column(1)[0].as_py()
            yield pa.RecordBatch.from_pylist([_packed(chrom, part, function(t.column(2).to_numpy(), t.column(3).to_numpy(), part))], _PACKED)

    def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
        for t in whole_groups(batches, keys, 1):
            key = lambda r: tuple(r[n] for n in t.column_names[:keys])  # noqa: B023, E731
            for _, own in groupby(t.to_pylist(), key):
                yield list(own)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in grouped(batches, 2):
            f = IDENTITY
            for r in own:
                f = composed(f, _unpacked(r), top(r["group"]))
            yield pa.RecordBatch.from_pylist([_packed(own[0]["chrom_ix"], own[0]["group"], f)], _PACKED)

    def down(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
        """The first free place of each of a group's parts; the group's own comes first, as part -1, or is the lowest."""
        for own in grouped(batches, keys):
            free, out = _LOW, []
            for r in own:
                if r["part"] < 0:
                    free = r["free"]
                    continue
                out.append({"chrom_ix": r["chrom_ix"], "part": r["part"], "free": free})
                free = value(_unpacked(r), free)
            yield pa.RecordBatch.from_pylist(out, _ENTRY)

    entry = "chrom_ix int, part int, free long"
    order = ("chrom_ix", "group", "part")
    leaf = parts.select(*columns[:4]).mapInArrow(functions, _FUNCTION).withColumn("group", F.floor(F.col("part") / FAN).cast("int")).select(*order, "lo", "slope", "add")
    nodes = leaf.repartition("chrom_ix", "group").sortWithinPartitions(*order).mapInArrow(together, _FUNCTION)
    # a chromosome's groups: one function for each, of which one place is looked up
    tops = nodes.repartition("chrom_ix").sortWithinPartitions("chrom_ix", "part").mapInArrow(lambda b: down(b, 1), entry)
    handed = tops.select("chrom_ix", F.col("part").alias("group"), F.lit(-1).alias("part"), *(F.lit(None).cast("binary").alias(c) for c in ("lo", "slope", "add")), "free")
    both = leaf.withColumn("free", F.lit(None).cast("long")).unionByName(handed)
    entries = both.repartition("chrom_ix", "group").sortWithinPartitions(*order).mapInArrow(lambda b: down(b, 2), entry)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            yield walk(t, t["free"][0].as_py())

    met = parts.join(entries, ["chrom_ix", "part"]).select(*columns, "free")
    return met.sortWithinPartitions("chrom_ix", "part", "s").mapInArrow(walked, schema)
