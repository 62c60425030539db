"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are words. A document longer than the largest capacity is cut into pieces of that capacity and a rest; full
pieces are bins of their own. The other pieces are dealt by hash into shards of a bounded number of pieces, and each
shard is packed best-fit decreasing: a piece goes to the open bin that it leaves the least room in; where none has room,
a bin of the capacity with the least cost for each word it is expected to hold is opened (what is left in the shard and
fits bounds that expectation). At the end each bin shrinks to the least permitted capacity that holds its contents.

Rows are numbered when their lengths are written down; the numbers, not the ids, tell rows apart and deal pieces to shards,
so a null or repeated id that a third of all rows have is dealt like any other.

Defined results: a document without words (null, empty, white space) gets one piece of length 0 without bin; repeated
rows are separate documents; an empty table gives an empty result; piece numbers and offsets count from 0.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleloom.llm.common import written

CAPACITIES = (256, 512, 1024, 2048)
#: The cost of a sequence besides its positions.
OVERHEAD = 32
SHARD_PIECES = 25_000
WORD = r"[^\x20\x09-\x0D]+"
OUT = "doc_id long, row long, piece int, start long, length int, bin_id string, capacity int, position int"


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing over one shard: for each length (1..max capacity) its bin, offset; and each bin's capacity."""
    caps = sorted(capacities)
    top = caps[-1]
    order = np.argsort(-lengths, kind="stable")
    count = np.bincount(lengths, minlength=top + 1) if len(lengths) else np.zeros(top + 1, int)
    # words left in pieces of at most each length, kept as a Fenwick tree
    tree = [0] * (top + 1)
    for n in range(1, top + 1):
        i, v = n, int(count[n]) * n
        while v and i <= top:
            tree[i] += v
            i += i & -i
    room: list[list[int]] = [[] for _ in range(top + 1)]
    free = 0
    fill: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened: list[int] = []
    for i in order:
        n = int(lengths[i])
        j = n
        while j <= top:
            tree[j] -= n
            j += j & -j
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            best = None
            for c in caps[bisect.bisect_left(caps, n) :]:
                j, rest = c - n, 0
                while j:
                    rest += tree[j]
                    j &= j - 1
                price = (c + overhead) / min(c, n + rest)
                if best is None or price < best[0]:
                    best = (price, c)
            b, r = len(fill), best[1]
            fill.append(0)
            opened.append(r)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        r -= n
        if r:
            room[r].append(b)
            free |= 1 << r
    return where, offset, np.array([caps[bisect.bisect_left(caps, f)] for f in fill], np.int64)


def pieces(docs: DataFrame, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, row, piece, start, length): documents cut where they exceed the capacity."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    counted = written(docs.select(F.col(key).cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    last = F.greatest((F.col("n") + capacity - 1).cast("long") / capacity, F.lit(1)).cast("int") - 1
    cut = counted.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "row", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("length"))


def packed(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, shard_pieces: int = SHARD_PIECES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: its document and that one's number, words [start, start + length), bin, the bin's capacity and the piece's place in it."""
    top = max(capacities)
    all_pieces = pieces(docs, top, text, key)
    whole = all_pieces.where(F.col("length") == top)
    none = all_pieces.where("length = 0")
    rest = all_pieces.where((F.col("length") > 0) & (F.col("length") < top))
    shards = max(1, -(-rest.count() // shard_pieces))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    caps, cost = tuple(capacities), overhead

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        where, offset, size = pack(pdf["length"].to_numpy(), caps, cost)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "bin_id": [f"{s}-{b}" for s, b in zip(pdf["shard"], where, strict=True)], "capacity": size[where] if len(where) else [], "position": offset})

    got = rest.groupBy("shard").applyInPandas(shard, OUT)
    alone = whole.select("doc_id", "row", "piece", "start", "length", F.concat(F.lit("w"), F.col("row").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), F.lit(top).alias("capacity"), F.lit(0).alias("position"))
    empty = none.select("doc_id", "row", "piece", "start", "length", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("position"))
    return got.unionByName(alone).unionByName(empty)
