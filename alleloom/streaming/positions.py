"""Positions as a stream: growing folders of point calls, summed by tumbling blocks of positions.

Calls that come in any order: sums by fixed blocks are kept as state by (chromosome, block) and handed out as they change
(`block_counts`). Calls in order: greedy blocks are handed out as they close, and disorder is an error (`closed_blocks`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alleloom.operators.greedy import starts_of
from alleloom.operators.merge import point_calls

SCHEMA = "sample_ix int, chrom_ix int, pos int, code int"


def stream_calls(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of point calls from a folder of Parquet files."""
    r = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def block_counts(calls: DataFrame, size: int) -> DataFrame:
    """Allele counts by block, change and sample of a batch or a stream of point calls."""
    c = point_calls(calls.withColumnRenamed("pos", "run_start")).withColumn("block", F.floor(F.col("pos") / size).cast("int"))
    return c.groupBy("chrom_ix", "block", "alt", "sample_ix").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_alt").alias("n_alt"), F.count("*").alias("n"))


# --- greedy blocks, in order --------------------------------------------------------------------

BLOCKS = "chrom_ix int, block long, n long, n_pos long, n_ref long, n_alt long"
_STATE = "block long, n long, n_pos long, n_ref long, n_alt long, last long, ended boolean"


def closed_blocks(calls: DataFrame, size: int) -> DataFrame:
    """Greedy blocks of a stream of point calls, each handed out once, when it closes.

    Calls (chrom_ix, pos, n_ref, n_alt; more columns go unread) come ordered by position within a chromosome from one
    trigger to the next; within a trigger any order will do. A block starts at the first position that is left and takes
    what lies within `size`; it closes when a position beyond it comes, or when a row without a position says that the
    chromosome is at its end. A position before the last trigger's last one, or any row after the end, is an error that
    stops the stream. State is one open block a chromosome; a task holds three numbers for each call of a chromosome in
    one trigger, whose size the source's options bound (maxFilesPerTrigger, maxBytesPerTrigger).

    Rows without a chromosome are a chromosome of their own; n_ref and n_alt that are null count 0. The same rows as the
    batch's greedy blocks (operators/stats.py), for any division into triggers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chrom = key[0]
        held = [(f["pos"].isna().any(), f.loc[f["pos"].notna(), ["pos", "n_ref", "n_alt"]].fillna(0).to_numpy(np.int64)) for f in frames]
        end, x = any(e for e, _ in held), np.concatenate([c for _, c in held])
        x = x[np.argsort(x[:, 0], kind="stable")]
        block, *sums, last, ended = state.get if state.exists else (None, 0, 0, 0, 0, None, False)
        if len(x) and last is not None and x[0, 0] < last or ended:
            raise ValueError(f"chromosome {chrom}: " + ("rows come after its end" if ended else f"position {x[0, 0]} comes after {last}"))
        if len(x):
            pos = x[:, 0]
            new = np.append(last is None or pos[0] != last, pos[1:] != pos[:-1])
            starts = starts_of(pos, pos + 1, size, int(pos[0]) if block is None else block + size)
            cut = np.append(np.searchsorted(pos, starts), len(x))  # what comes before the first new start is the open block's
            total = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(np.column_stack([np.ones(len(x), np.int64), new, x[:, 1:]]), 0)])
            at = [block, *starts.tolist()] if block is not None else starts.tolist()
            edge = np.append(0, cut) if block is not None else cut
            of = total[edge[1:]] - total[edge[:-1]]
            of[0] += np.array(sums, np.int64)
            last = int(pos[-1])
        else:
            at, of = ([block], np.array([sums], np.int64)) if block is not None else ([], np.zeros((0, 4), np.int64))
        shut = len(at) if end else len(at) - 1
        if end or not at:
            state.update((None, 0, 0, 0, 0, last, end))
        else:
            state.update((at[-1], *of[-1].tolist(), last, False))
        if shut > 0:
            yield pd.DataFrame({"chrom_ix": pd.array([chrom] * shut, "Int32"), "block": at[:shut], **{c: of[:shut, i] for i, c in enumerate(("n", "n_pos", "n_ref", "n_alt"))}})

    rows = calls.select("chrom_ix", F.col("pos").cast("long").alias("pos"), F.col("n_ref").cast("long").alias("n_ref"), F.col("n_alt").cast("long").alias("n_alt"))
    return rows.groupBy("chrom_ix").applyInPandasWithState(step, BLOCKS, _STATE, "append", GroupStateTimeout.NoTimeout)
