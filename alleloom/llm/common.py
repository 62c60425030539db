"""Helpers shared by the operators: shared storage, byte-level word tables, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_WORD = 48
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
#: Bytes of text that the numpy passes hold at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21


# --- shared storage -------------------------------------------------------------------------


#: Spark's own setting by which the shuffle files of a query go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a local one if Spark runs in one
    process, as in tests; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    What the query that fills the table has shuffled is not needed once the table is there, so Spark drops it then.
    """
    return _written(df, _path(df.sparkSession, name))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str = "t") -> Iterator[DataFrame]:
    """written() of df, deleted at the end: for a table that is read several times, by what is written before then."""
    path = _path(df.sparkSession, name)
    try:
        yield _written(df, path)
    finally:
        _deleted(df.sparkSession, path)


def _deleted(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has written in the shared folder; results that still read them are lost."""
    _deleted(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The place of rows without id in the order of documents.
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a row's place in the order (_doc) and a digest of its text (_tag), which tells apart rows of one id."""
    return docs.withColumn("_doc", F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn("_tag", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


# --- words ----------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, bytes, offsets of rows + end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if texts.type == pa.large_string() else texts.cast(pa.binary()).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ([^\\x20\\x09-\\x0D]+ within a row) as (row, start, end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = edges[edges > 0] - 1
    last[ends] = word[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as (row, start, end, 64-bit hash of the bytes)."""
    if lower:
        data = _LOWER[data]
    row, start, end = spans(data, offsets)
    if not len(row):
        return row, start, end, np.zeros(0, np.uint64)
    length = end - start
    h = mix(length.astype(np.uint64) * _M1)
    live = np.flatnonzero(length <= _LONG_WORD)
    at, left, acc = start[live], length[live], h[live]
    order = np.argsort(-left, kind="stable")
    live, at, left, acc = live[order], at[order], left[order], acc[order]
    counts = len(left) - np.searchsorted(left[::-1], np.arange(1, _LONG_WORD + 1), "left")
    for k in range(_LONG_WORD):
        m = int(counts[k])
        if not m:
            break
        acc[:m] = (acc[:m] ^ data[at[:m] + k]) * _M3
        acc[:m] ^= acc[:m] >> np.uint64(29)
    h[live] = mix(acc)
    for i in np.flatnonzero(length > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return row, start, end, h


def windows(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words starting at each word; the second array marks those within one row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    acc = np.full(m, np.uint64(n * int(_M1) & 0xFFFFFFFFFFFFFFFF))
    for k in range(n):
        acc = (acc ^ h[k : k + m]) * _M2
        acc ^= acc >> np.uint64(32)
    return mix(acc), row[:m] == row[n - 1 :]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of values as a binary column."""
    size = values.dtype.itemsize
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * size, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def runs_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by key: tables that hold whole groups; many small groups come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)) for k in key]
        # the start of the batch's last group
        cut = b.num_rows - 1
        last = [c[cut] for c in cols]
        lo, hi = 0, cut
        while lo < hi:
            mid = (lo + hi) // 2
            if all(c[mid].equals(x) for c, x in zip(cols, last, strict=True)):
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield pa.Table.from_batches([*held, b.slice(0, lo)])
            held = []
        elif held:
            h = held[-1]
            if not all(h.column(h.schema.get_field_index(k))[h.num_rows - 1].equals(x) for k, x in zip(key, last, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
        held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


# --- connected components -------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in an edge.

    Alternating large-star and small-star rounds: each round links a vertex's neighbours to the smallest of them, so
    the depth falls geometrically and no vertex's neighbours are ever gathered in one row. Rounds end in written tables.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    before = None
    for step in range(201):
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if sums == before or not sums[0]:
            break
        if step == 200:  # a depth that falls geometrically is gone long before
            raise RuntimeError("components are not settled after 200 rounds")
        before = sums
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = written(small, "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
