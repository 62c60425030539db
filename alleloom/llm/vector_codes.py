"""Vector codes: product quantisation whose nearest entries are screened in float32 and settled in whole numbers.

Vectors become whole numbers (floor(SCALE * x)) and are cut into `parts` equal parts. A part's nearest codebook entry is
the one of the least squared distance, ties to the lower index. One float32 matrix product for each part and batch gives
all distances but for rounding; a bound on the rounding error of each (inner products of n terms in any order err by at most
g(n) = n u / (1 - n u) times the sum of the terms' sizes, which the product of the two norms bounds; numbers beyond 2^24
err by u once more when they become float32) makes them intervals. Entries whose interval reaches below the smallest upper
end are evaluated again in int64, exactly, and the least of these, or the first of several, is taken. So codes, errors and
codebooks are exact, whatever the order of sums.

Codebooks start as the parts of the first `entries` vectors by id. A round assigns all parts and replaces every entry by the
floor of its parts' mean: tasks add up sums and counts by part and entry, so what is shuffled and what the driver gets is
bounded by the codebooks' size times the number of tasks, and by the codebooks' size.

Defined results: vectors that are null, that hold null or non-finite components, or components too large for exact 64-bit
distances (see `bound`) are dropped, as are vectors of another length than the one with the smallest id; if the length is no
multiple of `parts`, zeros are added at the end, which change no distance. Fewer vectors than entries make shorter
codebooks. A null id comes last; rows of one id are told apart by their vectors. Entries that no part is nearest to stay.
Equal labels are summed together, null labels too. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alleloom.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Unit roundoff of float32, and a factor that covers the rounding of the bounds themselves, which are float64.
_U = 2.0**-24
_SLACK = 1 + 2.0**-40
#: Vectors that are screened at once: so many times the entries make a matrix of a few MB.
_ROWS = 8192


def bound(size: int) -> int:
    """The largest component, in whole numbers, with which distances of vectors of that length stay below 2^62."""
    return int((2.0**62 / max(size, 1)) ** 0.5 / 2)


def whole(column: pa.Array, scale: int = SCALE, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components as whole numbers) of the vectors in a list column that can be used, those of each length
    together, or those of one length only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    begin, n = column.offsets.to_numpy()[:-1].astype(np.int64), np.diff(column.offsets.to_numpy())
    there = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    known = values.is_valid().to_numpy(zero_copy_only=False)
    x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    for k in np.unique(n[there]) if size is None else [size]:
        rows = np.flatnonzero(there & (n == k)) if k else np.zeros(0, np.int64)
        if len(rows):
            at = begin[rows][:, None] + np.arange(k)
            v = np.floor(scale * x[at])
            ok = known[at].all(1) & (np.abs(v) <= bound(int(k))).all(1)  # not of nan and infinity
            if ok.any():
                yield rows[ok], v[ok].astype(np.int64)


@dataclass
class Book:
    entries: np.ndarray  # parts x entries x components of a part, int64

    @property
    def size(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# --- nearest entries --------------------------------------------------------------------------


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |x - c|^2 - |x|^2 for all rows of x and of c (int64), from one float32 product.

    Of x c' the computed value differs from the true one by at most g(n + 2) |x| |c|: n for the products and sums in any
    order, 2 for x and c becoming float32. |c|^2 and the sum of both are float64 and err by 2^-52 of their sizes at most.
    """
    n = x.shape[1]
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    norm = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(1)) * _SLACK
    sizes = norm(x)[:, None] * norm(c)[None, :]
    cc = (c * c).sum(1).astype(np.float64)
    g = (n + 2) * _U / (1 - (n + 2) * _U)
    middle = cc[None, :] - 2 * product
    error = (2 * g * sizes + 2.0**-50 * (cc[None, :] + 2 * sizes)) * _SLACK
    return middle - error, middle + error


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance) of each row of x, and how many entries were evaluated exactly."""
    low, high = intervals(x, c)
    row, entry = np.nonzero(low <= high.min(1)[:, None])  # the best one's own interval is among them
    d = ((x[row] - c[entry]) ** 2).sum(1)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    least = np.minimum.reduceat(d, begin) if len(begin) else d
    hits = np.flatnonzero(d == np.repeat(least, np.diff(np.append(begin, len(row)))))
    first = hits[np.append(True, row[hits[1:]] != row[hits[:-1]])[: len(hits)]]  # entries rise within a row
    return entry[first], least, len(row)


def _parts(x: np.ndarray, book_size: int, parts: int) -> np.ndarray:
    """Vectors as parts x vectors x components; zeros fill the last part."""
    x = np.pad(x, ((0, 0), (0, parts * book_size - x.shape[1])))
    return np.ascontiguousarray(x.reshape(len(x), parts, book_size).transpose(1, 0, 2))


# --- codebooks --------------------------------------------------------------------------------


def smallest(vectors: DataFrame, key: str, vector: str, count: int, scale: int = SCALE, size: int | None = None) -> list[list[int]]:
    """The first `count` vectors that can be used, by id, then by their numbers. Every batch names its own first ones, and
    those that share the last one's id; `count` of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in whole(b.column(1), scale, size):
                ids = b.column(0).take(pa.array(rows))
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
                if len(order) > count:
                    last = ids[int(order[count - 1])]
                    more = ids.is_null() if not last.is_valid else pc.equal(ids, last).fill_null(False)
                    order = np.union1d(order[:count], np.flatnonzero(more.to_numpy(zero_copy_only=False)))
                lists = pa.ListArray.from_arrays(np.arange(len(order) + 1, dtype=np.int32) * x.shape[1], pa.array(x[order].ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(order)), lists], names=["id", "x"])

    two = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    told = two.mapInArrow(run, two.select("id").schema.add("x", T.ArrayType(T.LongType())))
    return [r["x"] for r in told.orderBy(F.asc_nulls_last("id"), "x").limit(count).collect()]


def refined(vectors: DataFrame, vector: str, book: Book, length: int, scale: int = SCALE) -> Book:
    """The codebooks after one round."""
    parts, entries, size = book.entries.shape
    sent = vectors.sparkSession.sparkContext.broadcast(book.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for _, whole_ in whole(b.column(0), scale, length):
                for at in range(0, len(whole_), _ROWS):
                    for p, x in enumerate(_parts(whole_[at : at + _ROWS], size, parts)):
                        code, _, _ = nearest(x, c[p])
                        np.add.at(total[p], code, x)
                        count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * size, pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums], names=["part", "entry", "n", "sums"])

    told = vectors.select(vector).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("sums"))
    new = book.entries.copy()
    for r in each.collect():  # one row for each entry of the codebooks at most
        new[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return Book(new)


def coded(vectors: DataFrame, vector: str, book: Book, length: int, scale: int = SCALE) -> DataFrame:
    """The vectors that can be used with `code` (two hex digits for each part) and `error` (squared distances, summed over the parts)."""
    keep = [c for c in vectors.columns if c not in ("code", "error")]
    schema = vectors.select([F.col(f"`{c}`") for c in keep]).schema.add("code", "string").add("error", "long")
    parts, _, size = book.entries.shape
    sent = vectors.sparkSession.sparkContext.broadcast(book.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for rows, whole_ in whole(b.column(b.schema.get_field_index(vector)), scale, length):
                for at in range(0, len(rows), _ROWS):
                    own = pa.array(rows[at : at + _ROWS])
                    codes, error = np.zeros((len(own), parts), np.uint8), np.zeros(len(own), np.int64)
                    for p, x in enumerate(_parts(whole_[at : at + _ROWS], size, parts)):
                        codes[:, p], d, _ = nearest(x, c[p])
                        error += d
                    text, width = codes.tobytes().hex(), 2 * parts
                    yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(own) for k in keep), pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(error)], names=[*keep, "code", "error"])

    return vectors.mapInArrow(run, schema)


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Book]:
    """vectors that can be used, with code and error, and the codebooks; at most 256 entries, as a code has two digits."""
    if not 0 < entries <= 256:
        raise ValueError("codebooks hold 1 to 256 entries")
    first = smallest(vectors, key, vector, 1, scale)
    if not first:
        book, length = Book(np.zeros((parts, 0, 1), np.int64)), 0
    else:
        length = len(first[0])
        x = np.array(smallest(vectors, key, vector, entries, scale, length), np.int64)
        book = Book(_parts(x, -(-length // parts), parts))
        for _ in range(rounds):
            book = refined(vectors, vector, book, length, scale)
    return coded(vectors, vector, book, length, scale), book


# --- the query --------------------------------------------------------------------------------


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of a label's vectors together) and the codebooks' digest."""
    done, book = compressed(vectors.select("vec_id", "embedding", "label"))
    rows = written(done.select("vec_id", "label", "code", "error"), "codes")
    # one row for each label, combined before the shuffle; a table, so Spark can split a label that holds many of the rows
    labels = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    met = rows.join(labels.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    return f"""select vec_id, part, any_value(v) v, arg_min(entry, d * {ENTRIES} + entry) entry, min(d) d from (
  select x.vec_id, x.part, x.v, b.entry, cast(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) d from x join {book} b on x.part = b.part) group by 1, 2"""


def _book_sql(before: str, assigned: str) -> str:
    return f"""select c.part, c.entry, coalesce(m.v, c.v) v from {before} c left join (
  select part, entry, list(cast(floor(s / n) as bigint) order by i) v from (
    select part, entry, i, sum(v[i]) s, cast(count(*) as double) n from {assigned}, (select unnest(range(1, k + 1)) i from dim) group by 1, 2, 3) group by 1, 2) m on m.part = c.part and m.entry = c.entry"""


#: The same over all of a table whose vec_ids are distinct.
SQL = f"""with e as (select vec_id, label, list_transform(embedding, lambda v: cast(floor(256 * cast(v as double)) as bigint)) q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0),
dim as (select cast(len(q) // {PARTS} as bigint) k from e limit 1),
x as materialized (select vec_id, part, list_slice(q, part * k + 1, (part + 1) * k) v from e, dim, (select unnest(range({PARTS})) part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 entry, v from x qualify row_number() over (partition by part order by vec_id) <= {ENTRIES}),
a1 as materialized ({_assigned("c0")}),
c1 as materialized ({_book_sql("c0", "a1")}),
a2 as materialized ({_assigned("c1")}),
c2 as materialized ({_book_sql("c1", "a2")}),
a3 as materialized ({_assigned("c2")}),
r as (select vec_id, string_agg(printf('%02x', cast(entry as int)), '' order by part) code, cast(sum(d) as bigint) error from a3 group by 1),
l as (select e.label, cast(sum(r.error) as bigint) label_error from r join e using (vec_id) group by 1)
select r.vec_id, r.code, r.error, l.label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) from c2) codebooks_sha256
from r join e using (vec_id) join l on l.label is not distinct from e.label"""
