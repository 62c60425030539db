"""Substring deduplication by level-wise doubling.

A window is `window` consecutive words of one document. It is repeated if its words also start in a document with a
smaller id. Levels run from short windows to `window` words (13: 7, 13; 50: 7, 13, 25, 50), and in `passages` on to twice,
four times, ... that: a level's window is two windows of the level before, end to end or (odd lengths) sharing a word, and
it is looked at only where both of these are repeated. Levels end at `window`, in `passages` when no candidate survives.

A level in Spark: texts are dealt by hash into shards of about `SHARD_BYTES`, whose words are numbered, so a window's place
is one number. A shard sorts the hashes of its candidate windows. What it can settle alone, it settles: of equal windows
of several documents only those of the shard's smallest one are still asked about. Questions go by hash to buckets of
about `BUCKET` windows, one row per bucket and shard, and so do not grow with the number of documents that share a window:
a passage that a third of all documents have is one question of each shard. A bucket answers with places, by shard.

Rows per bucket and shard would be the square of the corpus. Beyond `DIRECT` buckets, questions go by way of a cell, which
is a group of shards and a group of buckets, each about the square root of their number: a shard has a row for each group
of buckets, a cell settles what its shards can tell each other (of a window that all have, one question goes on) and has a
row for each of its buckets. Answers return by way of such cells. A row so holds hundreds of windows at any size.

Short levels only have to lose nothing: their questions are 32 bits within a bucket, and the number of buckets grows with
the number of words. From `window` words on, windows are told apart by 128 bits.

Defined results: null is a text without words; shorter texts than a window lose nothing; a null id comes after all
others, so it is never the smaller one; rows of one id do not remove each other's words; repeated rows give repeated rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleloom.llm.common import LAST, mix, runs_of, spans, text_slices, windows, words, written

#: Bytes of text in a shard, windows in a bucket, and the fewest words of a first level.
SHARD_BYTES = 6 << 20
BUCKET = 1 << 21
#: Buckets up to which shards have a row for each: with more, a row would have less than about a hundred windows.
DIRECT = 1 << 13
LEAST = 7
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def levels(window: int, least: int = LEAST) -> list[int]:
    """Window lengths, each at most twice the one before, up to `window`."""
    out = [window]
    while (half := -(-out[0] // 2)) >= least:
        out.insert(0, half)
    return out


# --- numbers in few bytes ---------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, all second ones, ...; equal bytes in a row cost a shuffle little."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(data: pa.BinaryScalar, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(data.as_buffer(), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _rising(x: np.ndarray, kind: str) -> bytes:
    x = x.astype(kind)
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _risen(data: pa.BinaryScalar, kind: str) -> np.ndarray:
    return np.cumsum(_numbers(data, kind), dtype=kind)


# --- shards -----------------------------------------------------------------------------------

_TEXTS = "shard int, kind int, _doc long, _tag long, block binary"


#: Shards or buckets for a task at most; beyond the session's shuffle partitions, their number follows that of the parts.
PARTS_A_TASK = 8


def _dealt(rows: DataFrame, by: str, parts: int) -> DataFrame:
    """rows by their part, in tasks as large as the session has them, or of PARTS_A_TASK parts if these are smaller."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(by) if parts <= PARTS_A_TASK * tasks else rows.repartition(-(-parts // PARTS_A_TASK), by)


class Shards:
    """Texts dealt into shards, and how many buckets there are."""

    def __init__(self, docs: DataFrame, window: int, key: str, text: str, shard_bytes: int, bucket: int, direct: int = DIRECT):
        size = F.octet_length(text)
        total = docs.agg(F.sum(size)).first()[0] or 0
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = lambda size: -(-total // size)
        # of tables smaller than that, as many parts as tasks can take, if there is anything to do for each
        self.shards = max(1, parts(shard_bytes), min(tasks, parts(shard_bytes >> 5)))
        # a word and the space after it take two bytes at least; most take more, so buckets are rather small than large
        self.buckets = max(1, parts(4 * bucket), min(tasks, parts(bucket >> 1)))
        self.route = Route(self.shards, self.buckets, direct)
        long = F.coalesce(size >= 2 * window - 1, F.lit(False))
        doc, tag = F.coalesce(F.col(key).cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
        known = docs.select(doc.alias("_doc"), tag.alias("_tag"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), long.alias("long"))
        self.long, self.short = known.where("long"), known.where("not long")

    def rows(self, marks: DataFrame | None, whole: bool = False) -> DataFrame:
        """(shard, kind, _doc, _tag, block, text[, row]), shard by shard: the marks, then the texts by document."""
        keep = ["text", "row"] if whole else ["text"]
        at = F.pmod(F.xxhash64("_doc", "_tag"), F.lit(self.shards)).cast("int").alias("shard")
        out = self.long.select(at, F.lit(1).alias("kind"), "_doc", "_tag", F.lit(None).cast("binary").alias("block"), *keep)
        if marks is not None:
            later = F.when(F.col("later"), 1).otherwise(0).cast("long").alias("_doc")
            out = out.unionByName(marks.select("shard", F.lit(0).alias("kind"), later, F.lit(None).cast("long").alias("_tag"), "block"), allowMissingColumns=True)
        return _dealt(out, "shard", self.shards).sortWithinPartitions("shard", "kind", "_doc", "_tag")

    def rest(self) -> DataFrame:
        """rows() of the texts that are too short for a window."""
        return self.short.select(F.lit(0).alias("shard"), F.lit(1).alias("kind"), "_doc", "_tag", F.lit(None).cast("binary").alias("block"), "text", "row")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Pieces of batches sorted by shard and kind: (shard, whether they are texts, rows)."""
    for b in batches:
        if b.num_rows:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in itertools.pairwise([0, *at.tolist(), b.num_rows]):
                yield int(shard[lo]), bool(kind[lo]), b.slice(lo, hi - lo)


def _fresh(b: pa.RecordBatch, before: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int]]:
    """Which rows are not the same document and text as the row before them."""
    doc, tag = b.column(2).to_numpy(), b.column(3).to_numpy()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    new[0] = (doc[0], tag[0]) != before
    return new, (doc[-1], tag[-1])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, marked places, documents of its texts, text of each word, hash of each word); a repeated row counts once."""
    for shard, parts in itertools.groupby(_parts(batches), key=lambda p: p[0]):
        marks, docs, row, hashes, n, before = [], [], [], [], 0, None
        for _, texts, b in parts:
            if not texts:
                marks += [_risen(x, "<u4") for x in b.column(4)]
                continue
            new, before = _fresh(b, before)
            docs.append(b.column(2).to_numpy()[new])
            for first, data, offsets in text_slices(b.column(5).filter(pa.array(new))):
                r, _, _, h = words(data, offsets)
                row.append(r + (n + first))
                hashes.append(h)
            n += int(new.sum())
        if n:
            yield shard, marks, np.concatenate(docs), np.concatenate(row), np.concatenate(hashes)


# --- a level ------------------------------------------------------------------------------------

#: Questions (to >= 0: a cell or bucket) or what is settled (to < 0: a shard). `of`: the shard of each place, where a row has
#: places of several shards; else all are of `shard`.
_ASKED = "to long, shard int, later boolean, of binary, block binary, h binary, h2 binary, doc binary"
_ARROW = pa.schema([("to", pa.int64()), ("shard", pa.int32()), ("later", pa.bool_()), ("of", pa.binary()), ("block", pa.binary()), ("h", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary())])
#: The place of a window that is known to be repeated, and asked about only for others.
_KNOWN = np.uint32(0xFFFFFFFF)
#: Rows and bytes of a batch of questions at most, but for its last row.
_ROWS, _BYTES = 512, 1 << 23


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (to, shard, later, of, block, h, h2, doc), of which the last ones may be left out, as batches."""
    held, size = [], 0
    for r in itertools.chain(rows, [None]):
        if r is not None:
            held.append(r + (None,) * (len(_ARROW) - len(r)))
            size += sum(len(x) for x in r[3:] if x)
        if held and (r is None or len(held) == _ROWS or size >= _BYTES):
            cols = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0


class Route:
    """Where questions and answers go: straight, or by way of cells if there are more than `direct` buckets."""

    def __init__(self, shards: int, buckets: int, direct: int):
        self.buckets, self.cells = buckets, buckets > direct
        # shards and buckets of a group, and the number of groups of buckets
        self.wide, self.deep = max(1, round(shards**0.5)), max(1, round(buckets**0.5))
        self.across = -(-buckets // self.deep)
        self.parts = -(-shards // self.wide) * self.across

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def cell(self, shard: int | np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return shard // self.wide * self.across + bucket // self.deep


def _settled(shard: np.ndarray, at: np.ndarray, later: bool) -> Iterator[tuple]:
    """Rows of places that are settled, one for each shard."""
    order = np.lexsort((at, shard))
    shard, at = shard[order], at[order]
    for lo, hi in itertools.pairwise([*_groups(shard)[0].tolist(), len(at)]):
        yield -1 - int(shard[lo]), int(shard[lo]), later, None, _rising(at[lo:hi], "<u4")


def _asked(to: np.ndarray, shard: int | np.ndarray, at: np.ndarray, h: np.ndarray, h2: np.ndarray | None, doc: np.ndarray | None, whole: bool) -> Iterator[tuple]:
    """Rows of questions, one for each `to`, which rises with h; whole: with all of a hash, not with what buckets need."""
    kind = "<u8" if whole or h2 is not None else "<u4"
    h, at = h.astype(kind), at.astype("<u4")
    one = not isinstance(shard, np.ndarray)
    for lo, hi in itertools.pairwise([*_groups(to)[0].tolist(), len(to)]):
        of = None if one else _planes(shard[lo:hi].astype("<i4"))
        more = () if h2 is None else (_planes(h2[lo:hi]), _planes(doc[lo:hi]))
        yield int(to[lo]), shard if one else -1, False, of, _planes(at[lo:hi]), _rising(h[lo:hi], kind), *more


def _candidates(marks: list[np.ndarray], n: int, step: int) -> np.ndarray | slice:
    """Windows of which both halves, `step` words apart, are marked."""
    marked = np.zeros(n + step, bool)
    for m in marks:
        marked[m] = True
    return np.flatnonzero(marked[:n] & marked[step : n + step])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of groups of equal sorted keys, and each one's group."""
    head = np.zeros(len(keys[0]), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(head), np.cumsum(head) - 1


def _questions(length: int, before: int | None, route: Route, exact: bool, firsts: bool):
    """What the shards settle and ask about windows of `length` words; before: the length of the level before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard, marks, docs, row, hashes in _shards(batches):
            h, ok = windows(row, hashes, length)
            at = np.flatnonzero(ok)
            if before is not None:
                c = _candidates(marks, len(h), length - before)
                at = c[ok[c]]
            if not len(at):
                continue
            h, h2 = h[at], None
            if exact:
                h2 = windows(row, mix(hashes ^ _OTHER), length)[0][at]
                order = np.lexsort((h2, h))
                h, h2, at = h[order], h2[order], at[order]
                begin, group = _groups(h, h2)
            else:
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                begin, group = _groups(h)
            # within a group places rise, and so do documents
            doc = docs[row[at]]
            shared = (doc[np.append(begin[1:], len(doc)) - 1] != doc[begin])[group]
            if exact:
                later = doc > doc[begin][group]
                yield from _settled(np.full(int(later.sum()), shard), at[later], True)
                if firsts:
                    own = shared & ~later
                    yield from _settled(np.full(int(own.sum()), shard), at[own], False)
                ask = ~later
                h2, doc = h2[ask], doc[ask]
            else:
                yield from _settled(np.full(int(shared.sum()), shard), at[shared], False)
                ask = ~shared
                ask[begin], at[begin] = True, np.where(shared[begin], _KNOWN, at[begin])
                doc = None
            h, to = h[ask], route.bucket(h[ask])
            yield from _asked(route.cell(shard, to) if route.cells else to, shard, at[ask], h, h2, doc, route.cells)

    return lambda batches: _batches(rows(batches))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows by `to`: (to, all of its rows), or of what is settled (-1, rows of several shards)."""
    for t in runs_of(batches, ["to"]):
        t = t.combine_chunks()
        to = t.column("to").to_numpy()
        if settled := int(np.searchsorted(to, 0)):
            yield -1, t.slice(0, settled)
        edges = [settled + x for x in _groups(to[settled:])[0].tolist()] if settled < len(to) else []
        for lo, hi in itertools.pairwise([*edges, len(to)]):
            yield int(to[lo]), t.slice(lo, hi - lo)


def _places(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shard, place) of a table's rows, one after another."""
    at = [_numbers(x, "<u4") for x in t.column("block")]
    of = zip(t.column("shard").to_pylist(), t.column("of"), at, strict=True)
    return np.concatenate([_numbers(o, "<i4") if o.is_valid else np.full(len(a), s, np.int32) for s, o, a in of]), np.concatenate(at)


def _met(t: pa.Table, exact: bool, firsts: bool, whole: bool) -> tuple[list[tuple[np.ndarray, np.ndarray, bool]], tuple]:
    """What the questions of several shards say of each other: settled (shards, places, later), and what is still to be
    asked (shard, place, h, h2, doc), by h."""
    shard, at = _places(t)
    column = lambda name, read, kind: np.concatenate([read(x, kind) for x in t.column(name)])
    if exact:
        h, h2, doc = column("h", _risen, "<u8"), column("h2", _numbers, "<u8"), column("doc", _numbers, "<i8")
        order = np.lexsort((doc, h2, h))
        h, h2, doc, shard, at = h[order], h2[order], doc[order], shard[order], at[order]
        start, group = _groups(h, h2)
        later = doc > doc[start][group]
        out = [(shard[later], at[later], True)]
        if firsts:
            several = (doc[np.append(start[1:], len(doc)) - 1] != doc[start])[group] & ~later
            out.append((shard[several], at[several], False))
        return out, (shard[~later], at[~later], h[~later], h2[~later], doc[~later])
    h = column("h", _risen, "<u8" if whole else "<u4")
    order = np.lexsort((shard, h))
    h, shard, at = h[order], shard[order], at[order]
    start, group = _groups(h)
    several = (shard[np.append(start[1:], len(h)) - 1] != shard[start])[group]
    hit = several & (at != _KNOWN)
    ask, places = ~several, at.copy()
    # of a window that is settled here one question goes on, for the others of its kind
    ask[start], places[start] = True, np.where(several[start], _KNOWN, at[start])
    return [(shard[hit], at[hit], False)], (shard[ask], places[ask], h[ask], None, None)


def _relayed(route: Route, exact: bool, firsts: bool):
    """Questions of cells: what their shards settle among themselves, and the rest by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for to, t in _tables(batches):
            if to < 0:
                yield from zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True)
                continue
            settled, (shard, at, h, h2, doc) = _met(t, exact, firsts, True)
            for of, places, later in settled:
                yield from _settled(of, places, later)
            yield from _asked(route.bucket(h), shard, at, h, h2, doc, False)

    return lambda batches: _batches(rows(batches))


def _answers(route: Route, exact: bool, firsts: bool):
    """Answers to the questions of all shards, bucket by bucket; what was settled before passes through."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for to, t in _tables(batches):
            if to < 0:
                yield from zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True)
                continue
            for shard, at, later in _met(t, exact, firsts, False)[0]:
                if not route.cells:
                    yield from _settled(shard, at, later)
                    continue
                cell = route.cell(shard, np.full(len(shard), to))
                order = np.lexsort((at, shard, cell))
                cell, shard, at = cell[order], shard[order], at[order]
                for lo, hi in itertools.pairwise([*_groups(cell)[0].tolist(), len(cell)]):
                    yield int(cell[lo]), -1, later, _planes(shard[lo:hi].astype("<i4")), _planes(at[lo:hi].astype("<u4"))

    return lambda batches: _batches(rows(batches))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers that came by way of cells, by shard."""

    def rows() -> Iterator[tuple]:
        for to, t in _tables(batches):
            if to < 0:
                yield from zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True)
                continue
            for later in (False, True):
                part = t.filter(pc.equal(t.column("later"), later))
                if part.num_rows:
                    yield from _settled(*_places(part), later)

    return _batches(rows())


def _level(texts: Shards, marks: DataFrame | None, length: int, before: int | None, exact: bool, firsts: bool = False) -> DataFrame:
    """Marks of the windows of `length` words; exact: repeated by a smaller document (and, with firsts, what these repeat)."""
    route = texts.route
    by = lambda rows, parts: _dealt(rows, "to", parts + texts.shards).sortWithinPartitions("to", "shard")
    out = texts.rows(marks).mapInArrow(_questions(length, before, route, exact, firsts), _ASKED)
    if route.cells:
        out = by(out, route.parts).mapInArrow(_relayed(route, exact, firsts), _ASKED)
    out = by(out, texts.buckets).mapInArrow(_answers(route, exact, firsts), _ASKED)
    if route.cells:
        out = by(out, route.parts).mapInArrow(_returned, _ASKED)
    return written(out.select("shard", "later", "block"), f"windows-{length}")


def repeated(texts: Shards, window: int, least: int = LEAST, firsts: bool = False) -> DataFrame:
    """Marks of the windows that a smaller document has too, reached level by level."""
    marks, before = None, None
    for length in levels(window, least):
        marks = _level(texts, marks, length, before, length == window, firsts)
        before = length
    return marks


# --- results ------------------------------------------------------------------------------------


def deduplicated(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", least: int = LEAST, new: tuple[str, ...] = ("n_words", "n_removed", "kept_words", "kept_text"), shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET, direct: int = DIRECT) -> DataFrame:
    """docs with `new`, some of n_words, n_removed, kept_words (joined by a space) and kept_text (layout kept): what is left
    without repeated windows. Columns of docs of these names are replaced."""
    texts = Shards(docs, window, key, text, shard_bytes, bucket, direct)
    keep = [c for c in docs.columns if c not in new]
    schema = docs.select([F.col(f"`{c}`") for c in keep]).schema
    for c in new:
        schema = schema.add(c, "long" if c[:2] == "n_" else "string")
    cut = _cut(window, keep, new, text)
    return texts.rows(repeated(texts, window, least), True).mapInArrow(cut, schema).unionByName(texts.rest().mapInArrow(cut, schema))


def _cut(window: int, keep: list[str], new: tuple[str, ...], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in itertools.groupby(_parts(batches), key=lambda p: p[0]):
            blocks, marks, n, start, before = [], None, 0, 0, None
            for _, is_text, b in parts:
                if not is_text:
                    later = b.column(2).to_numpy() > 0
                    blocks += [_risen(x, "<u4") for x, y in zip(b.column(4), later, strict=True) if y]
                    continue
                if marks is None:
                    marks = np.unique(np.concatenate(blocks)).astype(np.int64) if blocks else np.zeros(0, np.int64)
                fresh, before = _fresh(b, before)
                got: dict[str, list] = {c: [] for c in new}
                for first, data, offsets in text_slices(b.column(5)):
                    row, begin, _ = spans(data, offsets)
                    edge = np.searchsorted(row, np.arange(len(offsets)), "left")
                    for i in range(len(offsets) - 1):
                        count = int(edge[i + 1] - edge[i])
                        if fresh[first + i]:
                            start, n = n, n + count
                        lo, hi = np.searchsorted(marks, [start, start + count])
                        raw = data[offsets[i] : offsets[i + 1]].tobytes()
                        stays = None
                        if hi > lo:
                            step = np.zeros(count + 1, np.int64)
                            at = marks[lo:hi] - start
                            step[at] += 1
                            np.add.at(step, np.minimum(at + window, count), -1)
                            stays = np.cumsum(step[:-1]) == 0
                        _left(got, raw, count, stays, begin[edge[i] : edge[i + 1]] - offsets[i])
                cols = [b.column(5) if k == text else b.column(6).field(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(got[c], pa.int64()) if c[:2] == "n_" else pa.array(got[c], pa.binary()).cast(pa.string()) for c in new)], names=[*keep, *new])

    return run


def _left(got: dict[str, list], raw: bytes, count: int, stays: np.ndarray | None, begin: np.ndarray) -> None:
    """Adds what is left of a text to the columns that are wanted."""
    if "n_words" in got:
        got["n_words"].append(count)
    if "n_removed" in got:
        got["n_removed"].append(0 if stays is None else count - int(stays.sum()))
    if "kept_words" in got:
        parts = raw.split()
        got["kept_words"].append(b" ".join(parts if stays is None else itertools.compress(parts, stays.tolist())))
    if "kept_text" in got:
        got["kept_text"].append(raw if stays is None else _layout(raw, stays, begin))


def _layout(raw: bytes, stays: np.ndarray, begin: np.ndarray) -> bytes:
    """raw without the words that go and the white space after each."""
    edge = np.append(begin, len(raw))
    out = [raw[: edge[0]]]
    flip = np.flatnonzero(np.diff(stays.astype(np.int8), prepend=0, append=0))
    for a, z in zip(flip[::2], flip[1::2], strict=True):
        out.append(raw[edge[a] : edge[z]])
    return b"".join(out).strip()


def digests(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """deduplicated() with kept_words as its digest only."""
    out = deduplicated(docs.select(key, text), window, key, text, new=("n_words", "n_removed", "kept_words"), **sizes)
    return out.select(key, "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def passages(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", least: int = LEAST, shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET, direct: int = DIRECT) -> DataFrame:
    """(_doc, _tag, start, n, length): runs of n repeated windows of window, 2 * window, 4 * window, ... words, from word
    `start` on; lengths double until no candidate survives."""
    texts = Shards(docs, window, key, text, shard_bytes, bucket, direct)
    marks, length, found = repeated(texts, window, least, True), window, []
    while not marks.isEmpty():
        runs = texts.rows(marks).mapInArrow(_runs, "_doc long, _tag long, start int, n int")
        found.append(runs.withColumn("length", F.lit(length)))
        marks, length = _level(texts, marks, 2 * length, length, True, True), 2 * length
    if not found:
        return docs.sparkSession.createDataFrame([], "_doc long, _tag long, start int, n int, length int")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows marked as later ones, as runs of places within their texts."""
    for _, parts in itertools.groupby(_parts(batches), key=lambda p: p[0]):
        blocks, marks, n, start, before = [], None, 0, 0, None
        for _, is_text, b in parts:
            if not is_text:
                later = b.column(2).to_numpy() > 0
                blocks += [_risen(x, "<u4") for x, y in zip(b.column(4), later, strict=True) if y]
                continue
            if marks is None:
                marks = np.unique(np.concatenate(blocks)).astype(np.int64) if blocks else np.zeros(0, np.int64)
            fresh, before = _fresh(b, before)
            doc, tag, out = b.column(2).to_numpy(), b.column(3).to_numpy(), []
            for first, data, offsets in text_slices(b.column(5)):
                edge = np.searchsorted(spans(data, offsets)[0], np.arange(len(offsets)), "left")
                for i in range(len(offsets) - 1):
                    if fresh[first + i]:
                        start, n = n, n + int(edge[i + 1] - edge[i])
                    lo, hi = np.searchsorted(marks, [start, start + edge[i + 1] - edge[i]])
                    at = marks[lo:hi] - start
                    if len(at):
                        new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                        out += [(doc[first + i], tag[first + i], a, z) for a, z in zip(at[new], np.diff(np.append(new, len(at))), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_doc", "_tag", "start", "n"])


#: digests() with 13 words in DuckDB.
SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
x as (select doc_id, unnest(range(1, len(w) - 11)) p, w from d where len(w) >= 13),
k as (select doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') s from x),
f as (select s, min(doc_id) m from k group by 1),
c as (select distinct doc_id, unnest(range(p, p + 13)) i from k join f using (s) where m < doc_id),
e as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from d),
g as (select e.doc_id, count(*) n_words, count(c.i) n_removed, coalesce(string_agg(case when c.i is null then e.word end, ' ' order by e.i), '') kept from e left join c on c.doc_id = e.doc_id and c.i = e.i group by 1)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join g using (doc_id)
"""
