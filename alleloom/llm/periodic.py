"""Periodic runs: stretches of words that repeat themselves with a period, found by probing a harmonic grid.

A run of period q is a stretch of consecutive words, q words apart identical, of at least max(LEAST, TIMES * q) words, that
no neighbouring word extends; q is its smallest period. For every period p the grid 0, p, 2p, ... is probed: word jp against
word (j + 1)p. A run of TIMES periods holds TIMES - 1 grid points in a row whose probes are equal, so only those places, all
periods together n ln n of them, are looked at again: a survivor is extended to both sides by comparing growing chunks of
the words with themselves p words on. Grid points within a run that is already found are skipped: those of the same
period, and those of a period that divides p, whose run has period p as well and would only be found again.

Texts go through in slices of 2 MB of whole texts (a longer text is a slice of its own), sorted by their number of words and
separated by numbers that occur once, so that one pass over a slice probes a period in all texts that are long enough for
it. Words are compared by number; the numbers come from 64-bit hashes whose equality is verified byte by byte.

Defined results: null and empty texts have no words and no runs, and their kept text is empty; other columns go along;
`new` names the two columns that come in addition (columns of these names are replaced); repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alleloom.llm.common import text_slices, words

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words in the first and in the largest chunk that are compared at once.
_CHUNK, _CHUNKS = 64, 1 << 16
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


# --- words as numbers -------------------------------------------------------------------------


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    to = np.cumsum(length) - length
    return data[np.repeat(start - to, length) + np.arange(int(length.sum()))]


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for every word, equal if and only if the bytes are. Hashes propose, bytes decide: every word is compared with
    the first one of its hash; if two unlike words ever share a hash, the words themselves are numbered."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    length = end - start
    like = first[number]
    if (length == length[like]).all() and np.array_equal(_gathered(data, start, length), _gathered(data, start[like], length)):
        return number.astype(np.int64)
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start, end, strict=True)], np.int64)


# --- runs -------------------------------------------------------------------------------------


def _reach(v: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The widest stretch [a, b) around x within which v[i] equals v[i + p], by chunks that grow."""
    b, size, top = x + 1, _CHUNK, len(v) - p
    while b < top:
        n = min(size, top - b)
        unlike = v[b : b + n] != v[b + p : b + p + n]
        k = int(unlike.argmax())
        if unlike[k]:
            b += k
            break
        b, size = b + n, min(2 * size, _CHUNKS)
    a, size = x, _CHUNK
    while a > 0:
        n = min(size, a)
        unlike = (v[a - n : a] != v[a - n + p : a + p])[::-1]
        k = int(unlike.argmax())
        if unlike[k]:
            a -= k
            break
        a, size = a - n, min(2 * size, _CHUNKS)
    return a, b


def _uncovered(at: np.ndarray, p: int, found: dict[int, tuple[list[int], list[int]]]) -> np.ndarray:
    """The grid points that lie in no run of a period that divides p and reaches p words on."""
    for d, (starts, ends) in found.items():
        if not len(at):
            break
        if p % d == 0:
            i = np.searchsorted(starts, at, "right") - 1
            at = at[(i < 0) | (at + p >= np.asarray(ends)[np.maximum(i, 0)])]
    return at


def periodic(v: np.ndarray, tops: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in v, by period, then start.

    v holds texts from the longest on, each followed by a number that occurs once; tops[p - 1] is how much of v belongs to
    texts of at least TIMES * p words.
    """
    out: list[tuple[int, int, int]] = []
    found: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for p, top in enumerate(tops.tolist(), 1):
        grid = v[:top:p]
        same = grid[1:] == grid[:-1]
        held = same[: len(same) - TIMES + 2].copy()
        for k in range(1, TIMES - 1):
            held &= same[k : len(same) - TIMES + 2 + k]
        at = np.flatnonzero(held) * p
        if not len(at):
            continue
        # the words between the first and the last of these grid points repeat as well
        at = at[(v[at + p // 2] == v[at + p // 2 + p]) & (v[at + p - 1] == v[at + 2 * p - 1])]
        b = 0
        for x in _uncovered(at, p, found).tolist():
            if x < b:
                continue
            a, b = _reach(v[:top], x, p)
            if b + p - a >= max(LEAST, TIMES * p):
                out.append((a, b + p - a, p))
                starts, ends = found[p]
                starts.append(a)
                ends.append(b + p)
    return out


def _runs(number: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of texts whose words are number[begin[i]:begin[i + 1]], in order of text,
    start and period."""
    count = np.diff(begin)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] >= LEAST]
    n = count[order]
    to = np.cumsum(n + 1) - (n + 1)  # where each text begins in v
    v = np.empty(int((n + 1).sum()), np.int64)
    inner = np.ones(len(v), bool)
    inner[to + n] = False
    v[inner] = number[np.repeat(begin[:-1][order] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    v[~inner] = -1 - np.arange(len(n))
    longest = int(n[0]) // TIMES if len(n) else 0
    enough = np.searchsorted(-n, -TIMES * np.arange(1, longest + 1), "right")  # texts of at least TIMES * p words
    got = np.array(periodic(v, np.append(to, len(v))[enough]), np.int64).reshape(-1, 3)
    place = np.searchsorted(to, got[:, 0], "right") - 1
    text, start = order[place], got[:, 0] - to[place]
    sort = np.lexsort((got[:, 2], start, text))
    return text[sort], start[sort], got[sort, 1], got[sort, 2]


def _kept(words_: int, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of so many words stay: those that no run holds after its first period."""
    edge = np.zeros(words_ + 1, np.int64)
    np.add.at(edge, at + period, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:-1] == 0


def collapsed(docs: DataFrame, text: str = "text", new: tuple[str, str] = ("runs", "kept_text")) -> DataFrame:
    """docs with the text's runs (start and length in words, period; by start, then period) and the text without what
    repeats: every word that no run holds after its first period, joined by one space."""
    keep = [c for c in docs.columns if c not in new]
    schema = docs.select([F.col(f"`{c}`") for c in keep]).schema.add(new[0], T.ArrayType(RUN)).add(new[1], "string")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_slices(b.column(b.schema.get_field_index(text))):
                rows = len(offsets) - 1
                row, start, end, h = words(data, offsets)
                begin = np.searchsorted(row, np.arange(rows + 1), "left")
                of, at, length, period = _runs(numbered(data, start, end, h), begin)
                stays = _kept(len(row), begin[of] + at, length, period)
                count = np.bincount(of, minlength=rows)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (at, length, period)], fields=list(kind)))
                # each kept word and a space after it; a text's last space goes
                size = (end - start + 1)[stays]
                joined = _gathered(np.append(data, np.uint8(0)), start[stays], size)
                stop = np.cumsum(size)
                joined[stop - 1] = 0x20
                per_row = np.bincount(row[stays], minlength=rows)
                edge = np.append(0, stop)[np.append(0, np.cumsum(per_row))]
                texts = [joined[lo : max(lo, hi - 1)].tobytes().decode("utf-8", "replace") for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
                part = b.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(b.schema.get_field_index(k)) for k in keep), lists, pa.array(texts, pa.string())], names=[*keep, *new])

    return docs.mapInArrow(run, schema)


# --- the query --------------------------------------------------------------------------------


def echoed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in whose texts, for one id in ten, a tail of the words is replaced by repetitions of its beginning; in SQL
    functions, as joined words. Rows without id stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    w = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    marked = docs.withColumn("_w", F.when(h % 10 == 0, w)).withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_w"))
    marked = marked.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    marked = marked.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", place(i))), " ")
    return marked.withColumn(text, F.when(F.col("_a").isNotNull(), again).otherwise(F.col(text))).drop("_w", "_g", "_n", "_a", "_p")


def _strongest(runs: Column) -> Column:
    """The run with the greatest length / period; runs come by start and period, so of equals the first."""
    none = F.lit(None).cast(RUN)
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    found = collapsed(echoed(docs.select("doc_id", "text"))).withColumn("best", _strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
