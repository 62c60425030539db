"""Byte-level BPE encoding and decoding by monoid tree reduction.

A node of the tree is the token sequence of a span of text, kept by pre-token. `encode` halves a text recursively down to
leaves of at most `leaf` characters, encodes the leaves, and joins neighbours. A join keeps the left tokens up to a
pre-token boundary that the text to its right cannot move, re-encodes a window from there over the cut, and widens the
window until it ends on a boundary that the right half also has; tokens outside the window then provably stay:

* a pre-token match depends only on the text from its start on, so two scans that share a boundary agree after it;
* the left half's pre-tokens before its last `_GUARD` ones end before the cut with a full look-ahead, so they stay.

A single pre-token of more than `_LEAF_BYTES` is encoded by the same tree over its bytes; there a window of tokens around
the cut is re-encoded, and grows until its outermost tokens come out unchanged on both sides: BPE sequences whose adjacent
pairs are each their own encoding are the encoding of their concatenation. Bytes of a leaf are merged by rank, the lowest
and leftmost pair first; the merges of short pre-tokens are remembered, up to `_REMEMBERED` of them.

Decoding concatenates the bytes of halves up the tree.

Defined results: null and empty text give no ids; every other text is encoded whole, without special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters in a leaf; all but the shortest texts have several.
LEAF_CHARS = 256
_LEAF_BYTES = 64
_LEAF_IDS = 256
_GUARD = 2
_WINDOW = 8
_REMEMBERED = 400_000
_NEVER = 1 << 60

#: A span's pre-tokens and the ids of each.
Span = tuple[list[str], list[tuple[int, ...]]]


class TreeBPE:
    """ranks: bytes -> rank; pattern: the pre-token pattern, which leaves no character out."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS, leaf_bytes: int = _LEAF_BYTES):
        self.ranks, self.leaf, self.leaf_bytes = ranks, leaf, leaf_bytes
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.of_byte = [ranks[bytes([i])] for i in range(256)]
        # what two tokens make, by (first << 32 | second)
        self.made = {ranks[b[:i]] << 32 | ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        self.known: dict[str, tuple[int, ...]] = {}

    # tokens of whole pre-tokens ------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._tree(text, 0, len(text))[1])) if text else []

    def _tree(self, text: str, lo: int, hi: int) -> Span:
        if hi - lo <= self.leaf:
            pieces = self.split.findall(text[lo:hi])
            return pieces, [self._ids(p) for p in pieces]
        mid = (lo + hi) // 2
        return self._join(text, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, mid: int, hi: int, left: Span, right: Span) -> Span:
        pieces, codes = left
        at = mid - sum(map(len, pieces[-_GUARD:]))
        del pieces[-_GUARD:], codes[-_GUARD:]
        k, start = 0, mid  # the right half's next pre-token, and where it starts
        while at < hi:
            while start < at:
                start += len(right[0][k])
                k += 1
            if start == at:  # the scans meet: the rest of the right half stays
                pieces += right[0][k:]
                codes += right[1][k:]
                break
            m = self.split.match(text, at, hi)
            pieces.append(m[0])
            codes.append(self._ids(m[0]))
            at = m.end()
        return pieces, codes

    # tokens within one pre-token -----------------------------------------------------------

    def _ids(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            got = tuple(self._piece(piece.encode()))
            if len(piece) <= self.leaf_bytes:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[piece] = got
        return got

    def _piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._merged(piece)
        mid = len(piece) // 2
        return self._weld(self._piece(piece[:mid]), self._piece(piece[mid:]))

    def _merged(self, piece: bytes) -> list[int]:
        """The ids of bytes, pairs merged by rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 2 * self.leaf_bytes:
            return self._merged_by_heap(piece)
        made = self.made.get
        ids = [self.of_byte[x] for x in piece]
        pair = [made(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while pair and (low := min(pair)) != _NEVER:
            i = pair.index(low)
            ids[i] = low
            del ids[i + 1], pair[i]
            if i < len(pair):
                pair[i] = made(low << 32 | ids[i + 1], _NEVER)
            if i:
                pair[i - 1] = made(ids[i - 1] << 32 | low, _NEVER)
        return ids

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here: its end; the part before it
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, to = heapq.heappop(heap)
            if end[i] < 0 or end[i] >= n or end[end[i]] != to:
                continue  # one of the two has been merged otherwise since
            gone = end[i]
            end[i] = to
            end[gone] = -1
            before[to] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _weld(self, left: list[int], right: list[int]) -> list[int]:
        k = _WINDOW
        while True:
            a, b = left[-k:], right[:k]
            mid = self._merged(b"".join(self.bytes_of[i] for i in (*a, *b)))
            if (k >= len(left) or mid[0] == a[0]) and (k >= len(right) or mid[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + mid + right[k:]
            k *= 2

    # back --------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= _LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, leaf: int = LEAF_CHARS) -> TreeBPE:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeBPE(ranks, pattern, leaf)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """docs with `ids array<int>`: the token ids of every whole text. `path` is a rank file present on every worker."""
    return _mapped(docs, [("ids", "array<int>")], lambda c, t: {"ids": c.encode(t)}, path, pattern, text, leaf)


def round_trips(docs: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """docs with n_tokens, ids_sha256 (little-endian unsigned 32-bit ids) and decoded_sha256 of encode, then decode."""

    def row(c: TreeBPE, t: str) -> dict:
        ids = c.encode(t)
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(c.decode(ids)).hexdigest()}

    return _mapped(docs, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], row, path, pattern, text, leaf)


def _mapped(docs: DataFrame, out: list[tuple[str, str]], row, path: str, pattern: str, text: str, leaf: int) -> DataFrame:
    keep = [c for c in docs.columns if c not in {n for n, _ in out}]
    schema = docs.select([F.col(f"`{c}`") for c in keep]).schema
    for n, kind in out:
        schema = schema.add(n, T.DataType.fromDDL(kind))
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, leaf)
        for b in batches:
            got: dict[str, list] = {n: [] for n, _ in out}
            for x in b.column(b.schema.get_field_index(text)):
                for k, v in row(c, x.as_py() or "").items():
                    got[k].append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), *(pa.array(got[n], kinds[kind]) for n, kind in out)], names=[*keep, *got])

    return docs.mapInArrow(run, schema)
