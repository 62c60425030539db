"""N-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles; two link when 100 * |intersection| >= percent * |union|.

Routing. A linked pair's symmetric difference is bounded by the smaller set's size class, say by k. The hash space is cut
into m > k ranges; at least m - k ranges then hold the same shingles in both sets, so both sets have equal digests of a
range, and the pair meets under it. Empty ranges are not used: m = k + 1 + z, and a set in which more than z ranges are
empty is also filed under one key for such sets, so two sets that agree in empty ranges alone still meet. Under each key
only the smallest document is written down for each other one; the documents that have one smallest document in common,
and that document, are a cluster. Every linked pair is in some cluster; a document in none is linked to nothing.

Joining. In a cluster all sets are compared with its hub, the smallest document; a cluster of copies is done then. What is
left is to find links of the sets that the hub does not link, with each other and with the linked ones that the triangle
inequality of the Jaccard distance leaves in reach. These are joined by signature trees: a node holds the OR of its sets'
token bitmaps, the range of their sizes and the least number of set bits; two trees are traversed together, and a pair of
nodes is dropped when its greatest possible overlap is too small for its least sizes, or when all its sets are already
connected. A first traversal, over bitmaps alone, takes what is left of a cluster apart into groups of sets that may be
linked. In a group the same is done again, hub first, and a second traversal verifies the pairs of leaves that survive on
the whole sets. What is left of a cluster beyond a block is cut into blocks, and pairs of blocks are joined by separate
tasks, so no task holds more than two blocks. Equal sets are one throughout.

Defined results: null, empty and white text make an empty set, linked with nothing; fewer words than a shingle make one
shingle of all words; rows of one id are one vertex; rows without id are linked with nothing and have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleloom.llm.common import binaries, components, mix, passing, runs_of, signed, text_slices, windows, words, written

BLOCK = 256
#: Sets in a block of the traversal of bitmaps alone, which are small.
SKETCH_BLOCK = 2048
FANOUT = 8


# --- sets -----------------------------------------------------------------------------------


def sets_of(texts: pa.Array, shingle: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for first, data, offsets in text_slices(texts):
        row, _, _, h = words(data, offsets, lower)
        lo = np.searchsorted(row, np.arange(len(offsets)), "left")
        by_size = {shingle: windows(row, h, shingle)[0]}
        for i in range(len(offsets) - 1):
            n = int(lo[i + 1] - lo[i])
            if not n:
                yield first + i, np.zeros(0, np.uint64)
                continue
            size = min(n, shingle)
            if size not in by_size:
                by_size[size] = windows(row, h, size)[0]
            x = np.sort(by_size[size][lo[i] : lo[i] + n - size + 1])
            yield first + i, x[np.append(True, x[1:] != x[:-1])]


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


# --- routing keys ---------------------------------------------------------------------------


@lru_cache(maxsize=8)
def classes(percent: int) -> np.ndarray:
    """Lower bounds of size classes; sets of a linked pair lie in one class or in neighbours."""
    out = [1, 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return np.array(out)


@lru_cache(maxsize=4096)
def ranges(percent: int, c: int) -> tuple[int, int, np.ndarray]:
    """(k, z, bounds of k + 1 + z ranges) for pairs whose smaller set is of class c."""
    bounds = classes(percent)
    least, most = int(bounds[c]), int(bounds[c + 1]) - 1
    k = (100 - percent) * most // percent
    z = 0
    while k and z < 8 + k // 4:
        m = k + 1 + z
        none = math.exp(-least / m)
        sd = math.sqrt(max(m * none * (1 - (1 + least / m) * none), 1e-9))
        if m * (1 - none) - 5.5 * sd > k:
            break
        z += 1
    m = k + 1 + z
    return k, z, np.array([(i << 64) // m for i in range(1, m)], np.uint64)


def keys_of(x: np.ndarray, percent: int) -> np.ndarray:
    """Routing keys of a sorted set."""
    n = len(x)
    c = int(np.searchsorted(classes(percent), n, "right")) - 1
    out, mixed = [], mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A))
    for pair in (c, c - 1):
        if pair < 0:
            continue
        _, z, bounds = ranges(percent, pair)
        cut = np.concatenate([[0], np.searchsorted(x, bounds, "left"), [n]])
        full = np.flatnonzero(cut[1:] > cut[:-1])
        sums = np.add.reduceat(mixed, cut[full])
        out.append(mix(sums ^ mix((full.astype(np.uint64) << np.uint64(20)) + np.uint64(pair))))
        if len(cut) - 1 - len(full) > z:
            out.append(mix(np.array([(1 << 50) + pair], np.uint64)))
    return np.concatenate(out)


def _stars(filed: DataFrame) -> DataFrame:
    """(a, b): each document of (key, doc), and the smallest one under the same key, where that is another.

    The smallest is found with a map-side combine and joined back to the keys that several have, so Spark splits the
    rows of a key that a large part of all documents share. It does so where both sides are read straight from a shuffle;
    the smallest are written for that, too."""
    least = filed.groupBy("key").agg(F.min("doc").alias("b"), F.max("doc").alias("most")).where("b < most").drop("most")
    return filed.join(written(least, "least").hint("merge"), "key").where("doc > b").select(F.col("doc").alias("a"), "b").distinct()


# --- signature trees ------------------------------------------------------------------------


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def bitmap(x: np.ndarray, width: int) -> np.ndarray:
    """The token bitmap of a set, in 64-bit words; OR of its halves is the bitmap of half the width."""
    out = np.zeros(width // 64, np.uint64)
    slot = mix(x) & np.uint64(width - 1)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words_: int) -> np.ndarray:
    while len(bits) > words_:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def width_for(size: float) -> int:
    """Bits of a bitmap for sets of about that size."""
    return 1 << min(14, max(8, int(4 * size).bit_length()))


def sketch_width(size: float) -> int:
    """Bits of the bitmaps that travel for the first traversal: fewer, as they only have to keep unlike sets apart."""
    return 1 << min(14, max(8, int(1.5 * size).bit_length()))


class Tree:
    """Levels of nodes over sets sorted by size; level 0 are the sets, each node above covers FANOUT below."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        # likeness beside likeness: by size class, then by the first bits
        self.order = np.lexsort((maps[:, 0], np.log2(np.maximum(sizes, 1)).astype(int)))
        maps, sizes = maps[self.order], sizes[self.order]
        self.levels = [(maps, sizes, sizes, _bits(maps))]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, pop = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(pop, at)))

    def can(self, level: int, a: np.ndarray, other: Tree, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the greatest possible overlap of nodes a and b reaches the threshold."""
        ma, loa, hia, popa = (x[a] for x in self.levels[level])
        mb, lob, hib, popb = (x[b] for x in other.levels[level])
        common = _bits(ma & mb)
        # each of a set's bits that no set of the other node has stands for a shingle outside it
        most = np.minimum(hia - np.maximum(popa - common, 0), hib - np.maximum(popb - common, 0))
        return (100 * most >= percent * (loa + lob - most)) & (100 * hia >= percent * lob) & (100 * hib >= percent * loa)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left (right None), or of those between left and right.

    Pairs are indices into left, and into right or left.
    """
    if not left or right == []:
        return []
    width = width_for(float(np.median([len(x) for x in (*left, *(right or []))])))

    def tree(sets: list[np.ndarray]) -> Tree:
        return Tree(np.array([len(x) for x in sets]), np.stack([bitmap(x, width) for x in sets]))

    other = left if right is None else right

    def verified(p: int, q: int) -> bool:
        s, t = left[p], other[q]
        return linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent)

    return traverse(tree(left), None if right is None else tree(right), percent, verified)


def traverse(a: Tree, other: Tree | None, percent: int, verified=None) -> list[tuple[int, int]]:
    """The dual traversal: a spanning forest of the surviving pairs of sets that are verified (all of them without a check)."""
    one = other is None
    b = a if one else other
    n = len(a.order)
    root = list(range(n if one else n + len(b.order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while len(a.levels) < len(b.levels):
        a.levels.append(a.levels[-1])
    while len(b.levels) < len(a.levels):
        b.levels.append(b.levels[-1])
    found: list[tuple[int, int]] = []
    step = 1 << 14
    stack = [(len(a.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if not level and found:  # what is connected by now needs no bound
            part = np.array([find(i) for i in range(len(root))])
            apart = part[a.order[x]] != part[b.order[y] + (0 if one else n)]
            x, y = x[apart], y[apart]
        ok = a.can(level, x, b, y, percent)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if level:
            na, nb = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
            fa = FANOUT if na > len(a.levels[level][0]) else 1
            fb = FANOUT if nb > len(b.levels[level][0]) else 1
            cx = (x[:, None] * fa + np.arange(fa)).repeat(fb, 1).ravel()
            cy = np.tile(y[:, None] * fb + np.arange(fb), (1, fa)).ravel()
            real = (cx < na) & (cy < nb)
            if one:
                real &= (cx < cy) if level == 1 else (cx <= cy)
            cx, cy = cx[real], cy[real]
            for i in range(0, len(cx), step):
                stack.append((level - 1, cx[i : i + step], cy[i : i + step]))
            continue
        for p, q in zip(a.order[x].tolist(), b.order[y].tolist(), strict=True):
            u, v = find(p), find(q if one else n + q)
            if u != v and (verified is None or verified(p, q)):
                root[u] = v
                found.append((p, q))
    return found


# --- the join -------------------------------------------------------------------------------


def document_sets(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, s1, s2): size and 128-bit digest of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            for i, x in sets_of(b.column(1), shingle):
                n[i], s1[i], s2[i] = len(x), x.sum(), mix(x).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2))], names=["doc", "n", "s1", "s2"])

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n long, s1 long, s2 long")


def _clusters(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(cluster, doc): documents that share a key with a smaller one, which is the cluster. Copies are filed once a task."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed: dict[tuple, int] = {}  # the smallest document of a set so far, of those that this task reads
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            held, who, size = [], [], 0
            for i, x in sets_of(b.column(1), shingle):
                if len(x):
                    digest = len(x), int(x.sum()), int(mix(x).sum())
                    if filed.get(digest, doc[i] + 1) <= doc[i]:
                        continue  # only the smallest document of equal sets counts, and this is not it
                    filed[digest] = doc[i]
                    k = keys_of(x, percent)
                    held.append(k)
                    who.append(np.full(len(k), doc[i]))
                    size += len(k)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(held))), pa.array(np.concatenate(who))], names=["key", "doc"])
                    held, who, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(held))), pa.array(np.concatenate(who))], names=["key", "doc"])

    with passing(docs.mapInArrow(file, "key long, doc long"), "filed") as filed:
        stars = written(_stars(filed), "stars")
    return stars.select(F.col("b").alias("cluster"), F.col("a").alias("doc")).unionByName(stars.select(F.col("b").alias("cluster"), F.col("b").alias("doc")).distinct())


def _exact_with_hub(percent: int):
    """(cluster, doc, near, far) of rows (cluster, doc, set, hub_set): whether they link, and their Jaccard distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link, far = [], []
            for s, h in zip(b.column(2), b.column(3), strict=True):
                s, h = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
                o = len(np.intersect1d(s, h, assume_unique=True))
                link.append(linked(o, len(s), len(h), percent))
                far.append(1 - o / (len(s) + len(h) - o))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(link, pa.bool_()), pa.array(far, pa.float64())], names=["cluster", "doc", "near", "far"])

    return run


def _sketch_with_hub(percent: int):
    """For rows that end in n, bits, hub_n, hub_bits: whether they may link by their bitmaps, and the least distance they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may, low = [], []
            for n, x, m, y in zip(*(c.to_pylist() for c in b.columns[-4:]), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                narrow = min(len(x), len(y))
                x, y = folded(x, narrow), folded(y, narrow)
                common = int(_bits(x & y))
                most = min(n - max(int(_bits(x)) - common, 0), m - max(int(_bits(y)) - common, 0))
                may.append(linked(most, n, m, percent))
                low.append(1 - most / (n + m - most))
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(may, pa.bool_()), pa.array(low, pa.float64())], names=[*b.schema.names[:-4], "may", "low"])

    return run


def _groups(t: pa.Table, names: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal values of the names, in a table sorted by them."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in names:
        new[1:] |= np.diff(t.column(k).to_numpy()) != 0
    at = np.flatnonzero(new)
    return zip(at, np.append(at[1:], t.num_rows), strict=True)


def _pairs_of_blocks(join, column: str):
    """Tasks over rows sorted by (cluster, i, j): join(table, rows of block i, rows of block j or None) gives row pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["cluster", "i", "j"]):
            i, j, block, doc = (t.column(k).to_numpy() for k in ("i", "j", "block", "doc"))
            values = t.column(column).combine_chunks()
            size = t.column("n").to_numpy()
            a, b = [], []
            for lo, hi in _groups(t, ["cluster", "i", "j"]):
                if i[lo] == j[lo]:
                    rows = np.arange(lo, hi)
                    left, right = rows, None
                else:
                    left, right = lo + np.flatnonzero(block[lo:hi] == i[lo]), lo + np.flatnonzero(block[lo:hi] == j[lo])
                if not len(left) or right is not None and not len(right):
                    continue
                for p, q in join(values, size, left, right):
                    a.append(doc[left[p]]), b.append(doc[(left if right is None else right)[q]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sketch_join(percent: int):
    def join(values, size, left, right):
        rows = left if right is None else np.concatenate([left, right])
        bits = [np.frombuffer(values[int(k)].as_buffer(), np.uint64) for k in rows]
        narrow = min(map(len, bits))
        maps = np.stack([folded(x, narrow) for x in bits])
        one = Tree(size[left], maps[: len(left)])
        return traverse(one, None if right is None else Tree(size[right], maps[len(left) :]), percent)

    return join


def _set_join(percent: int):
    def join(values, size, left, right):
        sets = lambda rows: [np.frombuffer(values[int(k)].as_buffer(), np.uint64) for k in rows]
        return tree_links(sets(left), None if right is None else sets(right), percent)

    return join


def _to_hubs(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(cluster, doc, near, far) of members (cluster, doc, hub) against their hub: whether linked, and the distance, of which
    there may be just a lower bound if they are not linked.

    The hub is one set, by its digest; other sets of its id, in rows of other texts, are members like any other. Bitmaps
    meet first, so whole sets move only for pairs that may be linked.
    """
    light = whole.select("doc", "digest", "n", "bits")
    hubs = members.select("hub").distinct().join(light.withColumnRenamed("doc", "hub"), "hub").groupBy("hub").agg(F.min(F.struct("digest", "n", "bits")).alias("h"))
    met = members.hint("merge").join(light, "doc").join(hubs.hint("merge"), "hub").where("doc <> hub or digest <> h.digest")
    pair = ["cluster", "doc", "digest", "hub"]
    rows = met.select(*pair, F.col("h.digest").alias("hub_digest"), "n", "bits", F.col("h.n").alias("hub_n"), F.col("h.bits").alias("hub_bits"))
    kinds = "cluster long, doc long, digest long, hub long, hub_digest long, may boolean, low double"
    sketched = written(rows.mapInArrow(_sketch_with_hub(percent), kinds), "sketched")
    sets = whole.select("doc", "digest", "set")
    hub_sets = sets.select(F.col("doc").alias("hub"), F.col("digest").alias("hub_digest"), F.col("set").alias("hub_set"))
    both = sketched.where("may").hint("merge").join(sets, ["doc", "digest"]).join(hub_sets.hint("merge"), ["hub", "hub_digest"])
    exact = both.select("cluster", "doc", "set", "hub_set").mapInArrow(_exact_with_hub(percent), "cluster long, doc long, near boolean, far double")
    return written(exact.unionByName(sketched.where("not may").select("cluster", "doc", F.lit(False).alias("near"), F.col("low").alias("far"))), "near")


def _left_over(near: DataFrame, percent: int, block: int) -> DataFrame:
    """(cluster, doc, block, i, j): of what the hub doesn't link, and of the linked sets in its reach, every pair of blocks.

    Blocks of leftovers (even) meet all blocks, blocks of linked sets (odd) meet leftovers only, so a member is copied once
    for each block of leftovers of its cluster, and a cluster that its hub links in whole is not dealt at all.
    """
    over = near.where("not near").groupBy("cluster").agg(F.min("far").alias("least"), F.max("far").alias("most"))
    reach = (100 - percent) / 100 + 1e-9
    rest = near.join(over, "cluster").where(f"not near or (far >= least - {reach} and far <= most + {reach})").select("cluster", "doc", F.col("near").cast("int").alias("side"))
    count = rest.groupBy("cluster").agg(F.ceil(F.sum(1 - F.col("side")) / block).cast("int").alias("p0"), F.ceil(F.sum("side") / block).cast("int").alias("p1"))
    part = F.pmod(F.xxhash64("doc"), F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1"))).cast("int")
    dealt = rest.join(count, "cluster").withColumn("block", part * 2 + F.col("side"))
    evens = F.transform(F.sequence(F.lit(0), F.col("p0") - 1), lambda x: x * 2)
    odds = F.when(F.col("p1") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("p1") - 1, F.lit(0))), lambda x: x * 2 + 1)).otherwise(F.array().cast("array<int>"))
    met = dealt.withColumn("other", F.explode(F.when(F.col("side") == 0, F.concat(evens, odds)).otherwise(evens)))
    return met.select("cluster", "doc", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


_EDGES = "a long, b long"


def links(docs: DataFrame, sets: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links; docs is (doc, text), sets is document_sets() of it, written."""
    one = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.min("n").alias("n"))
    equal = sets.where("n > 0").select("doc", "s1", "s2").join(one, ["s1", "s2"]).where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    reps = one.select(F.col("rep").alias("doc")).distinct()
    member = written(_clusters(docs, shingle, percent).join(reps, "doc").select("cluster", "doc"), "members")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in sets_of(b.column(1), shingle):
                if len(x):
                    bits = bitmap(x, sketch_width(len(x)))
                    digest = np.array([mix(x).sum()], np.uint64)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(x)], pa.int64()), pa.array(signed(digest)), binaries(bits, np.array([len(bits)])), binaries(x, np.array([len(x)]))], names=["doc", "n", "digest", "bits", "set"])

    # texts and sets meet by sort and merge at every size, so what is moved grows with the input
    wanted = member.select("doc").distinct()
    whole = written(docs.join(wanted.hint("merge"), "doc").select("doc", "text").mapInArrow(take, "doc long, n long, digest long, bits binary, set binary"), "sets")
    # most members are copies of their cluster's smallest document: what it links needs no further comparison
    near = _to_hubs(member.withColumn("hub", F.col("cluster")), whole, percent)
    to_first = near.where("near").select(F.col("doc").alias("a"), F.col("cluster").alias("b"))
    order = ["cluster", "i", "j"]
    sketches = _left_over(near, percent, SKETCH_BLOCK).hint("merge").join(whole.select("doc", "n", "bits"), "doc").select(*order, "block", "doc", "n", "bits")
    alike = sketches.repartition(*order).sortWithinPartitions(*order, "doc").mapInArrow(_pairs_of_blocks(_sketch_join(percent), "bits"), _EDGES)
    groups = written(components(alike).select(F.col("id").alias("doc"), F.col("component").alias("cluster")), "groups")
    again = _to_hubs(groups.join(groups.groupBy("cluster").agg(F.min("doc").alias("hub")), "cluster"), whole, percent)
    hub = groups.groupBy("cluster").agg(F.min("doc").alias("hub"))
    to_hub = again.where("near").join(hub, "cluster").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    with_sets = _left_over(again, percent, block).hint("merge").join(whole.select("doc", "n", "set"), "doc").select(*order, "block", "doc", "n", "set")
    found = with_sets.repartition(*order).sortWithinPartitions(*order, "doc").mapInArrow(_pairs_of_blocks(_set_join(percent), "set"), _EDGES)
    return equal.unionByName(to_first).unionByName(to_hub).unionByName(found).where("a <> b")


def joined(docs: DataFrame, shingle: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    sets = written(document_sets(docs, shingle, key, text), "sizes")
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    edges = links(known, sets.where("doc is not null"), shingle, percent)
    comps = components(edges)
    return sets.join(comps.withColumnRenamed("id", "doc"), "doc", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def kept(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows of the smallest id in each component (rows without id stay); rows of one id are one document."""
    found = joined(docs.select(key, text), shingle, percent, key, text)
    gone = written(found.where(F.col("component_id") != F.col(key)).select(key).distinct(), "gone")
    return docs.join(gone.hint("merge"), key, "left_anti")


#: joined() with shingles of 4 words and 85 percent in DuckDB.
SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, array_to_string(list_slice(w, p, p + 3), ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) p from d where len(w) > 0)),
n as (select doc_id, count(*) n from g group by 1),
o as (select a.doc_id a, b.doc_id b, count(*) o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) m from r group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) component_id from d left join n using (doc_id) left join c on c.a = d.doc_id
"""
