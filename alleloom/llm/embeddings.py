"""Embedding near-duplicates by NN-descent.

Vectors with equal components are one node with a multiplicity. The neighbour graph starts from random projections: for
each of `trees` sets of hyperplanes the nodes are sorted by their sign code, and neighbours in that order are compared.
It is then refined: a node's neighbours, both ways, meet in one row set, and every two of them of which one is new to
the list are compared; a node keeps its best `k`. Rounds end when few lists change. A node whose reverse list is long is
dealt into chunks, each with all its own neighbours, so no row set grows with the corpus and no neighbour is dropped.

A list is saturated when all its entries reach the threshold. Lists are then enlarged as far as they can matter: every
group that the threshold edges connect is compared in whole, block by block in tasks of their own, which yields counts of
links, not pairs, so members of a node's own group need no more places in its list. A node gets `k` further places for
nodes outside its group; these start from projections in which each group takes part with a few members, and are refined
like the rest. Groups that a link is found between become one, and their nodes' outside places are free again, until no
link leaves a group and no list of outside nodes is saturated. Only edges at or over the threshold count.

The number of projections grows with that of nodes, so that a lone pair at the threshold shares a run as often in a large
table. An audit compares nodes, drawn by hash, with all vectors, and goes on until `LINKED` of them have links or all
have been asked. While the recall of links, over all and on average over these nodes, is below `recall`, twice as many
further projections and their rounds follow; when these would compare as many pairs as there are, all are compared.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor do
vectors of different lengths with each other; a row is a vector, so rows of one id each have their own links, and equal
rows link with each other; component_id is the smallest id of the rows reached; rows without id link with nothing. Doubles
are compared as doubles, and vectors of any length in the range of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleloom.llm.common import components, mix, runs_of, written

#: Nodes in a block of a group that is compared in whole, and rows of a block compared at once.
BLOCK = 2048
STRIP = 512
CHUNK = 32
#: Members of a group in one projection that looks for neighbours outside the groups.
FEW = 8
RUN = 128
AUDIT = 512
#: Nodes with links that an audit must have seen.
LINKED = 200
#: Nodes in a block when all pairs are compared.
WHOLE = 2048
_GRAPH = "id long, nbr long, sim double, out boolean"


def _unit(vecs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows as unit vectors in double precision; 32-bit components, or 64-bit ones, which have a byte more in front."""
    x = np.stack([np.frombuffer(d, "<f8", offset=1) if (d := v.as_buffer()).size % 4 else np.frombuffer(d, "<f4") for v in vecs]).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # no square over- or underflows
    return x / np.sqrt((x * x).sum(1))[:, None]


def _uniform(t: pa.Table, column: str = "vec") -> Iterator[pa.Table]:
    """Tables of one vector length each."""
    n = np.array([len(v.as_buffer()) for v in t.column(column)])
    if len(n) and (n == n[0]).all():
        yield t
        return
    for k in np.unique(n):
        yield t.filter(pa.array(n == k))


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, d, vec) of every row: the components as bytes and their digest, both null if the row links with nothing."""
    double = vectors.schema[vector].dataType.elementType.typeName() == "double"
    usable = (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False)), F.col(vector).cast("array<double>" if double else "array<float>")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False) + 0  # -0 is 0
            flat = flat.astype("<f8" if double else "<f4")
            end = np.cumsum(np.where(ok, b.column(1).value_lengths().fill_null(0).to_numpy(), 0))
            head = b"\0" if double else b""
            data = [head + flat[lo:hi].tobytes() if good else None for lo, hi, good in zip([0, *end[:-1]], end, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary").select("vec_id", F.sha2("vec", 256).alias("d"), "vec")


def nodes(rows: DataFrame) -> DataFrame:
    """(id, d, m, low, vec) of distinct usable vectors: a number, the digest, how many rows have it, their smallest id."""
    one = rows.where("d is not null").groupBy("d").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"), F.min("vec").alias("vec"))
    return written(one.withColumn("id", F.monotonically_increasing_id()), "nodes")


def _near_in_order(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for lo in range(0, t.num_rows, RUN):
                for part in _uniform(t.slice(lo, RUN)):
                    ids, g, x = part.column("id").to_numpy(), part.column("g").to_numpy(), _unit(part.column("vec"))
                    s = x @ x.T
                    s[ids[:, None] == ids[None, :]] = -2
                    apart = g[:, None] != g[None, :]
                    for out in (False, True):
                        sims = np.where(apart == out, s, -2)
                        top = np.argsort(-sims, 1, kind="stable")[:, :k]
                        r, c = np.arange(len(ids)).repeat(top.shape[1]), top.ravel()
                        good = sims[r, c] > -2
                        r, c = r[good], c[good]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(ids[c]), pa.array(np.minimum(s[r, c], 1.0)), pa.array(np.full(len(r), out))], names=["id", "nbr", "sim", "out"])

        for b in batches:
            held.append(b.select(["id", "g", "vec"]) if hasattr(b, "select") else b)
            size += b.num_rows
            if size >= 4 * RUN:
                yield from compared(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from compared(pa.Table.from_batches(held))

    return run


def projected(nodes_: DataFrame, count: int, k: int, trees: int, seed: int) -> DataFrame:
    """Starting neighbours (id, nbr, sim, out): the best k within and the best k outside the group of a node (id, g, parts, vec)
    in runs that random projections put side by side. Of a group, one member in `parts` takes part in a projection."""
    bits = max(1, min(62, int(np.ceil(np.log2(max(count, 2) / 16)))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for t in _uniform(pa.Table.from_batches([b])):
                every = _unit(t.column("vec"))
                ids, parts = t.column("id").to_numpy(), t.column("parts").to_numpy()
                for tree in range(trees):
                    here = np.flatnonzero(mix(ids.astype(np.uint64) ^ np.uint64((seed << 32) + tree + 1)) % parts.astype(np.uint64) == 0)
                    x = every[here]
                    planes = np.random.default_rng((seed, tree)).normal(size=(x.shape[1], bits + 1))
                    p = x @ planes
                    c = ((p[:, :bits] > 0) << np.arange(bits)[::-1]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), tree, np.int32)), pa.array(c), pa.array(p[:, bits]), *(t.column(k).combine_chunks().take(pa.array(here)) for k in ("id", "g", "vec"))], names=["tree", "code", "p", "id", "g", "vec"])

    coded = nodes_.select("id", "g", "parts", "vec").mapInArrow(code, "tree int, code long, p double, id long, g long, vec binary")
    order = ["tree", "code", "p", "id"]
    parts = int(nodes_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "g", "vec").mapInArrow(_near_in_order(k), _GRAPH)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The best k of (id, nbr, sim, out, new) within and outside the group; a pair that was in a list before isn't new."""
    one = rows.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.max("out").alias("out"), F.min("new").alias("new"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("id", "out").orderBy(F.desc("sim"), "nbr"))).where(F.col("r") <= k).drop("r")


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs_of(batches, ["v", "c"]):
        v, c = t.column("v").to_numpy(), t.column("c").to_numpy()
        vecs = t.column("vec").combine_chunks()
        u, near, far, g, new = (t.column(k).to_numpy() for k in ("u", "near", "far", "g", "new"))
        edge = np.flatnonzero(np.append(True, (np.diff(v) != 0) | (np.diff(c) != 0)))
        a, b, s, o = [], [], [], []
        sizes = {len(x.as_buffer()) for x in vecs}
        for lo, hi in zip(edge, np.append(edge[1:], len(v)), strict=True):
            if hi - lo < 2 or not new[lo:hi].any() or len(sizes) > 1 and len({len(vecs[i].as_buffer()) for i in range(lo, hi)}) > 1:
                continue
            x = _unit(vecs[lo:hi])
            sim = x @ x.T
            who, group, fresh = u[lo:hi], g[lo:hi], new[lo:hi]
            apart = group[:, None] != group[None, :]
            want = (sim > np.where(apart, far[lo:hi, None], near[lo:hi, None])) & (fresh[:, None] | fresh[None, :]) & (who[:, None] != who[None, :])
            i, j = np.nonzero(want)
            a.append(who[i]), b.append(who[j]), s.append(np.minimum(sim[i, j], 1.0)), o.append(apart[i, j])
        if a:
            a, b, s, o = np.concatenate(a), np.concatenate(b), np.concatenate(s), np.concatenate(o)
            if len(a):
                _, at = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(s[at]), pa.array(o[at])], names=["id", "nbr", "sim", "out"])


def refined(graph: DataFrame, nodes_: DataFrame, k: int) -> DataFrame:
    """One round: graph (id, nbr, sim, out, new) with what the neighbours' neighbours add; nodes have a group g."""

    def least(rows: Column) -> Column:
        return F.when(F.count(F.when(rows, 1)) >= k, F.min(F.when(rows, F.col("sim")))).otherwise(F.lit(-2.0))

    kth = graph.groupBy("id").agg(least(~F.col("out")).alias("near"), least(F.col("out")).alias("far"))
    back = graph.select(F.col("nbr").alias("v"), F.col("id").alias("u"), "new")
    long = back.groupBy("v").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    back = back.join(long, "v").withColumn("c", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int"))
    ahead = graph.select(F.col("id").alias("v"), F.col("nbr").alias("u"), "new").join(long, "v", "left").withColumn("c", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    met = ahead.select("v", "c", "u", "new").unionByName(back.select("v", "c", "u", "new")).groupBy("v", "c", "u").agg(F.max("new").alias("new"))
    info = nodes_.select(F.col("id").alias("u"), "g", "vec").join(kth.withColumnRenamed("id", "u"), "u", "left").withColumn("near", F.coalesce("near", F.lit(-2.0))).withColumn("far", F.coalesce("far", F.lit(-2.0)))
    rows = met.join(info, "u").select("v", "c", "u", "new", "near", "far", "g", "vec")
    found = rows.repartition("v", "c").sortWithinPartitions("v", "c").mapInArrow(_local_joins, _GRAPH)
    return written(_best(graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))), k), "graph")


def _forest(link: np.ndarray) -> np.ndarray:
    """The smallest position of each row's component in a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(1, initial=len(link)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(threshold: float):
    """_counted(), and edges (id, nbr) that connect what links connect in the two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["g", "i", "j"]):
            for n in _counted(threshold)(iter(t.combine_chunks().to_batches())):
                yield pa.RecordBatch.from_arrays([n.column(0), n.column(1), pa.nulls(n.num_rows, pa.int64())], names=["id", "n", "nbr"])
            g, i, j, ids = (t.column(k).to_numpy() for k in ("g", "i", "j", "id"))
            vecs = t.column("vec").combine_chunks()
            edge = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
            for lo, hi in zip(edge, np.append(edge[1:], len(g)), strict=True):
                x, own = _unit(vecs[lo:hi]), ids[lo:hi]
                label = _forest(x @ x.T >= threshold)
                at = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.zeros(len(at), np.int64)), pa.array(own[label[at]])], names=["id", "n", "nbr"])

    return run


def compared(nodes_: DataFrame, threshold: float, block: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Groups (id, g) and links (id, n) from all pairs of nodes with vectors of one length."""
    rows = written(_block_pairs(nodes_.select("id", F.octet_length("vec").cast("long").alias("g")), nodes_, block).mapInArrow(_compared(threshold), "id long, n long, nbr long"), "compared")
    groups = written(components(rows.where("nbr is not null").select(F.col("id").alias("a"), F.col("nbr").alias("b"))).select("id", F.col("component").alias("g")), "groups")
    return groups, written(rows.where("nbr is null").groupBy("id").agg(F.sum("n").alias("n")), "links")


def _counted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["g", "i", "j"]):
            g, i, j, block, ids, m = (t.column(k).to_numpy() for k in ("g", "i", "j", "block", "id", "m"))
            vecs = t.column("vec").combine_chunks()
            edge = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
            out_id, out_n = [], []
            for lo, hi in zip(edge, np.append(edge[1:], len(g)), strict=True):
                x, own, times = _unit(vecs[lo:hi]), ids[lo:hi], m[lo:hi]
                one = i[lo] == j[lo]
                left, right = (np.flatnonzero(block[lo:hi] == k) for k in (i[lo], j[lo]))
                there = np.zeros(len(right), np.int64)
                for k in range(0, len(left), STRIP):
                    part = left[k : k + STRIP]
                    s = (x[part] @ x[right].T >= threshold) & (own[part][:, None] != own[right][None, :])
                    out_id.append(own[part]), out_n.append(s @ times[right])
                    if not one:
                        there += s.T @ times[part]
                if not one:
                    out_id.append(own[right]), out_n.append(there)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["id", "n"])

    return run


def _block_pairs(groups: DataFrame, nodes_: DataFrame, block: int) -> DataFrame:
    """Nodes of every pair (i, j) of their group's blocks, pair by pair."""
    size = groups.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = groups.join(size, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.join(nodes_, "id").select("g", "i", "j", "block", "id", "m", "vec").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "id")


def counted(groups: DataFrame, nodes_: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, n): links of each node within its group (id, g), weighted by multiplicity."""
    return _block_pairs(groups, nodes_, block).mapInArrow(_counted(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _asked(nodes_: DataFrame, asked: list, threshold: float) -> dict[int, int]:
    """Links of the asked nodes, against all vectors, in blocks."""
    of_length: dict[int, list] = {}
    for r in asked:
        of_length.setdefault(len(r["vec"]), []).append(r)
    ids = {n: np.array([r["id"] for r in rs]) for n, rs in of_length.items()}
    unit = {n: _unit(pa.array([bytes(r["vec"]) for r in rs], pa.binary())) for n, rs in of_length.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {size: np.zeros(len(x), np.int64) for size, x in ids.items()}
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                for t in _uniform(pa.Table.from_batches([b.slice(lo, 2048)])):
                    size = len(t.column("vec")[0].as_buffer())
                    if size in ids:
                        hit = (unit[size] @ _unit(t.column("vec")).T >= threshold) & (ids[size][:, None] != t.column("id").to_numpy()[None, :])
                        n[size] += hit @ t.column("m").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(ids.values()))), pa.array(np.concatenate(list(n.values())))], names=["id", "n"])

    return {r["id"]: r["n"] for r in nodes_.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def audited(nodes_: DataFrame, count: int, found: DataFrame, threshold: float, sample: int = AUDIT, linked: int = LINKED) -> float:
    """Recall of links, over all and by node (the lower), of nodes drawn by hash until `linked` have links or all are asked."""
    total, got, each, lo = 0, 0, [], 0.0
    while lo < 1 and len(each) < linked:
        hi = lo + sample / max(count, 1)
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
        asked = nodes_.where((draw >= lo) & (draw < hi)).collect()  # about `sample` vectors
        there = {i: n for i, n in _asked(nodes_, asked, threshold).items() if n} if asked else {}
        mine = {r["id"]: r["n"] for r in found.where(F.col("id").isin(list(there))).collect()} if there else {}
        total += sum(there.values())
        got += sum(min(mine.get(i, 0), n) for i, n in there.items())
        each += [min(mine.get(i, 0), n) / n for i, n in there.items()]
        lo, sample = hi, min(2 * sample, 4096)
    return min(got / total, float(np.mean(each))) if each else 1.0


def enough(count: int, trees: int) -> int:
    """Projections, `trees` at least, that bring five of six lone pairs at a cosine of 0.9 into one run."""
    share = 0.856 ** max(0.0, np.log2(max(count, 1) / RUN))
    return trees if share > 0.99 else max(trees, int(np.ceil(np.log(1 / 6) / np.log(1 - share))))


def grouped(nodes_: DataFrame, groups: DataFrame | None, few: bool = False) -> DataFrame:
    """nodes_ with their group g, which is the node itself if it is in none, and parts: 1, or with few, as many as leave FEW of a group."""
    if groups is None:
        return nodes_.withColumn("g", F.col("id")).withColumn("parts", F.lit(1))
    size = groups.groupBy("g").agg(F.ceil(F.count("*") / FEW).cast("int").alias("parts"))
    known = groups.join(size, "g") if few else groups.withColumn("parts", F.lit(1))
    return nodes_.join(known, "id", "left").withColumn("g", F.coalesce("g", "id")).withColumn("parts", F.coalesce("parts", F.lit(1)))


def regrouped(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """graph, both ways, with `out` as of these groups."""
    both = graph.select("id", "nbr", "sim").unionByName(graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim"))
    own, other = groups.select("id", F.col("g").alias("own")), groups.select(F.col("id").alias("nbr"), F.col("g").alias("other"))
    marked = both.join(own, "id", "left").join(other, "nbr", "left")
    return marked.select("id", "nbr", "sim", (F.coalesce("own", "id") != F.coalesce("other", "nbr")).alias("out"), F.lit(True).alias("new"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 10, trees: int = 6, rounds: int = 4, recall: float = 0.99, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, saturated) for every row."""
    whole = nodes(packed(vectors, key, vector))
    node = whole.select("id", "m", "vec")
    count = node.count()
    graph = groups = found = None
    trees, go, done = enough(count, trees), 0, 0
    while True:
        known = grouped(node, groups)
        start = projected(known, count, k, trees, seed=17 + go).withColumn("new", F.lit(True))
        graph = written(_best(start if graph is None else graph.unionByName(start), k), "graph")
        step = 0
        while True:
            for _ in range(rounds):
                graph = refined(graph, known, k)
                if graph.where("new").count() <= 0.02 * k * count:
                    break
            links = graph.where(F.col("out") & (F.col("sim") >= threshold))
            crossed = not links.isEmpty()
            full = crossed and not links.groupBy("id").count().where(F.col("count") >= k).isEmpty()
            edges = links.select(F.col("id").alias("a"), F.col("nbr").alias("b"))
            if groups is not None:
                edges = edges.unionByName(groups.select(F.col("id").alias("a"), F.col("g").alias("b")))
            if groups is None or crossed:
                groups = written(components(edges).select("id", F.col("component").alias("g")), "groups")
            # links fill the places outside, or led on from groups that were full: look outside the groups that are now
            if not (full or step and crossed):
                break
            step += 1
            known = grouped(node, groups)
            start = projected(grouped(node, groups, few=True), count, k, trees, seed=1000 * (go + 1) + step).withColumn("new", F.lit(True))
            graph = written(_best(regrouped(graph, groups).unionByName(start), k), "graph")
        graph = written(_best(regrouped(graph, groups), k), "graph")
        found = written(counted(groups, node, threshold), "links")
        if audited(node, count, found, threshold) >= recall:
            break
        go, done, trees = go + 1, done + trees, 2 * trees
        if (done + trees) * RUN >= count:
            groups, found = compared(node, threshold)
            break
    best = graph.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))).where(F.col("r") <= k)
    full = best.groupBy("id").agg((F.min("sim") >= threshold).alias("saturated"))
    per = whole.select("id", "d", "m", "low").join(groups, "id", "left").join(found, "id", "left").join(full, "id", "left")
    per = per.select("d", "low", F.coalesce("g", "id").alias("g"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("saturated", F.lit(False)).alias("saturated"))
    least = per.groupBy("g").agg(F.min("low").alias("component_id"))
    own = per.join(least, "g").select("d", "n_links", "component_id", "saturated")
    out = packed(vectors, key, vector).select("vec_id", "d").join(own, "d", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.coalesce("saturated", F.lit(False)).alias("saturated"))
