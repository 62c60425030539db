"""Whole-genome alignments: MAF and EMF blocks, and samples taken from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alleloom.functions import scalars as X
from alleloom.sources.files import decompressed, lines, opened

#: A block's place: file, path, line or block in the file, and which of several sample lines.
PLACE = "struct<file:int,path:string,line:long,other:long>"
BLOCKS = f"ord {PLACE}, block long, chrom string, start int, ref_seq string, smp_seq string"


# --- MAF ------------------------------------------------------------------------------------


def read_maf(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, path, ord, block, name, start, size, strand, src_size, text): the s lines; a block runs from an a line to an empty one."""
    t = lines(spark, paths)
    w = Window.partitionBy("file", "path").orderBy("ord")
    t = t.withColumn("block", F.sum(F.col("line").rlike(r"^a(\s|$)").cast("int")).over(w)).where(F.col("line").rlike(r"^s\s"))
    p = F.split("line", r"\s+")
    return t.select("file", "path", "ord", "block", p[1].alias("name"), p[2].cast("int").alias("start"), p[3].cast("int").alias("size"), p[4].alias("strand"), p[5].cast("int").alias("src_size"), p[6].alias("text"))


def chrom_index(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """df (chrom, ...) with chrom_ix: by name, or without "chr", or M as MT; rows without any are dropped."""
    short = F.regexp_replace("chrom", "^chr", "")
    tries = F.array_distinct(F.array(F.col("chrom"), short, F.when(short == "M", "MT").otherwise(short)))
    t = df.withColumn("_row", F.struct(*df.columns)).select("_row", F.posexplode(tries).alias("_i", "name"))
    met = t.join(contigs.select("name", "chrom_ix"), "name")
    best = met.groupBy("_row").agg(F.min(F.struct("_i", "chrom_ix")).alias("b"))
    return best.select("_row.*", "b.chrom_ix")


def maf_blocks(maf: DataFrame, ref_species: str, sample_species: str, contigs: DataFrame, reverse_from_end: bool = True) -> DataFrame:
    """(ord, chrom_ix, start, len, ref_seq, smp_seq) on the forward strand, without columns where the reference has a gap.

    Every reference line of a block meets every sample line of it; ord is their place in the input.
    reverse_from_end: starts on the reverse strand count from the sequence's end, as the format says; False: the start is
    the position itself, less the length, plus one.
    """
    of = lambda species: maf.where((F.col("name") == species) | F.startswith("name", F.lit(species + ".")))
    ref = of(ref_species).withColumn("chrom", F.substr("name", F.lit(len(ref_species) + 2)))
    smp = of(sample_species).select("file", "path", "block", F.col("ord").alias("other"), F.col("text").alias("q"))
    both = ref.join(smp, ["file", "path", "block"])
    pairs = F.filter(F.arrays_zip(F.split("text", "").alias("r"), F.split("q", "").alias("q")), lambda x: (x["r"] != "-") & (x["r"] != ""))
    both = both.withColumn("x", pairs)
    r, q = F.array_join(F.transform("x", lambda x: x["r"]), ""), F.array_join(F.transform("x", lambda x: x["q"]), "")
    back = F.col("strand") == "-"
    turned = F.col("src_size") - F.col("start") - F.col("size") if reverse_from_end else F.col("start") - F.col("size") + 1
    place = F.struct("file", "path", F.col("ord").alias("line"), "other")
    out = both.select(place.alias("ord"), "chrom", F.when(back, turned).otherwise(F.col("start")).alias("start"), F.when(back, X.revcomp(r)).otherwise(r).alias("ref_seq"), F.when(back, X.revcomp(q)).otherwise(q).alias("smp_seq"))
    return chrom_index(out, contigs).withColumn("len", F.length("ref_seq"))


# --- EMF ------------------------------------------------------------------------------------


@dataclass
class Label:
    """A sequence of a block, or (at an inner node) the reconstructed one."""

    index: int
    species: str
    race: str
    chrom: str
    start: int  # 0-based, forward strand
    length: int
    reverse: bool

    def short(self) -> str:
        return f"{self.species[:1].upper()}{self.race[:3]}_{self.chrom}_{self.start + 1}_{self.start + self.length}[{'-' if self.reverse else '+'}]"


@dataclass
class Node:
    label: Label
    children: list[Node] = field(default_factory=list)

    def leaves(self, species: tuple[str, str]) -> list[Label]:
        if not self.children:
            return [self.label] if (self.label.species, self.label.race) == species else []
        return [x for c in self.children for x in c.leaves(species)]


_TOKEN = re.compile(r"\s*([(),;])|\s*([A-Za-z0-9_.]*)\[([+-])\](?::([-+0-9.eE]+))?")


def parse_tree(text: str, labels: list[Label]) -> Node:
    """A tree of two-way branches; every node's label must name exactly one of the block's sequences."""
    tokens = [m for m in _TOKEN.finditer(text) if m[0].strip()]
    at = 0

    def named(m: re.Match) -> Label:
        name = f"{m[2]}[{m[3]}]"
        hits = [x for x in labels if x.short() == name]
        if len(hits) != 1:
            raise ValueError(f"{'no' if not hits else 'more than one'} sequence is named {name}")
        return hits[0]

    def node() -> Node:
        nonlocal at
        children = []
        if tokens[at][1] == "(":
            while tokens[at][1] in ("(", ","):
                at += 1
                children.append(node())
            at += 1  # the closing bracket
        label = named(tokens[at])
        at += 1
        return Node(label, children)

    return node()


def by_species(tree: Node, ref: tuple[str, str], target: tuple[str, str]) -> list[tuple[Label, list[Label]]]:
    """Each reference sequence of a side without the target, with the target's sequences of the other side."""
    return _paired(tree, ref, target, lambda _, found: found)


def by_ancestor(tree: Node, ref: tuple[str, str], other: tuple[str, str]) -> list[tuple[Label, list[Label]]]:
    """As by_species, but with the root of that subtree, the common ancestor."""
    return _paired(tree, ref, other, lambda node, _: [node.label])


def _paired(tree: Node, ref, target, pick) -> list[tuple[Label, list[Label]]]:
    if not tree.children:
        return []
    left, right = tree.children
    for here, there in ((left, right), (right, left)):
        found = there.leaves(target)
        if found and not here.leaves(target):
            return [(h, pick(tree, found)) for h in here.leaves(ref)] + _paired(there, ref, target, pick)
    return _paired(left, ref, target, pick) + _paired(right, ref, target, pick)


def parse_emf(text: str) -> Iterator[tuple[list[Label], str, list[str]]]:
    """(labels, tree, upper-case sequences) of each block."""
    labels: list[Label] = []
    tree, columns, inside = "", [], False
    for line in text.splitlines():
        if inside:
            if line.startswith("//"):
                yield labels, tree, ["".join(c) for c in zip(*columns, strict=True)]
                labels, tree, columns, inside = [], "", [], False
            else:
                columns.append(line.upper())
        elif line.startswith("SEQ "):
            w = line.split()
            species, _, race = w[1].partition("_")
            labels.append(Label(len(labels), species, race, w[2], int(w[3]) - 1, int(w[4]) - int(w[3]) + 1, w[5] != "1"))
        elif line.startswith("TREE "):
            tree = line[5:]
        elif line.startswith("DATA"):
            inside = True


def _consensus(texts: list[str]) -> str:
    if len({len(t) for t in texts}) > 1:
        raise ValueError("texts of unequal length")
    return "".join(c[0] if len(set(c)) == 1 else "N" for c in zip(*texts, strict=True))


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def read_emf(spark: SparkSession, paths: list[str] | str, ref_species: tuple[str, str] = ("homo", "sapiens"), sample: tuple[str, str] | None = None, ancestor_of: tuple[str, str] | None = ("pan", "troglodytes"), contigs: DataFrame | None = None) -> DataFrame:
    """Blocks (ord, block, chrom, start, ref_seq, smp_seq[, chrom_ix, len]) of a sample species, or of the common ancestor with one.

    A folder stands for all its *.emf.gz files. Columns where the reference has a gap are removed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, path, content in zip(f["file"], f["path"], f["content"], strict=True):
                out, n = [], 0
                for labels, tree, seqs in parse_emf(decompressed(bytes(content)).decode()):
                    root = parse_tree(tree, labels)
                    for r, found in by_species(root, ref_species, sample) if sample else by_ancestor(root, ref_species, ancestor_of):
                        pairs = [(a, b) for a, b in zip(seqs[r.index], _consensus([seqs[x.index] for x in found]), strict=True) if a != "-"]
                        a, b = "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)
                        if r.reverse:
                            a, b = a[::-1].translate(_COMPLEMENT), b[::-1].translate(_COMPLEMENT)
                        out.append(((file, path, n, 0), n, r.chrom, r.start, a, b))
                        n += 1
                yield pd.DataFrame(out, columns=["ord", "block", "chrom", "start", "ref_seq", "smp_seq"])

    folder = isinstance(paths, str) and not paths.endswith((".emf", ".gz"))
    files = opened(spark, [paths] if isinstance(paths, str) else paths, "*.emf.gz" if folder else None)
    blocks = files.mapInPandas(run, BLOCKS)
    return blocks if contigs is None else chrom_index(blocks, contigs).withColumn("len", F.length("ref_seq"))


def import_blocks(blocks: DataFrame, contigs: DataFrame, sample_ix: int = 0) -> tuple[DataFrame, DataFrame]:
    """(runs, blocks with overlap warnings) of alignment blocks (ord, chrom_ix, start, len, ref_seq, smp_seq).

    ord is the blocks' place in the input, any sortable value that two evaluations give alike and no two blocks share; of
    blocks of one start the last counts.
    """
    from alleloom import schema as S
    from alleloom.operators import runs as R

    extent = blocks.select("chrom_ix", "start", "len", "ord")
    warned = R.block_overlaps(extent)
    placed = R.assemble(extent, contigs)
    kept = placed.where("ord is not null").select("ord").join(blocks.select("ord", "chrom_ix", "start", "ref_seq", "smp_seq"), "ord")
    runs = R.coded(kept.select(F.lit(sample_ix).alias("sample_ix"), "chrom_ix", "start", "ref_seq", "smp_seq"))
    gaps = placed.where("ord is null").select(F.lit(sample_ix).alias("sample_ix"), "chrom_ix", "run_start", "run_end", F.lit(S.NS).alias("code"))
    return R.normalize(runs.unionByName(gaps)), warned
