"""The run file: one sample's runs against a reference, chromosome after chromosome, byte by byte.

Header: magic "HEF" and version 3, the reference's path ended by a zero byte, a 32-bit token of the reference. Then the
runs of each chromosome, each ended by a zero byte (the rest of it is uncalled). Versions 0 and 1 are the older format
of symbol pairs, which needs the reference to be turned into runs. The reference's token is this library's own digest
of names and lengths; files with another token are accepted only with check=False.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.operators.sweep import WIDTH, dealt, whole_groups
from alleloom.sources.files import decompressed, opened

Run = tuple[int, int, str | None]  # code, length, inserted bases
#: The three kinds of stretches by their two high bits, and announced lengths from this one on.
_STRETCH = {0x40: S.NS, 0x80: S.EQS1, 0xC0: S.EQS2}
_STRETCH_BYTE = {v: k for k, v in _STRETCH.items()}
_INLINE = 0x3C
#: First bytes of old files without a header.
_BARE = (b"\xb0\x71\x02", b"\xb1\x71\x02")
MAGIC = b"HEF"


def token(names: list[str], lengths: list[int]) -> int:
    """A 32-bit token of a reference's names and lengths."""
    return zlib.crc32("\n".join(f"{n}\t{x}" for n, x in zip(names, lengths, strict=True)).encode())


def encode(runs: list[Run], close: bool = True) -> bytes:
    """The runs of one chromosome, with the closing byte, or of a piece of one that isn't its last, without."""
    out = bytearray()
    for code, length, ins in runs:
        if code in _STRETCH_BYTE:
            if length <= 0:
                continue
            kind = _STRETCH_BYTE[code]
            if length < _INLINE:
                out.append(kind | length)
            else:
                size = max(1, (length.bit_length() + 7) // 8)
                if size > 4:
                    raise ValueError("stretch too long")
                out += bytes([kind | (0x40 - size)]) + length.to_bytes(size, "little")
        elif code in S.INDELS:
            n = len(ins or "") if code in (S.INS1, S.INSH, S.INS2) else length
            if n > 255:
                raise ValueError("indel longer than 255")
            out += bytes([code | n]) if 0 < n < 8 else bytes([code, n])
            if code in (S.INS1, S.INSH, S.INS2):
                two = [S.BASES.index(c) for c in ins or ""]
                out += bytes(sum(b << (2 * k) for k, b in enumerate(two[i : i + 4])) for i in range(0, n, 4))
        elif code in S.ALLELES:
            out += bytes([code]) * length
        else:
            raise ValueError(f"no such code: {code}")
    if close:
        out.append(0)
    return bytes(out)


def decode(data: bytes, at: int = 0) -> Iterator[list[Run]]:
    """The runs of each chromosome in turn; what follows the last closing byte is a chromosome of its own."""
    runs: list[Run] = []
    n = len(data)
    while at < n:
        b = data[at]
        at += 1
        if b == 0:
            yield runs
            runs = []
        elif b < 0x10:
            if b not in S.ALLELES or b in S.STRETCHES:
                raise ValueError(f"reserved code {b:#x}")
            runs.append((b, 1, None))
        elif b < 0x40:
            code, size = b & 0x38, b & 7
            if not size:
                size = data[at]
                at += 1
            ins = None
            if code in (S.INS1, S.INSH, S.INS2):
                packed = data[at : at + (size + 3) // 4]
                at += len(packed)
                ins = "".join(S.BASES[packed[i // 4] >> (2 * (i % 4)) & 3] for i in range(size))
            runs.append((code, size, ins))
        else:
            size = b & 0x3F
            if size >= _INLINE:
                k = 0x40 - size
                size = int.from_bytes(data[at : at + k], "little")
                at += k
            runs.append((_STRETCH[b & 0xC0], size, None))
    if runs:
        yield runs


def positioned(runs: list[Run]) -> Iterator[tuple[int, int, int, str | None]]:
    """(start, end, code, inserted bases); insertions have no width."""
    at = 0
    for code, n, ins in runs:
        width = 0 if code in (S.INS1, S.INSH, S.INS2) else n
        yield at, at + width, code, ins
        at += width


# --- the older format -------------------------------------------------------------------------

#: Fixed value: symbols of the older format; two to a byte, the first counting one, the second eleven.
OLD_SYMBOLS = "NACGTMRWSYK"


def decode_old(data: bytes, haploid: bool, at: int = 0) -> Iterator[list[tuple[str, int, str | None]]]:
    """Chromosomes of the older format as ("N" or "=" stretch, length) and ("*", 1, letter) items."""
    items: list[tuple[str, int, str | None]] = []
    n = len(data)
    while at < n:
        b = data[at]
        at += 1
        if b < 0x80:
            for x in (b % 11, b // 11):
                items.append(("*", 1, OLD_SYMBOLS[x].lower() if haploid and 1 <= x <= 4 else OLD_SYMBOLS[x]))
        elif b == 0x80:
            yield items
            items = []
        else:
            kind, low = ("N", b - 0x80) if b < 0xC0 else ("=", b - 0xC0)
            # a prefix of ones tells how many bytes follow; each takes one bit of the first byte
            more = 0
            while low & (0x20 >> more) and more < 5:
                more += 1
            bits = 5 - more
            if bits < 1:
                raise ValueError(f"unexpected byte {b:#x}")
            size = low & ((1 << bits) - 1)
            for k in range(more):
                size |= data[at + k] << (bits + 8 * k)
            at += more
            items.append((kind, 2 * size, None))
    if items:
        yield items


#: Codes of letters of the older format that still wait for their reference base: _WAITS less the letter.
_WAITS = -1000


def old_runs(items: list[tuple[str, int, str | None]], haploid: bool, swap_ac: bool = False) -> Iterator[tuple[int, int, int, str | None]]:
    """Items of the older format as runs; letters become codes below _WAITS. swap_ac reads A as C and C as A, as files of
    some writers need."""
    swap, at = str.maketrans("ACac", "CAca"), 0
    for kind, n, letter in items:
        code = S.NS if kind == "N" else S.EQS1 if haploid else S.EQS2
        if kind == "*":
            code = _WAITS - ord(letter.translate(swap) if swap_ac else letter)
        yield at, at + n, code, None
        at += n


def _old_code(ref: str, letter: str) -> int:
    pair = S.IUPAC.get(letter.upper())
    alleles = [S.BASES.index(x) for x in pair] if pair else []
    return S.code_of(S.BASES.find(ref), *(alleles[:1] if letter.islower() else alleles)) if ref in S.BASES and alleles else S.NS


def modernised(runs: DataFrame, contigs: DataFrame, chunks: DataFrame) -> DataFrame:
    """runs of old files with the codes that their letters have at the reference: a join on reference chunks."""
    size = chunks.agg(F.max(F.length("seq"))).first()[0]
    letters = "".join(dict.fromkeys(OLD_SYMBOLS + OLD_SYMBOLS[1:5].lower()))
    table = F.create_map(*(F.lit(x) for r in S.BASES for q in letters for x in (r + q, _old_code(r, q))))
    waits = runs.where(F.col("code") <= _WAITS).withColumn("start", (F.floor(F.col("run_start") / size) * size).cast("int"))
    # letters beyond the reference have no row there
    met = waits.join(chunks.select("chrom_ix", "start", "seq"), ["chrom_ix", "start"]).where("run_start - start < length(seq)")
    ref = F.upper(F.expr("substring(seq, run_start - start + 1, 1)"))
    code = F.coalesce(F.element_at(table, F.concat(ref, F.char(F.lit(_WAITS) - F.col("code")))), F.lit(S.NS))
    rest = runs.where(F.col("code") > _WAITS).join(contigs.select("chrom_ix", "length"), "chrom_ix").where("run_start < length").withColumn("run_end", F.least("run_end", "length"))
    return rest.select(runs.columns).unionByName(met.withColumn("code", code).select(runs.columns))


def joined(runs: list[Run]) -> list[Run]:
    """Adjacent stretches of one code as one."""
    out: list[Run] = []
    for code, n, ins in runs:
        if code in S.STRETCHES and out and out[-1][0] == code:
            out[-1] = (code, out[-1][1] + n, None)
        elif n or ins:
            out.append((code, n, ins))
    return out


# --- files ------------------------------------------------------------------------------------


def header(reference_path: str, ref_token: int) -> bytes:
    return MAGIC + b"\3" + reference_path.encode() + b"\0" + struct.pack("<I", ref_token)


def kind_of(data: bytes) -> tuple[int, str | None, int | None]:
    """(version, reference path, reference token) of a file's first bytes; the older versions 0 and 1 have neither."""
    if data[:4] == MAGIC + b"\3":
        end = data.index(b"\0", 4)
        return 3, data[4:end].decode(), struct.unpack("<I", data[end + 1 : end + 5])[0]
    if data[:4] in (MAGIC + b"\0", MAGIC + b"\1"):
        return data[3], None, None
    if data[:3] in _BARE:
        return 0, None, None
    raise ValueError("file format not recognised")


def parse(data: bytes, swap_ac: bool = False) -> Iterator[Iterator[tuple[int, int, int, str | None]]]:
    """Runs (start, end, code, inserted bases), chromosome by chromosome, of a file of any version."""
    data = decompressed(data)
    version, path, _ = kind_of(data)
    if version == 3:
        yield from map(positioned, decode(data, 4 + len(path.encode()) + 5))
    else:
        chroms = decode_old(data, version == 1, 4 if data[:3] == MAGIC else 0)
        yield from (old_runs(c, version == 1, swap_ac) for c in chroms)


def headers(spark: SparkSession, paths: list[str]) -> list[tuple[int, str | None, int | None]]:
    """kind_of() each file; only the beginnings of files come to the driver."""
    begins = opened(spark, paths).select("file", F.substring("content", 1, 8192).alias("begin")).orderBy("file").collect()
    out = []
    for r in begins:
        begin = bytes(r["begin"])
        out.append(kind_of(zlib.decompressobj(31).decompress(begin, 8192) if begin[:2] == b"\x1f\x8b" else begin))
    return out


def read_runs(spark: SparkSession, paths: list[str], reference: tuple[DataFrame, DataFrame] | None = None, check: bool = True, swap_ac: bool = False) -> DataFrame:
    """(sample_ix, chrom_ix, run_start, run_end, code, ins) of run files; sample_ix is the order of paths, one task a file.

    reference: its (contigs, chunks). With it, files that were written against another one are an error unless check is
    False; old files can't be read without it.
    """
    kinds = headers(spark, paths)
    old = any(version != 3 for version, _, _ in kinds)
    if old and reference is None:
        raise ValueError("an old file can't be read without its reference")
    if reference is not None and check:
        c = reference[0].orderBy("chrom_ix").collect()  # one row for each chromosome
        own = token([r["name"] for r in c], [r["length"] for r in c])
        for p, (_, _, its) in zip(paths, kinds, strict=True):
            if its not in (None, own):
                raise ValueError(f"incompatible reference genome: {p}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ix, content in zip(frame["file"], frame["content"], strict=True):
                for c, runs in enumerate(parse(bytes(content), swap_ac)):
                    yield pd.DataFrame([(ix, c, *x) for x in runs], columns=["sample_ix", "chrom_ix", "run_start", "run_end", "code", "ins"])

    runs = opened(spark, paths).mapInPandas(run, S.RUNS_INS)
    return modernised(runs, *reference) if old else runs


def _filled(runs: DataFrame, width: int) -> DataFrame:
    """Runs with uncalled ones before them where something is left out: how far the runs before reach is known within a bin,
    and of the bins before from a row for each."""
    key = ("sample_ix", "chrom_ix")
    r = dealt(runs.withColumn("_bin", F.floor(F.col("run_start") / width)), *key, "_bin")
    own = Window.partitionBy(*key, "_bin").orderBy("run_start", "run_end").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy(*key, "_bin").agg(F.max("run_end").alias("_end")).select(*key, "_bin", F.max("_end").over(along).alias("_reach"))
    # nulls don't count
    met = r.withColumn("_own", F.max("run_end").over(own)).join(before, [*key, "_bin"]).withColumn("_at", F.greatest("_own", "_reach", F.lit(0)))
    gap = met.where("run_start > _at").select(*key, F.col("_at").alias("run_start"), F.col("run_start").alias("run_end"), F.lit(S.NS).alias("code"), F.lit(None).cast("string").alias("ins"), F.lit(0).alias("_order"))
    return gap.unionByName(met.select(*key, "run_start", "run_end", "code", "ins", F.lit(1).alias("_order")))


def encoded(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(sample_ix, chrom_ix, start, data): the bytes of each sample's chromosomes; positions without a run are uncalled.

    A chromosome comes in pieces, one for each bin of `width` in which a run begins that isn't joined to one before it; in
    order of start they are its bytes. No task holds a chromosome's runs: of a bin's joined runs only those at its ends can go
    on in other bins.
    """
    key = ("sample_ix", "chrom_ix")
    every = runs if "ins" in runs.columns else runs.withColumn("ins", F.lit(None).cast("string"))
    bin_ = F.floor(F.col("run_start") / width).cast("int").alias("_bin")
    each = _filled(every.select(*(F.col(c).cast("int").alias(c) for c in (*key, "run_start", "run_end", "code")), "ins"), width).where((F.col("run_end") > F.col("run_start")) | F.col("ins").isNotNull())
    own = _joined_in(dealt(each.select("*", bin_), *key, "_bin"), (*key, "_bin"))
    w = Window.partitionBy(*key, "_bin")
    edge = (F.col("run_start") == F.min("run_start").over(w)) | (F.col("run_start") == F.max("run_start").over(w))
    own = own.withColumn("_edge", edge)
    across = _joined_in(own.where("_edge").drop("_edge", "_bin"), key)
    whole = own.where("not _edge").drop("_edge", "_bin").unionByName(across)
    # the last piece of a chromosome closes it
    top = across.groupBy(*key).agg(F.max(F.floor(F.col("run_start") / width)).cast("int").alias("_top"))
    pieces = whole.select("*", bin_).join(F.broadcast(top), [*key])  # a row for each chromosome of a sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3, 1 << 15):
            rows = t.to_pydict()
            n = t.num_rows
            at = [i for i in range(n) if not i or any(rows[c][i] != rows[c][i - 1] for c in (*key, "_bin"))]
            data = [encode([(rows["code"][i], rows["run_end"][i] - rows["run_start"][i], rows["ins"][i]) for i in range(a, b)], rows["_bin"][a] == rows["_top"][a]) for a, b in zip(at, [*at[1:], n], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([rows[c][a] for a in at], pa.int32()) for c in (*key, "run_start")), pa.array(data, pa.binary())], names=[*key, "start", "data"])

    order = (*key, "_bin", "run_start", "_order", "run_end")
    ready = dealt(pieces, *key, "_bin").sortWithinPartitions(*order).select(*key, "_bin", "run_start", "run_end", "code", "ins", "_top")
    return ready.mapInArrow(run, "sample_ix int, chrom_ix int, start int, data binary")


def _joined_in(runs: DataFrame, part: tuple[str, ...]) -> DataFrame:
    """Adjacent stretches of one code within a part as one; an insertion between them keeps them apart."""
    w = Window.partitionBy(*part).orderBy("run_start", "_order", "run_end")
    before = F.lag("run_end").over(w)
    joins = F.col("code").isin(*S.STRETCHES) & (F.col("code") == F.lag("code").over(w)) & (before == F.col("run_start"))
    last = F.last("run_end").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = runs.withColumns({"_joins": F.coalesce(joins, F.lit(False)), "_before": before, "_last": last}).where("not _joins")
    end = F.coalesce(F.lead("_before").over(w), F.col("_last"))
    return begins.select(*part, "run_start", F.when(F.col("code").isin(*S.STRETCHES), end).otherwise(F.col("run_end")).alias("run_end"), "code", "ins", "_order")


def decoded(data: DataFrame) -> DataFrame:
    """Runs of encoded chromosomes, or of their pieces, which begin at `start`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s, c, at, d in zip(f["sample_ix"], f["chrom_ix"], f["start"] if "start" in f else [0] * len(f), f["data"], strict=True):
                for runs in decode(bytes(d)):
                    yield pd.DataFrame([(s, c, at + a, at + z, *x) for a, z, *x in positioned(runs)], columns=["sample_ix", "chrom_ix", "run_start", "run_end", "code", "ins"])

    return data.mapInPandas(run, S.RUNS_INS)
