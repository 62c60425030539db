"""Column functions of variants: bases, counts, names and genotype symbols. All stay in the JVM."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from alleloom import schema as S


def _by_code(code: Column, values: dict[int, int]) -> Column:
    """A small lookup as one CASE by value, zero elsewhere."""
    out = F.lit(0)
    for v in sorted(set(values.values()) - {0}):
        out = F.when(code.isin([k for k, x in values.items() if x == v]), v).otherwise(out)
    return out


def n_ref(code: Column, alt: Column | int) -> Column:
    """Reference alleles of a run code for a change (1, 2, 3)."""
    per = {a: _by_code(code, {c: S.counts(c, a)[0] for c in S.ALLELES}) for a in (1, 2, 3)}
    if isinstance(alt, int):
        return per[alt].cast("int")
    return F.when(alt == 1, per[1]).when(alt == 2, per[2]).otherwise(per[3]).cast("int")


def n_alt(code: Column, alt: Column | int) -> Column:
    """Alternative alleles of a run code for a change (1, 2, 3)."""
    per = {a: _by_code(code, {c: S.counts(c, a)[1] for c in S.ALLELES}) for a in (1, 2, 3)}
    if isinstance(alt, int):
        return per[alt].cast("int")
    return F.when(alt == 1, per[1]).when(alt == 2, per[2]).otherwise(per[3]).cast("int")


def make_hap(code: Column) -> Column:
    out = code
    for c in (*S.ALLELES, S.DEL2, S.INS2):
        if S.haploid(c) != c:
            out = F.when(code == c, S.haploid(c)).otherwise(out)
    return out.cast("int")


def code_from(ref: Column, a1: Column, a2: Column | None = None) -> Column:
    """The run code of two bases (or one, haploid) at a reference base; NS for anything out of range."""
    ok = (ref >= 0) & (ref < 4) & (a1 >= 0) & (a1 < 4)
    x = a1.bitwiseXOR(ref)
    if a2 is None:
        return F.when(ok, F.coalesce(*(F.when(x == v, S.CODE_OF[(v,)]) for v in range(4)))).otherwise(S.NS).cast("int")
    ok = ok & (a2 >= 0) & (a2 < 4)
    y = a2.bitwiseXOR(ref)
    lo, hi = F.least(x, y), F.greatest(x, y)
    both = F.coalesce(*(F.when((lo == p) & (hi == q), S.CODE_OF[(p, q)]) for p in range(4) for q in range(p, 4)))
    return F.when(ok, both).otherwise(S.NS).cast("int")


def apply_change(ref: Column, alt: Column) -> Column:
    return ref.bitwiseXOR(alt)


def base_char(base: Column) -> Column:
    return F.when((base >= 0) & (base < 4), F.substring(F.lit(S.BASES), base + 1, F.lit(1))).otherwise("N")


def base_code(char: Column) -> Column:
    """0..3, or null for anything that is not a base."""
    at = F.instr(F.lit(S.BASES), F.upper(char))
    return F.when(F.length(char) == 1, F.when(at > 0, at - 1)).cast("int")


def alt_char(ref: Column, alt: Column) -> Column:
    """The alternative base; "." for a pseudo-variant; I, O, P, X by change where the reference is unknown."""
    known = ref.isNotNull() & (ref >= 0) & (ref < 4)
    return F.when(alt > 4, ".").when(known, base_char(apply_change(ref, alt))).otherwise(F.substring(F.lit("IOPX"), alt + 1, F.lit(1)))


def is_transversion(alt: Column) -> Column:
    return alt.bitwiseAND(F.lit(2)) != 0


def is_known(base: Column) -> Column:
    return base.isNotNull() & (base >= 0) & (base < 4)


#: Fixed value: the digits of SNP names.
DIGITS = "0123456789ABCDEFGHKLMNPQRSTUWXYZ"


def snp_name(chrom_ix: Column, pos: Column, alt_base: Column) -> Column:
    """Base-32 digits, lowest first, of 4 * pos + number of the allele (A C G other), then the chromosome's digit."""
    value = pos.cast("long") * 4 + F.when(F.upper(alt_base) == "A", 0).when(F.upper(alt_base) == "C", 1).when(F.upper(alt_base) == "G", 2).otherwise(3)
    digit = lambda k: F.when(F.shiftright(value, 5 * k) > 0, F.substring(F.lit(DIGITS), F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))).otherwise("")
    return F.concat(*(digit(k) for k in range(8)), F.substring(F.lit(DIGITS), chrom_ix + 1, F.lit(1)))


def eigen_chrom(chrom_ix: Column) -> Column:
    return F.when(chrom_ix == 24, 90).otherwise(chrom_ix + 1).cast("int")


def geno_char(ref: Column, alt: Column) -> Column:
    return F.when((ref == 0) & (alt == 0), "9").when(alt == 0, "2").when(ref == 0, "0").otherwise("1")


def vcf_gt(ref: Column, alt: Column) -> Column:
    """Genotype symbol of (n_ref, n_alt)."""
    return F.when((ref == 0) & (alt == 0), "./.").when((ref == 1) & (alt == 0), "0").when((ref == 0) & (alt == 1), "1").when(alt == 0, "0/0").when(ref == 0, "1/1").otherwise("0/1")


def label_of(path: str) -> str:
    """A file's base name without its last extension."""
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def patched_char(ref: Column, code: Column) -> Column:
    """The letter of a point or stretch code at a reference base, from a string of 4 x 15 letters; N where uncalled, deletions as "-"."""
    table = "".join(S.LETTER_OF["".join(sorted(S.BASES[r ^ a] for a in (S.ALLELES[c] * 2)[:2]))] if c in S.ALLELES else "N" for r in range(4) for c in range(15))
    inside = (ref >= 0) & (ref < 4) & (code >= 0) & (code < 15)
    return F.when(code.isin(S.DEL1, S.DEL2), "-").when(inside, F.substring(F.lit(table), ref * 15 + code + 1, F.lit(1))).otherwise(F.when(code == S.DELH, base_char(ref)).otherwise("N"))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def size_of(text: str) -> int:
    """A number with an optional suffix k, M or G (powers of a thousand)."""
    t = text.strip()
    power = {"k": 3, "m": 6, "g": 9}.get(t[-1:].lower(), 0)
    return int(t[:-1] if power else t) * 10**power


def fixed(x: float | None, digits: int) -> str:
    """A number with that many decimals, halves away from zero."""
    if x is None or x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    return f"{Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}"


def scientific(x: float | None, digits: int) -> str:
    """A number as d.ddde-n, the exponent without padding."""
    if x is None or x != x:
        return "NaN"
    if not x:
        return f"0.{'0' * digits}e0"
    power = Decimal(repr(float(x))).adjusted()
    head = Decimal(repr(float(x))).scaleb(-power).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    if abs(head) >= 10:
        head, power = head / 10, power + 1
    return f"{head:.{digits}f}e{power}"


def p_text(p: float | None) -> str:
    """Three decimals from 0.002 on, exponent form with one below."""
    return fixed(p, 3) if p is None or not p < 0.002 else scientific(p, 1)
