"""Data model: bases, changes, run codes and table schemas.

A sample is a set of runs against a reference: half-open, 0-based intervals with a code. Bases are 2-bit numbers, a
change is the XOR of a base with the reference base. "Uncalled" is a code of its own and never the absence of a row.
"""

from __future__ import annotations

#: Fixed values of the file format: the order of bases in two bits.
BASES = "TCAG"
#: Fixed value: the change of a pseudo-variant (a site at which nobody differs), and the base N.
PSEUDO = 255

#: Run codes. Point codes equal their byte in the run file; 0, 4 and 14 stand for the stretch kinds.
NS, EQS1, EQS2 = 0, 4, 14
TRANS1, COMPL1, TCOMPL1, REFTRANS, TRANS2, REFCOMPL, TRANSCOMPL, COMPL2, REFTCOMPL, TRANSTCOMPL, COMPLTCOMPL, TCOMPL2 = 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13
DEL1, INS1, DELH, INSH, DEL2, INS2 = 0x10, 0x18, 0x20, 0x28, 0x30, 0x38
BREAK = -1
STRETCHES = (NS, EQS1, EQS2)
INDELS = (DEL1, INS1, DELH, INSH, DEL2, INS2)

#: Alleles of each point code as changes to the reference; one allele: haploid.
ALLELES: dict[int, tuple[int, ...]] = {
    EQS1: (0,), TRANS1: (1,), COMPL1: (2,), TCOMPL1: (3,),
    EQS2: (0, 0), REFTRANS: (0, 1), TRANS2: (1, 1), REFCOMPL: (0, 2), TRANSCOMPL: (1, 2), COMPL2: (2, 2),
    REFTCOMPL: (0, 3), TRANSTCOMPL: (1, 3), COMPLTCOMPL: (2, 3), TCOMPL2: (3, 3),
}
CODE_OF = {tuple(sorted(v)): k for k, v in ALLELES.items()}
NAMES = {NS: "Ns", EQS1: "Eqs1", EQS2: "Eqs2", TRANS1: "Trans1", COMPL1: "Compl1", TCOMPL1: "TCompl1", REFTRANS: "RefTrans", TRANS2: "Trans2", REFCOMPL: "RefCompl", TRANSCOMPL: "TransCompl", COMPL2: "Compl2", REFTCOMPL: "RefTCompl", TRANSTCOMPL: "TransTCompl", COMPLTCOMPL: "ComplTCompl", TCOMPL2: "TCompl2", DEL1: "Del1", DELH: "DelH", DEL2: "Del2", INS1: "Ins1", INSH: "InsH", INS2: "Ins2", BREAK: "Break"}

#: Ambiguity letters and the two bases they stand for.
IUPAC = {"T": "TT", "C": "CC", "A": "AA", "G": "GG", "S": "CG", "W": "AT", "M": "AC", "K": "GT", "R": "AG", "Y": "CT"}
LETTER_OF = {"".join(sorted(v)): k for k, v in IUPAC.items()}


def counts(code: int, change: int) -> tuple[int, int]:
    """(reference, alternative) alleles of a code for one change; a genotype with any other allele counts as missing."""
    alleles = ALLELES.get(code, ())
    if any(a not in (0, change) for a in alleles):
        return 0, 0
    return sum(a == 0 for a in alleles), sum(a == change for a in alleles)


def code_of(ref: int, *alleles: int) -> int:
    """The code of a genotype of bases; NS where a base is unknown."""
    if not 0 <= ref < 4 or not alleles or any(not 0 <= a < 4 for a in alleles):
        return NS
    return CODE_OF[tuple(sorted(a ^ ref for a in alleles))]


def haploid(code: int) -> int:
    """Homozygous and stretch codes as haploid ones; heterozygous codes stay."""
    if code in (DEL2, INS2):
        return code - 0x20
    alleles = ALLELES.get(code, ())
    return CODE_OF[alleles[:1]] if len(alleles) == 2 and alleles[0] == alleles[1] else code


RUNS = "sample_ix int, chrom_ix int, run_start int, run_end int, code int"
RUNS_INS = RUNS + ", ins string"
CONTIGS = "chrom_ix int, name string, length int"
CHUNKS = "chrom_ix int, start int, seq string"
BED = "chrom_ix int, s int, e int"
PILEUP = "chrom_ix int, pos int, a int, c int, g int, t int, ar int, cr int, gr int, tr int"
