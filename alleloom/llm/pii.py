"""Personal data: surrogate generation.

Entities are found in whole texts: mail and network addresses, phone numbers, card and account numbers with valid check
digits, social security numbers in use, secrets, names after a title, and these names wherever else the document writes
them as words of their own, with capitals: a person stays one with and without the title, and no clear name stays beside
its surrogate. A document's untitled names that never have a title in it are not found. Each distinct entity, in canonical form, gets one
surrogate for the whole corpus, made from a keyed digest of (kind, entity, attempt), so equal entities stay equal
(coreference, across layouts and, but for secrets, case) and nothing can be undone without the key. A surrogate has its
entity's kind, script and format: digits of the script for digits, letters of the script for letters, in a secret upper
case for upper case, valid check digits, a name of the title's gender where the script's names tell it, reserved network
ranges and mail domains. An occurrence is rewritten in its own layout and case.

Collision checks keep distinct entities distinct, over all kinds and without regard to case: a surrogate that another entity
has, or that is itself an entity of the corpus, is refused, and the entity draws again with the next attempt, in rounds,
until none is left. Later attempts draw from larger spaces (longer names and mail addresses, all digits), so rounds are few;
if a kind has more entities than surrogates, `ATTEMPTS` rounds end in an error. Given and family names are entities of
their own, so "Mrs. Anna Berg" and "Mrs. Berg" stay one family.

Defined results: null stays null, empty stays empty; texts without entities are unchanged; of overlapping finds the
first in the order of KINDS counts; rows of one id and one text are rewritten alike; extra columns go along.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alleloom.llm.common import keyed, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Marks that stand on letters and are no letters themselves.
_MARK = "\u0300-\u036f\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0981-\u0983\u09bc-\u09cd\u0bbe-\u0bcd\u0e31-\u0e4e"
_NAME = rf"[^\W\d_a-zß-öø-ÿа-яёα-ω](?:[^\W\d_]|[{_MARK}])*(?:[-'’](?:[^\W\d_]|[{_MARK}])+)*"
#: Titles and the gender that they tell.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Srta": "f", "Госпожа": "f", "Dr": "n", "Prof": "n"}
_WORD = re.compile(rf"(?<![\w-]){_NAME}(?![\w@])")
_POSSESSIVE = re.compile(r"['’][sS]?$")
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
KINDS: tuple[tuple[str, re.Pattern], ...] = (
    ("secret", re.compile(r"(?i)\b(?:token|api[_-]?key|access[_-]?key|secret|passw(?:or)?d)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_\-]{12,})")),
    ("mail", re.compile(r"[\w.%+-]*\w[\w%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("phone", re.compile(r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}([ .-])\d{3}\1\d{4}(?![\w-])(?!\.\d)|(?<![\w.-])0\d{1,4}[ /-]\d{5,8}(?![\w-])(?!\.\d)")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{4}[ -]){3}\d{4}(?![\w-])|(?<![\w.])\d{13,19}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("name", re.compile(rf"\b({_TITLE})\.?[  ]({_NAME})(?:[  ]({_NAME}))?")),
)
_HINT = {"secret": re.compile(r"(?i)token|key|secret|passw"), "mail": re.compile("@"), "name": re.compile(rf"\b(?:{_TITLE})\b")}
_DIGIT = re.compile(r"\d\d|\d\.\d")
#: Syllables of made-up names, and endings that tell a gender, or a family name.
SYLLABLES = {"latin": "ba be bo da de do fa fe fi ga go ha he jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi vo wa we za ze".split(), "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ко ла ле ло ма ме ми мо на не ни но па пе по ра ре ро са се со та те то".split(), "greek": "βα βε βο γα γε δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρο σα σε τα τε το".split()}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "l", "family": "rd"}, "cyrillic": {"m": "н", "f": "я", "n": "ль", "family": "нко"}, "greek": {"m": "ς", "f": "η", "n": "ν", "family": "δης"}, "arabic": {"f": "ة"}, "hebrew": {"f": "ה"}, "han": {"m": "伟", "f": "丽"}}
#: First and last letter from which a script's surrogates draw; a script begins where its first block does.
LETTERS = {"latin": "az", "greek": "αω", "cyrillic": "ая", "armenian": "աֆ", "hebrew": "את", "arabic": "بغ", "devanagari": "कह", "bengali": "কন", "tamil": "யஹ", "thai": "กฮ", "georgian": "აჰ", "hangul": "가힣", "hiragana": "かの", "katakana": "カノ", "han": "一龠"}
_BLOCKS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xB80, "tamil"), (0xE00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x3040, "hiragana"), (0x30A0, "katakana"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "latin"), (0xAC00, "hangul"), (0xD7B0, "latin"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE20, "latin"), (0x20000, "han"))
_STARTS = [at for at, _ in _BLOCKS]
#: Draws after which the surrogates of a kind count as used up.
ATTEMPTS = 300


def script_of(text: str) -> str:
    """The script of the first letter."""
    for c in text:
        if c.isalpha():
            return _BLOCKS[max(0, bisect_right(_STARTS, ord(c)) - 1)][1]
    return "latin"


def _solid(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _in_use(ssn: str) -> bool:
    return ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn[3:5] != "00" and ssn[5:] != "0000"


#: What a find of a kind must fulfil besides its pattern.
CHECKED = {"card": luhn, "iban": lambda x: _iban_number(x) % 97 == 1, "ssn": _in_use}


def _again(text: str, got: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Words that are written as names and are names that got has after a title: the same persons without it.

    A word that is a given and a family name is given before a word that is a family name, else family; of several kinds
    of one role the first in the text counts. A word that a name joins by a hyphen is a name of its own.
    """
    given: dict[str, str] = {}
    family: dict[str, str] = {}
    for _, _, kind, entity in got:
        if kind.startswith(("given-", "family-")):
            (given if kind.startswith("given-") else family).setdefault(entity, kind)
    if not family:
        return []
    words = []
    for m in _WORD.finditer(text):
        said = _POSSESSIVE.sub("", m[0])
        low = said.casefold()
        if low in given or low in family:
            words.append((m.start(), m.start() + len(said), low))
    found = []
    for i, (start, end, low) in enumerate(words):
        before_family = i + 1 < len(words) and words[i + 1][2] in family and text[end : words[i + 1][0]] in (" ", "\u00a0")
        kind = given[low] if low in given and (before_family or low not in family) else family[low]
        found.append((start, end, kind, low))
    return found


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity), in order and without overlap."""
    got: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern in KINDS:
        if not (_HINT[kind].search(text) if kind in _HINT else digits):
            continue
        for m in pattern.finditer(text):
            if kind in CHECKED and not CHECKED[kind](_solid(m[0])):
                continue
            if kind == "secret":
                got.append((*m.span(1), kind, m[1]))
            elif kind == "mail":
                got.append((*m.span(), kind, m[0].casefold()))
            elif kind == "name":
                gender = TITLES[m[1]]
                parts = [2, 3] if m[3] else [2]
                for g in parts:
                    role = "family" if g == parts[-1] else f"given-{gender}"
                    said = _POSSESSIVE.sub("", m[g])
                    got.append((m.start(g), m.start(g) + len(said), f"{role}-{script_of(said)}", said.casefold()))
            else:
                got.append((*m.span(), kind, m[0] if kind == "ip" else _solid(m[0])))
    got += _again(text, got)
    rank = {k: i for i, (k, _) in enumerate(KINDS)}
    taken: list[tuple[int, int, str, str]] = []
    if len(got) > 1:
        used = bytearray(len(text))
        for g in sorted(got, key=lambda g: rank.get(g[2], len(rank))):  # stable: names after a title come before the same words again
            if not any(used[g[0] : g[1]]):
                used[g[0] : g[1]] = b"\1" * (g[1] - g[0])
                taken.append(g)
        return sorted(taken)
    return got


# --- surrogates -----------------------------------------------------------------------------


def _numbers(key: bytes, *of) -> Iterator[int]:
    """An endless keyed stream of bytes' worth of numbers for an entity."""
    n = 0
    while True:
        block = hmac.new(key, "\x1f".join(map(str, (*of, n))).encode(), hashlib.sha256).digest()
        yield from block
        n += 1


def _letter(script: str, r: Iterator[int]) -> str:
    first, last = map(ord, LETTERS[script])
    while True:
        c = chr(first + (next(r) * 256 + next(r)) % (last - first + 1))
        if c.isalpha():
            return c


def _shape(text: str, r: Iterator[int]) -> str:
    """Digits for digits, letters for letters, each of its script, the rest as it is."""
    out = []
    for c in text:
        if c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + next(r) % 10))
        elif c.isalpha():
            new = _letter(script_of(c), r)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The attempt-th surrogate of an entity, in canonical form."""
    r = _numbers(key, kind, entity, attempt)
    more = attempt // 2  # letters or syllables beyond the entity's own, once draws have collided
    if kind == "mail":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        head = labels[:-2] if len(labels) > 2 else labels[:1]
        longer = "".join(_letter("latin", r) for _ in range(more))
        return f"{_shape(local, r)}{longer}@{'.'.join(_shape(x, r) for x in head)}.example.{('com', 'net', 'org')[next(r) % 3]}"
    if kind == "ip":  # the reserved range; all of the space once that has been tried often
        return ".".join(str(x) for x in (240 + next(r) % 16 if attempt < 16 else next(r), next(r), next(r), next(r)))
    if kind == "secret":
        for digits in ("0123456789abcdef", "0123456789ABCDEF"):
            if set(entity) <= set(digits):
                return "".join(digits[next(r) % 16] for _ in entity)
        return _shape(entity, r)
    if kind == "card":
        out, zero = _shape(entity, r), ord(entity[-1]) - unicodedata.decimal(entity[-1])
        return next(x for x in (out[:-1] + chr(zero + d) for d in range(10)) if luhn(x))
    if kind == "ssn":  # no number in use begins with 9; all digits once these have been tried often
        return ("9" if attempt < 16 else "") + _shape(entity[attempt < 16 :], r)
    if kind == "phone":  # a country's code stays, and the 0 before an area's
        keep = max(0, len(entity) - 10, entity.startswith("0"))
        return entity[:keep] + _shape(entity[keep:], r)
    if kind == "iban":
        out = entity[:2] + "00" + _shape(entity[4:], r)
        return f"{out[:2]}{98 - _iban_number(out) % 97:02d}{out[4:]}"
    role, script = kind.split("-")[0], kind.rsplit("-", 1)[1]
    end = ENDINGS.get(script, {}).get("family" if role == "family" else kind.split("-")[1], "")
    if script in SYLLABLES:
        syllables = SYLLABLES[script]
        return "".join(syllables[(next(r) * 256 + next(r)) % len(syllables)] for _ in range(3 + more // 2)) + end
    return "".join(_letter(script, r) for _ in range(max(1, len(entity) - len(end)) + more)) + end


def _cased(new: str, old: str) -> str:
    """new in upper case where old, letter by letter, is."""
    if old.isupper():
        return new.upper()
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, old, strict=False)) + new[len(old) :]


def rendered(new: str, old: str) -> str:
    """A canonical surrogate in the layout and case of an occurrence."""
    if "@" in new and "@" in old:
        return "@".join(_cased(n, o) for n, o in zip(new.rsplit("@", 1), old.rsplit("@", 1), strict=True))
    if len(new) == len(_solid(old)) != len(old) and new.isalnum():
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in old)
    if any(c.isdecimal() for c in old) or len(new) == len(old) and new != new.lower():
        return new  # numbers, and secrets, which have their entity's case
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new.capitalize() if old[:1].isupper() else new


# --- the corpus -----------------------------------------------------------------------------

_SPANS = "_doc long, _tag long, start int, end int, kind string, entity string"


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences (_doc, _tag, start, end, kind, entity) of `keyed` docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(2)):
                here = find(t.as_py() or "")
                rows += [i] * len(here)
                found += here
            start, end, kind, entity = zip(*found, strict=True) if found else ([], [], [], [])
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string()), pa.array(entity, pa.string())], names=["_doc", "_tag", "start", "end", "kind", "entity"])

    return docs.select("_doc", "_tag", text).mapInArrow(run, _SPANS)


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of distinct (kind, entity): distinct surrogates, none of them an entity."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k.as_py(), e.as_py(), a.as_py()) for k, e, a in zip(*b.columns[:3], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    # over all kinds, and without regard to case
    real = entities.select(F.lower("entity").alias("low"), F.lit(True).alias("is_real")).distinct()
    done: DataFrame | None = None
    left = entities.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        drawn = left.select("kind", "entity", "attempt").mapInArrow(draw, "kind string, entity string, attempt int, surrogate string").withColumn("low", F.lower("surrogate"))
        first = drawn.groupBy("low").agg(F.min(F.struct("kind", "entity")).alias("winner"))
        judged = drawn.hint("merge").join(first, "low").join(real.hint("merge"), "low", "left")
        taken = F.lit(True)
        if done is not None:
            judged = judged.join(done.select(F.lower("surrogate").alias("low"), F.lit(True).alias("is_taken")).hint("merge"), "low", "left")
            taken = F.col("is_taken").isNull()
        judged = written(judged.select("kind", "entity", "attempt", "surrogate", ((F.col("winner") == F.struct("kind", "entity")) & F.col("is_real").isNull() & taken).alias("ok")), "surrogates")
        fine = judged.where("ok").select("kind", "entity", "surrogate")
        done = fine if done is None else done.unionByName(fine)
        left = judged.where("not ok").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return done
    raise ValueError(f"there are not enough surrogates for {left.select('kind').distinct().collect()}")


def pseudonymised(docs: DataFrame, key: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text rewritten and n_entities, the number of occurrences rewritten."""
    keep = [c for c in docs.columns if c != "n_entities"]
    known = keyed(docs.select(*(F.col(f"`{c}`") for c in keep)), id_column, text)
    spans = written(detected(known, text).distinct(), "spans")
    mapping = assigned(written(spans.select("kind", "entity").distinct(), "entities"), key)
    # spans of one entity may be a third of all: a join by sort and merge, whose skewed side Spark splits
    named = spans.hint("merge").join(mapping, ["kind", "entity"]).select("_doc", "_tag", "start", "end", "surrogate")
    named = written(named, "named")
    listed = named.groupBy("_doc", "_tag").agg(F.sort_array(F.collect_list(F.struct("start", "end", "surrogate"))).alias("_new"))
    # by sort and merge at every size, so what is moved grows with the input
    joined = known.join(listed.hint("merge"), ["_doc", "_tag"], "left").select(*(F.col(f"`{c}`") for c in keep), "_new")
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("n_entities", T.IntegerType())
    where = keep.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, count = b.column(where), []
            new = b.column(len(keep))
            out: list[str | None] = []
            for t, n in zip(texts, new, strict=True):
                if not n.is_valid:
                    out.append(t.as_py())
                    count.append(0)
                    continue
                old, at, parts = t.as_py(), 0, []
                spans_ = n.as_py()
                for s in spans_:
                    parts += [old[at : s["start"]], rendered(s["surrogate"], old[s["start"] : s["end"]])]
                    at = s["end"]
                out.append("".join([*parts, old[at:]]))
                count.append(len(spans_))
            columns = list(b.columns[: len(keep)])
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int32())], names=[*keep, "n_entities"])

    return joined.mapInArrow(rewrite, schema)
