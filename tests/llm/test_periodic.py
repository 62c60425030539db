"""Periodic runs against brute force: every period, every start, by comparing words."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alleloom.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w):
    """Every run: stretches of matches by rising period; one that is there already has a smaller period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in out.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(texts):
    number = np.array([ord(c) for w in texts for c in w], np.int64)
    out = [[] for _ in texts]
    for of, *r in zip(*(x.tolist() for x in periodic._runs(number, np.cumsum([0] + [len(w) for w in texts]))), strict=True):
        out[of].append(tuple(r))
    return out


_word = st.text(alphabet="ab", min_size=1, max_size=7)


@given(st.lists(st.lists(st.tuples(_word, st.integers(1, 9)), max_size=6).map(lambda x: "".join(w * k for w, k in x)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_repeated_pieces(texts):
    assert found(texts) == [brute(w) for w in texts]


def test_runs_of_random_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh"[: rng.choice((1, 2, 3, 8))]) for _ in range(rng.randrange(200))) for _ in range(60)]
    assert found(texts) == [brute(w) for w in texts]


def test_runs_within_runs():
    """Runs of repeated runs, and a period of which a divisor is a period of part of the stretch."""
    inner = "ab" * 4 + "c"
    texts = [inner * 5, ("aaaaaab" * 6 + "z") * 4, "a" * 500, "ab" * 250 + "a" * 30]
    assert found(texts) == [brute(w) for w in texts] and found(texts)[2] == [(0, 500, 1)]


def test_chunks_end_anywhere(monkeypatch):
    monkeypatch.setattr(periodic, "_CHUNK", 3)
    monkeypatch.setattr(periodic, "_CHUNKS", 8)
    texts = ["x" + "abcde" * k + "y" + "ab" * k for k in range(1, 40)]
    assert found(texts) == [brute(w) for w in texts]


def test_a_run_found_once_is_not_extended_again(monkeypatch):
    """One word 20,000 times has 5,000 periods; all but the first are skipped without a comparison."""
    calls = []
    reach = periodic._reach
    monkeypatch.setattr(periodic, "_reach", lambda v, x, p: calls.append(p) or reach(v, x, p))
    assert periodic._runs(np.zeros(20_000, np.int64), np.array([0, 20_000]))[2].tolist() == [20_000] and calls == [1]


def test_words_of_one_hash_are_told_apart():
    data = np.frombuffer(b"aabbaacc", np.uint8)
    start, end = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    same = periodic.numbered(data, start, end, np.zeros(4, np.uint64))
    assert same[0] == same[2] and len(set(same.tolist())) == 3
    assert periodic.numbered(data, start, end, np.array([5, 7, 5, 9], np.uint64)).tolist() == [0, 1, 0, 2]


def rows():
    rng = random.Random(7)
    out = [(i, " ".join(rng.choice(("x", "ya", "é")) + str(rng.randrange(4)) for _ in range(rng.randrange(150)))) for i in range(120)]
    out += [(200 + i, " \n".join(["na"] * 20 + ["b", "c"] * 9) + "\t" + t) for i, (_, t) in enumerate(out[:20])]
    return out + [(900, None), (901, ""), (902, " \n"), (903, "la " * 50_000), (904, "Ab ab " * 8), (None, "q r " * 9), (905, "w " * 7), (905, "w " * 7)]


def test_query(spark, tmp_path):
    spark.createDataFrame([(*r, "de") for r in rows()], "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    from alleloom.llm.queries import queries

    want = []
    for doc, text in rows():
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 10_000 else [(0, n, 1)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept(w, runs)))))
    got = queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and any(r[1] > 1 for r in want)


def test_odd_tables(spark):
    """Other columns go along, those of the new names are replaced, and an empty table is one."""
    df = spark.createDataFrame([("a", None, 1.5), ("b", "v w " * 5 + "x", None), ("c", "", 0.0)], "runs string, text string, `odd name` double")
    got = {r["odd name"]: r for r in periodic.collapsed(df).collect()}
    assert set(got[None].asDict()) == {"text", "odd name", "runs", "kept_text"}
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 10, 2)] and got[None]["kept_text"] == "v w x"
    assert got[1.5]["runs"] == [] and got[1.5]["kept_text"] == "" == got[0.0]["kept_text"]
    assert periodic.collapsed(df.limit(0)).count() == 0
    assert set(periodic.collapsed(df, new=("r", "k")).columns) == {"runs", "text", "odd name", "r", "k"}


@pytest.mark.parametrize("limit", [1, 300])
def test_slices_end_anywhere(spark, monkeypatch, limit):
    texts = [t for _, t in rows()[:40]]
    import pyarrow as pa

    from alleloom.llm import common

    parts = list(common.text_slices(pa.array(texts), limit))
    assert sum(len(o) - 1 for _, _, o in parts) == len(texts)
    for first, data, offsets in parts:
        row, start, end, h = common.words(data, offsets)
        begin = np.searchsorted(row, np.arange(len(offsets)), "left")
        number = periodic.numbered(data, start, end, h)
        of, *r = periodic._runs(number, begin)
        for i in range(len(offsets) - 1):
            assert [tuple(x) for k, *x in zip(of.tolist(), *(y.tolist() for y in r), strict=True) if k == i] == brute(WORD.findall(texts[first + i]))
