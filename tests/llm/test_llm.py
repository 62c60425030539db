"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alleloom.llm import bpe, embeddings, jaccard, langid, media, packing, pii, quality, substrings, url_filter
from alleloom.llm.common import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=1, n=60, vocabulary=400):
    """Documents with copies, near copies, shared passages, nulls, empties, a very long one, and a repeated row."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgé") + str(rng.randrange(vocabulary))
    passage = " ".join(word() for _ in range(60))
    docs = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randrange(1, 120)))
        if i % 7 == 3:
            t = docs[rng.randrange(len(docs))][1] or ""
            w = t.split()
            if w and i % 2:
                w[rng.randrange(len(w))] = "X"
            t = "\n".join(w)
        if i % 9 == 5:
            t += "\t" + passage + " " + word()
        docs.append((i * 3, t))
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "x " * 30_000), (1004, "x y z"), (1005, "X Y Z"), (None, passage), (1006, " ".join(word() for _ in range(200)) + " " + passage)]
    docs.append(docs[10])
    rng.shuffle(docs)
    return docs


def frame(spark, docs, extra=""):
    return spark.createDataFrame([(*d, "keep") for d in docs], "doc_id long, text string, n_words string").select("doc_id", "text", "n_words")


# --- shared ---------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = list(range(1100))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in used}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_tables(spark):
    from alleloom.llm import common

    before = spark.conf.get(common._CLEANUP, None)
    kept = common.written(spark.range(100).repartition(3))
    assert kept.count() == 100 and spark.conf.get(common._CLEANUP, None) == before
    assert all(spark.sparkContext.applicationId in f for f in kept.inputFiles())
    with common.passing(spark.range(10).where("id < 0")) as none, common.passing(spark.range(10)) as some:
        assert none.count() == 0 and some.count() == 10
    with pytest.raises(Exception):
        some.collect()
    common.clear(spark)
    with pytest.raises(Exception):
        kept.collect()


# --- op 1 -----------------------------------------------------------------------------------


def test_packing(spark):
    docs = corpus()
    rows = packing.packed(frame(spark, docs), capacities=(16, 64, 256), shard_pieces=10_000).collect()
    words = {d: [] for d, _ in docs}
    for d, t in docs:
        words[d].append(len(WORD.findall(t or "")))
    for d, sizes in words.items():
        mine = {}
        for r in rows:
            if r["doc_id"] == d:
                mine.setdefault(r["row"], []).append(r)
        assert sorted(sum(r["length"] for r in m) for m in mine.values()) == sorted(sizes) and all(r["length"] <= 256 for m in mine.values() for r in m)
        assert all(sorted(r["piece"] for r in m) == list(range(len(m))) and all(r["start"] == 256 * r["piece"] for r in m) for m in mine.values())
    bins = {}
    for r in rows:
        assert (r["bin_id"] is None) == (r["length"] == 0)
        if r["bin_id"]:
            bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        fill = sum(r["length"] for r in b)
        assert {r["capacity"] for r in b} == {min(c for c in (16, 64, 256) if c >= fill)}  # downsized
        spans = sorted((r["position"], r["position"] + r["length"]) for r in b)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(spans))
    assert packing.packed(frame(spark, []), shard_pieces=10).count() == 0


def test_packing_of_repeated_rows(spark):
    """Rows of one id, and of none, are separate documents, also where they fill bins of their own."""
    docs = [(7, "w " * 64)] * 2 + [(None, "w " * 64)] * 3 + [(None, "w " * 10)] * 50 + [(8, "w " * 130)] * 2
    rows = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), capacities=(16, 64), shard_pieces=10).collect()
    fills = {}
    for r in rows:
        fills.setdefault((r["bin_id"], r["capacity"]), []).append((r["position"], r["position"] + r["length"]))
    assert sum(z - a for x in fills.values() for a, z in x) == 64 * 5 + 500 + 260
    for (_, c), x in fills.items():
        x.sort()
        assert x[0][0] == 0 and all(p[1] == q[0] for p, q in itertools.pairwise(x)) and x[-1][1] <= c


def test_packing_with_several_capacities():
    """pack() against the rule as it stands: tightest bin, else the capacity of least price for what it may come to hold."""

    def plain(lengths, caps, overhead):
        room, capacity = [], []
        left = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        while left:
            i = left.pop(0)
            n = lengths[i]
            fit = [r for r in room if r >= n]
            if fit:
                b = room.index(min(fit))
            else:
                price = {c: (c + overhead) / min(c, n + sum(lengths[k] for k in left if lengths[k] <= c - n)) for c in caps if c >= n}
                c = min(price, key=lambda c: (price[c], c))
                room.append(c)
                capacity.append(c)
                b = len(room) - 1
            room[b] -= n
        return sorted(min(c for c in caps if c >= k - r) for k, r in zip(capacity, room, strict=True))

    rng = np.random.default_rng(5)
    for _ in range(60):
        caps = sorted(rng.choice([8, 12, 16, 30, 64], rng.integers(2, 5), replace=False).tolist())
        lengths = rng.integers(1, caps[-1] + 1, rng.integers(1, 80))
        overhead = int(rng.integers(0, 20))
        where, offset, size = packing.pack(lengths, caps, overhead)
        assert sorted(size.tolist()) == plain(lengths.tolist(), caps, overhead)
        for b in range(len(size)):
            inside = sorted((int(offset[i]), int(offset[i] + lengths[i])) for i in np.flatnonzero(where == b))
            assert inside[0][0] == 0 and all(p[1] == q[0] for p, q in itertools.pairwise(inside)) and inside[-1][1] <= size[b]


def test_packing_is_best_fit():
    def plain(lengths, cap):
        room, where = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [(r, b) for b, r in enumerate(room) if r >= lengths[i]]
            if fit:
                r = min(x for x, _ in fit)
                b = next(b for x, b in fit if x == r)
            else:
                b = len(room)
                room.append(cap)
            room[b] -= lengths[i]
            where[i] = b
        return sorted(cap - r for r in room)

    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        where, _, _ = packing.pack(lengths, (64,), 0)
        assert sorted(np.bincount(where, lengths).astype(int)) == plain(lengths.tolist(), 64)


# --- op 2 -----------------------------------------------------------------------------------

PRIVATE = [
    (1, "Mail anna.b@mail3.example.com or ANNA.B@MAIL3.EXAMPLE.COM, call +1 (415) 555-0101, card 4111 1111 1111 1111 = 4111111111111111."),
    (2, "Mrs. Anna Berg met Mr Berg and Dr. Иван Петров; host 10.1.2.3, token = \"9f14a7029c8514dfe98aba92898d323168e199da\""),
    (3, None), (4, ""), (5, "Nothing here, version 2.0 of 1999."), (6, "SSN 123-45-6789, IBAN DE89370400440532013000, again anna.b@mail3.example.com"), (None, "ip 10.1.2.3"),
    (6, "SSN 123-45-6789, IBAN DE89370400440532013000, again anna.b@mail3.example.com"), (7, "a" * 50_000 + " 10.1.2.4 " + "b" * 50_000),
]


def test_surrogates(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in PRIVATE], "doc_id long, text string, n_entities int")
    rows = pii.pseudonymised(df, b"k").collect()
    by = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(PRIVATE) and by[3] is None and by[4] == "" and by[5] == PRIVATE[4][1]
    for secret in ("anna.b@", "ANNA.B@", "4111", "10.1.2.3", "10.1.2.4", "123-45-6789", "0532013000", "9f14a7029c", "Berg", "Петров", "555-0101"):
        assert not any(secret in (t or "") for t in by.values()), secret
    mail, upper = re.findall(r"\S+@\S+[a-zA-Z]", by[1])
    assert upper == mail.upper() and mail in by[6]  # coreference across case and documents
    spaced, solid = re.search(r"card ([\d ]{19}) = (\d{16})", by[1]).groups()
    assert spaced.replace(" ", "") == solid and pii.luhn(solid)
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Dr\. (\w+) (\w+)", by[2]).groups()
    assert names[1] == names[2] and names[0].endswith("a") and pii.script_of(names[3]) == pii.script_of(names[4]) == "cyrillic"
    iban = re.search(r"DE\d{20}", by[6])[0]
    assert pii._iban_number(iban) % 97 == 1
    assert by[None] != "ip 10.1.2.3" and by[None].split()[1] in by[2]
    assert pii.pseudonymised(df.limit(0), b"k").count() == 0


def test_surrogates_have_their_format():
    k = b"k"
    for kind, entity in (("secret", "AbCdEfGhIjKlMnOp"), ("secret", "0a1b2c3d4e5f0a1b"), ("secret", "0A1B2C3D4E5F0A1B"), ("secret", "ключ-Ключ-12345")):
        new = pii.surrogate(k, kind, entity, 0)
        shape = lambda x: ["U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else c for c in x]
        assert new != entity and (set(entity) <= set("0123456789abcdefABCDEF-") or shape(new) == shape(entity)) and pii.rendered(new, entity) == new
    assert pii.find("token=AbCdEfGhIjKlMnOp")[0][3] != pii.find("token=aBcDeFgHiJkLmNoP")[0][3]
    for name, script in (("王小明", "han"), ("محمد", "arabic"), ("Петров", "cyrillic"), ("דוד", "hebrew"), ("김철수", "hangul"), ("Παππάς", "greek"), ("राम", "devanagari"), ("Ångström", "latin")):
        (_, _, kind, entity), *_ = pii.find(f"Dr. {name} left")
        new = pii.surrogate(k, kind, entity, 0)
        assert kind == f"family-{script}" and {pii.script_of(c) for c in new if c.isalpha()} == {script} and new != entity
    phone = pii._shape("٠١٢٣", pii._numbers(k, "x"))
    assert len(phone) == 4 and all(0x660 <= ord(c) <= 0x669 for c in phone)
    # sixteen digits are a card by their check digit only; accounts and social security numbers are checked as well
    assert not pii.find("order 1234567812345678, 000-12-3456, DE00370400440532013000") and pii.find("4111111111111111")[0][2] == "card"
    assert pii.rendered("xy.z@abc.example.org", "Jo.D@MAIL.COM") == "Xy.Z@ABC.EXAMPLE.ORG" and pii.rendered("xyz@abc.example.org", "JO@mail.com") == "XYZ@abc.example.org"


def test_texts_against_brute_force(spark):
    """One surrogate an entity in all texts, distinct ones for distinct entities, and nothing else touched."""
    rng = random.Random(8)
    people = ["Mr. Anna", "Frau Berg", "Dr. Иван Петров", "Mrs Berg", "Prof. 王小明"]
    things = [f"{a}@{b}.co" for a in "abcd" for b in "xyz"] + ["4111 1111 1111 1111", "10.0.0.1", "+1 (415) 555-0101", "token=Abcdefghijkl", "token=abcdefghijkL", *people]
    docs = [(i % 90, " ".join(rng.choice(things) if rng.random() < 0.4 else "word\n" for _ in range(rng.randrange(0, 30)))) for i in range(100)]
    docs += [(None, None), (None, "Mr. Anna"), (None, "")]
    entities = {(k, e) for _, t in docs for _, _, k, e in pii.find(t or "")}
    real, done, attempt, left = {e.lower() for _, e in entities}, {}, 0, sorted(entities)
    while left:
        drawn = {x: pii.surrogate(b"k", *x, attempt) for x in left}
        for x in left:
            low = drawn[x].lower()
            if low not in real and low not in {v.lower() for v in done.values()} and all(drawn[y].lower() != low for y in left if y < x):
                done[x] = drawn[x]
        left, attempt = [x for x in left if x not in done], attempt + 1
    assert len({v.lower() for v in done.values()}) == len(entities) and not {v.lower() for v in done.values()} & real

    def rewritten(t):
        out, at = "", 0
        for a, b, kind, entity in pii.find(t):
            out, at = out + t[at:a] + pii.rendered(done[kind, entity], t[a:b]), b
        return out + t[at:]

    rows = pii.pseudonymised(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), b"k").collect()
    want = [(d, t and rewritten(t), len(pii.find(t or ""))) for d, t in docs]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_many_short_mails_stay_distinct(spark):
    """More entities than surrogates of their own length."""
    mails = [f"{a}@{b}{c}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmn" for c in "abcdefghijklmn"]
    small = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    entities = [("mail", m) for m in [*mails, *small]][:5000] + [("mail", m) for m in small] + [("family-latin", "berg"), ("given-m-latin", "berg")]
    got = pii.assigned(spark.createDataFrame(sorted(set(entities)), "kind string, entity string"), b"k").collect()
    assert len(got) == len(set(entities)) == len({r["surrogate"] for r in got}) and not {r["surrogate"] for r in got} & {e for _, e in entities}


def test_collisions_are_resolved(spark, monkeypatch):
    entities = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(40)], "kind string, entity string")
    narrow = pii.surrogate
    # a generator whose first draws collide with each other and with real entities
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, e, a: f"{int(e) % 3:09d}" if a == 0 else narrow(key, kind, e, a))
    got = pii.assigned(entities, b"k").collect()
    assert len(got) == 40 and len({r["surrogate"] for r in got}) == 40
    assert not {r["surrogate"] for r in got} & {r["entity"] for r in got}


# --- op 3 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [13, 4, 50])
def test_substrings(spark, window):
    docs = corpus(2)
    order = lambda d: substrings.LAST if d is None else d
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, substrings.LAST), order(d))
    want = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < order(d):
                gone[p : p + window] = [True] * window
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    for sizes in ({}, {"shard_bytes": 5000, "bucket": 500}, {"shard_bytes": 1000, "bucket": 100, "direct": 3}):
        got = [tuple(r) for r in substrings.digests(frame(spark, docs), window, **sizes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    for r in substrings.deduplicated(frame(spark, docs), window).collect():
        assert r["kept_text"].split() == r["kept_words"].split()
    assert substrings.digests(frame(spark, []), window).count() == 0


def test_windows_grow_only_where_repeated(spark):
    """Unlike windows round a passage that all documents share lose nothing, over many shards and buckets; a level asks only
    about windows whose halves are repeated."""
    same = "a b c d e f g"
    docs = [(i, f"x{i} y{i} z{i} {same} u{i} v{i} w{i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    sizes = {"shard_bytes": 4000, "bucket": 300}
    assert substrings.digests(df, 13, **sizes).agg({"n_removed": "sum"}).first()[0] == 0
    assert substrings.levels(13) == [7, 13] and substrings.levels(50) == [7, 13, 25, 50] and substrings.levels(4) == [4]
    texts = substrings.Shards(df, 13, "doc_id", "text", **sizes)
    marks = substrings._level(texts, None, 7, None, False)
    assert sum(len(substrings._risen(pa.scalar(bytes(r["block"])), "<u4")) for r in marks.collect()) == 3000
    assert substrings._level(texts, marks, 13, 7, True).isEmpty()
    rows = substrings.passages(df, 7, least=4, **sizes).collect()
    assert sorted((r["_doc"], r["start"], r["n"], r["length"]) for r in rows) == [(i, 3, 1, 7) for i in range(1, 3000)]


def test_cells(spark):
    """By way of cells a passage that all documents have is few questions at its bucket, and rows follow the windows, not
    shards times buckets; marks are those of the straight way."""
    same = " ".join("abcdefghijklmnop")
    df = spark.createDataFrame([(i, f"x{i} y{i} {same} u{i} v{i}") for i in range(600)], "doc_id long, text string").repartition(4)
    sizes = {"shard_bytes": 600, "bucket": 40}
    ways = [substrings.Shards(df, 13, "doc_id", "text", **sizes, direct=d) for d in (1, 1 << 20)]
    assert [t.route.cells for t in ways] == [True, False] and ways[0].buckets > 100 and ways[0].shards > 40
    marks = []
    for t in ways:
        seven = substrings._level(t, None, 7, None, False)
        thirteen = substrings._level(t, seven, 13, 7, True, True)
        marks.append([{(r["shard"], r["later"], x) for r in m.collect() for x in substrings._risen(pa.scalar(bytes(r["block"])), "<u4").tolist()} for m in (seven, thirteen)])
    assert marks[0] == marks[1] and all(marks[0])
    t = ways[0]
    asked = t.rows(None).mapInArrow(substrings._questions(13, None, t.route, True, False), substrings._ASKED)
    windows = 600 * (20 - 12)
    assert asked.where("to >= 0").count() <= windows
    relayed = asked.repartition("to").sortWithinPartitions("to", "shard").mapInArrow(substrings._relayed(t.route, True, False), substrings._ASKED)
    asks = lambda d: sum(len(r["block"]) // 4 for r in d.where("to >= 0").collect())
    # four windows of the passage: one question of each shard, then one of each group of shards
    own = 600 * 4
    assert asks(asked) <= own + 4 * t.shards and asks(relayed) <= own + 4 * (-(-t.shards // t.route.wide))
    rows = substrings.passages(df, 7, least=4, **sizes, direct=1)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, substrings.passages(df, 7, least=4, **sizes).collect()))


def test_unlike_rows_without_id(spark):
    docs = [(None, f"n{i} " + " ".join(f"w{k}" for k in range(20))) for i in range(40)] + [(5, " ".join(f"w{k}" for k in range(20)))] * 3
    got = substrings.digests(spark.createDataFrame(docs, "doc_id long, text string"), 13, shard_bytes=500, bucket=50).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 20)] * 40 + [(5, 0)] * 3


def test_passages(spark):
    docs = [(i, t) for i, t in corpus(4) if i is not None]
    rows = substrings.passages(frame(spark, docs), 8).collect()
    texts = {}
    for i, t in docs:
        texts.setdefault(i, WORD.findall(t or ""))
    first = {}
    for n in (8, 16, 32, 64):
        for i, w in texts.items():
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                first[k] = min(first.get(k, i), i)
    for n in (8, 16, 32, 64):
        want = {(i, p) for i, w in texts.items() for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < i}
        got = {(r["_doc"], r["start"] + k) for r in rows if r["length"] == n for k in range(r["n"])}
        assert got == want, n


# --- op 4 -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("shingle", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard(spark, shingle, percent):
    docs = corpus(5, 90, 60)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = WORD.findall((t or "").translate(lower))
        return frozenset(tuple(w[p : p + min(shingle, len(w))]) for p in range(max(1, len(w) - shingle + 1))) if w else frozenset()

    sets = [(d, grams(t)) for d, t in docs]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = [(d, len(s), find(d) if d is not None else None) for d, s in sets]
    got = [tuple(r) for r in jaccard.joined(frame(spark, docs), shingle, percent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if shingle == 4:
        assert jaccard.joined(frame(spark, [])).count() == 0
        left = {r["doc_id"] for r in jaccard.kept(frame(spark, docs), shingle, percent).collect()}
        assert left == {c for _, _, c in want}


def test_trees_find_a_spanning_forest():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = [rng.integers(0, 1 << 63, rng.integers(5, 60), dtype=np.uint64) for _ in range(6)]
        sets = [np.unique(np.append(b[rng.random(len(b)) > 0.06], rng.integers(0, 1 << 63, 1, dtype=np.uint64))) for b in base for _ in range(12)]
        true = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)]

        def parts(edges, n=len(sets)):
            root = list(range(n))
            for a, b in edges:
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)

            def top(x):
                while root[x] != x:
                    x = root[x]
                return x

            return [top(i) for i in range(n)]

        got = jaccard.tree_links(sets, None, 85)
        assert parts(got) == parts(true) and len(got) == len(sets) - len(set(parts(true)))
        half = len(sets) // 2
        across = jaccard.tree_links(sets[:half], sets[half:], 85)
        assert parts((a, half + b) for a, b in across) == parts((a, b) for a, b in true if a < half <= b)


def test_folded_bitmaps_are_those_of_less_width():
    x = np.random.default_rng(4).integers(0, 1 << 63, 500, dtype=np.uint64)
    for width in (256, 512, 1024):
        assert (jaccard.folded(jaccard.bitmap(x, 4096), width // 64) == jaccard.bitmap(x, width)).all()


def test_block_pairs(spark):
    """A chain of near copies longer than a block, of which the hub links only the first ones."""
    w = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(w[i * 4 : i * 4 + 120])) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(frame(spark, docs), 4, 85).collect()}
    assert set(got.values()) == {0}


def test_the_smallest_id_may_have_several_texts(spark):
    """The smallest id of a group comes in rows of unlike texts: each row's links count."""
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (3, " ".join([*b[:-1], "y"])), (4, " ".join(["z", *b[1:]])), (5, "other words here now"), (None, " ".join(a)), (6, " ".join(a)), (7, " ".join(a))]
    for order in (docs, docs[::-1]):
        got = jaccard.joined(frame(spark, order).repartition(3), 4, 85).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, None: None, 6: 1, 7: 1} and len(got) == len(docs)


def test_stars_of_a_hot_key(spark):
    """A key that a third of all rows have: its rows are dealt to several tasks, none is lost."""
    n = 60_000
    filed = spark.range(n).selectExpr("case when id % 3 = 0 then -1L else xxhash64(id div 6) end key", "id doc").repartition(8)
    sizes = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        stars = jaccard._stars(filed)
        got = {tuple(r) for r in stars.collect()}
        plan = stars._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    first: dict = {}
    for i in range(n):
        first.setdefault(-1 if i % 3 == 0 else i // 6, i)
    assert got == {(i, first[k]) for i in range(n) if first[k := -1 if i % 3 == 0 else i // 6] < i}
    assert "SortMergeJoin(skew=true)" in plan


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 7, 9, 13, 20, 40, 90, 300):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
            y = np.unique(np.append(x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)))
            if len(y) and jaccard.linked(len(np.intersect1d(x, y)), len(x), len(y), 85):
                assert set(jaccard.keys_of(x, 85).tolist()) & set(jaccard.keys_of(y, 85).tolist())


# --- op 5 -----------------------------------------------------------------------------------


def test_url_lists(spark):
    entries = [
        ("domain", "bad.example", "block", "add", "2024-02-01", 0), ("domain", "bad.example", "block", "remove", "2024-03-01", 1),
        ("host", "ok.bad.example", "allow", "add", "2024-02-10", 2), ("prefix", "x.example/a/b", "block", "add", "2024-01-01", 3),
        ("host", "tie.example", "block", "add", "2024-01-01", 4), ("host", "tie.example", "block", "remove", "2024-01-01", 5), (None, "y", "block", "add", "2024-01-01", 6),
    ]
    e = spark.createDataFrame(entries, "kind string, pattern string, verdict string, action string, effective string, seq int").selectExpr("kind", "pattern", "verdict", "action", "to_timestamp(effective) effective", "seq")
    rows = [
        (1, "http://www.BAD.example:80/x", "2024-01-31", False), (2, "http://www.bad.example/x", "2024-02-01", True), (3, "http://u@bad.example", "2024-03-01", False),
        (4, "https://ok.bad.example/", "2024-02-09", True), (5, "https://ok.bad.example/", "2024-02-10", False), (6, "http://x.example/a/b/c?q", "2024-05-01", True),
        (7, "http://x.example/a/bb", "2024-05-01", False), (8, None, "2024-05-01", False), (9, "no url", None, False), (10, "http://tie.example/", "2024-05-01", False), (2, "http://www.bad.example/x", "2024-02-01", True), (None, "http://notbad.example/", "2024-02-02", False),
    ]
    c = spark.createDataFrame([(*r[:3], "x") for r in rows], "page_id long, url string, t string, rank string").selectExpr("page_id", "url", "to_timestamp(t) fetched_at", "rank")
    got = url_filter.evaluate(c, url_filter.validity(e)).collect()
    assert sorted(((r["page_id"], r["blocked"]) for r in got), key=str) == sorted(((r[0], r[3]) for r in rows), key=str)
    assert not any(r["blocked"] for r in url_filter.evaluate(c, url_filter.validity(e.limit(0))).collect())
    # spellings of one pattern, in both orders of a tie; and a very deep path
    for last, blocked in (("remove", False), ("add", True)):
        log = [("host", "A.com", "block", "add" if last == "remove" else "remove", "2024-01-01", 0), ("host", "a.com", "block", last, "2024-01-01", 1), ("prefix", "Deep.example/A/b/c", "block", "add", "2024-01-01", 2)]
        two = spark.createDataFrame(log, "kind string, pattern string, verdict string, action string, effective string, seq int").selectExpr("kind", "pattern", "verdict", "action", "to_timestamp(effective) effective", "seq")
        deep = spark.createDataFrame([(1, "http://a.COM/"), (2, "http://deep.example/a/B/c" + "/x" * 20_000), (3, "http://deep.example/a/b")], "page_id long, url string").selectExpr("page_id", "url", "to_timestamp('2024-02-01') fetched_at")
        assert {r["page_id"]: r["blocked"] for r in url_filter.evaluate(deep, url_filter.validity(two)).collect()} == {1: blocked, 2: True, 3: False}
    assert url_filter.evaluate(c.limit(0), url_filter.validity(e)).count() == 0


# --- op 6, op 7 -----------------------------------------------------------------------------


def _languages(n=240):
    rng = random.Random(5)
    syllables = {"aa": ["ba", "ka", "ta", "na"], "bb": ["scho", "icht", "ung", "ver"], "cc": ["ción", "ado", "que", "los"]}
    return [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(rng.randrange(3, 40))), k) for i, k in enumerate(rng.choice(list(syllables)) for _ in range(n))]


def test_language_id(spark):
    docs = [*_languages(), (9000, None, "aa"), (9001, "", "bb"), (9002, "123 !!", "aa"), (None, "scho icht ung ver", None), (9003, "ción " * 30_000, None)]
    rows = {r["doc_id"]: r for r in langid.identified(spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double")).collect()}
    assert len(rows) == len(docs)
    for i in (9000, 9001, 9002):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert rows[None]["lang_pred"] == "bb" and rows[9003]["lang_pred"] == "cc" and not rows[None]["held_out"]
    held = [d for d in docs if d[0] is not None and d[2] and zlib.crc32(str(d[0]).encode()) % 4 == 2 and d[0] < 9000]
    assert all(rows[d[0]]["held_out"] for d in held) and np.mean([rows[d[0]]["lang_pred"] == d[2] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    rare = [*docs, *((20_000 + i, "λόγος και φως " * 3, "el") for i in range(4)), *docs[:50], (30_000, "ba ka", "aa"), (30_000, "ba ka", "bb")]
    assert "el" in langid.train(spark.createDataFrame(rare, "doc_id long, text string, lang string"), sample=40).labels
    none = langid.identified(spark.createDataFrame([(1, "ab", None)], "doc_id long, text string, lang string")).first()
    assert none["lang_pred"] == "und"
    assert langid.identified(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_ftrl_is_sparse():
    at, x = np.array([1, 2]), np.array([1.0, 0.0])
    w = langid.ftrl([(at, x, 0), (at + 2, x, 1)] * 5, 2)
    assert np.count_nonzero(w.any(1)) == 2  # features without signal stay at zero


def test_quality(spark, monkeypatch):
    good = [(i, t, 1) for i, t, _ in _languages(160)]
    rng = random.Random(6)
    bad = [(1000 + i, " ".join(rng.choice(["$$$", "###", "buy!!", "FREE!!"]) for _ in range(rng.randrange(5, 60))), 0) for i in range(80)]
    extra = [(5000, None), (5001, ""), (None, "ba ka"), (5002, "FREE!! " * 20_000)]
    docs = spark.createDataFrame([(d[0], d[1], "x") for d in [*good, *bad, *extra]], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, y) for i, _, y in [*good, *bad]] + [(None, 1), (good[0][0], None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert len(rows) == len(good) + len(bad) + len(extra)
    held = [d for d in [*good, *bad] if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(rows[d[0]]["held_out"] for d in held) and np.mean([rows[d[0]]["predicted"] == d[2] for d in held]) > 0.95
    assert rows[5000]["score"] == rows[5001]["score"] and 0 < rows[5000]["score"] < 1 and rows[5002]["predicted"] == 0
    assert quality.judged(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    copies = spark.createDataFrame([(i, t) for i in range(7) for _, t, _ in good[: 20 + i]], "doc_id long, text string").repartition(3)
    model = quality.train(docs, labels)
    assert quality.score(copies, model).groupBy("text").agg({"score": "min", "*": "count"}).count() == quality.score(copies, model).select("text", "score").distinct().count()
    monkeypatch.setattr(quality, "VECTOR_RATE", 1e5)  # steps that are too large are halved until something is learned
    rows = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert np.mean([rows[d[0]]["predicted"] == d[2] for d in held]) > 0.95
    monkeypatch.undo()
    # a label that comes twice counts as the smaller one, whatever the order
    twice = quality.train(docs, labels.unionByName(labels.where("quality = 1").selectExpr("doc_id", "0 quality")))
    assert twice.prior == pytest.approx(0.001)
    assert quality.judged(docs.limit(0), labels).count() == 0


# --- op 8 -----------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    x = [c + rng.normal(size=16) * s for c, k in zip(centres, [1, 2, 3, 25, 60] * 6, strict=True) for s in [0.12] * k]
    x = [v.astype(np.float32).tolist() for v in x]
    rows = list(enumerate(x)) + [(9000 + i, x[50]) for i in range(30)]
    odd = [(9900, None), (9901, [0.0] * 16), (9902, [float("nan")] * 16), (9903, [None, *x[0][1:]]), (9904, [float("inf"), *x[0][1:]]), (9905, []), (9906, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, trees=4).collect()}
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    ids = [i for i, _ in rows]
    root = list(range(len(ids)))
    for a, b in zip(*np.nonzero(link), strict=True):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)

    def top(i):
        while root[i] != i:
            i = root[i]
        return ids[i]

    assert len(got) == len(rows) + len(odd)
    found, true = sum(got[i]["n_links"] for i in ids), int(link.sum()) - len(ids)
    assert all(got[i]["n_links"] <= link[k].sum() - 1 for k, i in enumerate(ids)) and found >= 0.98 * true
    assert np.mean([got[i]["component_id"] == top(k) for k, i in enumerate(ids)]) > 0.98
    for i, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert any(r["saturated"] for r in got.values())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids_and_doubles(spark):
    """Rows of one id have links of their own; doubles far outside the range of floats are compared as they are."""
    rows = [(5, [1.0, 0.0, 0.0, 0.1]), (5, [0.0, 1.0, 0.0, 0.1]), (1, [1.0, 0.05, 0.0, 0.1]), (9, [0.0, 1.0, 0.05, 0.1]), (12, [0.0, 0.0, 1e200, 1e199]), (11, [0.0, 0.0, 1e-200, 1e-201]), (13, [0.0, 0.0, 1.0, 0.1]), (13, [0.0, 0.0, 1.0, 0.1]), (20, [-1.0, 0.0, -0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.1])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (9, 1, 5, False), (11, 3, 11, True), (12, 3, 11, False), (13, 3, 11, False), (13, 3, 11, False), (20, 0, 20, True), (None, 0, None, True)], key=str)


def test_embeddings_of_bridged_groups(spark):
    """Two dense groups of which every node's nearest neighbours are of its own group, with links between them."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v)
    x = []
    for size in (15, 40, 300):
        a = unit(rng.normal(size=64))
        off = rng.normal(size=64)
        across = unit(off - (off @ a) * a)
        for centre in (a, 0.965 * a + np.sqrt(1 - 0.965**2) * across):
            for _ in range(size):
                own = rng.normal(size=64)
                x.append(np.sqrt(0.95) * centre + np.sqrt(0.05) * unit(own - (own @ a) * a - (own @ across) * across))
    x = np.array([*x, *rng.normal(size=(300, 64))], np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(link.sum(1).tolist()))
    assert {r["component_id"] for r in got if r["vec_id"] < 710} == {0, 30, 110}


def test_embeddings_go_on_until_links_are_found(spark, monkeypatch):
    """Rare pairs that the projections miss: an audit that sees them, and all pairs in the end."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[2980:] = x[:20] + 0.02 * rng.normal(size=(20, 16))
    x[2000], x[2001] = x[2980] + 0.02 * rng.normal(size=16), x[0]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.99
    np.fill_diagonal(link, False)
    monkeypatch.setattr(embeddings, "projected", lambda nodes_, *_, **__: spark.createDataFrame([], embeddings._GRAPH))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>"), 0.99).collect()}
    assert [got[i]["n_links"] for i in range(3000)] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in (0, 2000, 2001, *range(2980, 3000))] == [0, 0, 0, *range(20)]
    assert embeddings.enough(51_000, 6) == 6 and embeddings.enough(3_000_000, 6) > 12


# --- op 9 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [1, 4, 16, 64, 1 << 14])
def test_bpe_equals_the_library(leaf):
    import public_tokenizers as P
    import tiktoken

    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf)
    small = bpe.TreeBPE(c.ranks, P.PATTERN, leaf, 4)
    library = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(leaf)
    parts = ["a", "b", "the", " ", "  ", "\n", " \n", "é", "'s", "'", "12", "!!", "ß", "日本", "\t", "aaaa", "don't", " ", "🎉", "\x1c", "\x85", "　"]
    for _ in range(500):
        t = "".join(rng.choice(parts[:6] if rng.random() < 0.3 else parts) for _ in range(rng.randrange(300)))
        ids = c.encode(t)
        assert ids == small.encode(t) == library.encode_ordinary(t) and c.decode(ids) == t.encode()
    for t in ("a" * 3000, "ab" * 2000, "日本" * 500, "".join(rng.choice("abcdeé") for _ in range(5000)), " " * 2000 + "x"):
        assert c.encode(t) == small.encode(t) == library.encode_ordinary(t)


def test_bpe_of_the_documents_of_a_table():
    """Every whole text of the smallest table, as the library has it."""
    import public_tokenizers as P
    import pyarrow.parquet as pq
    import tiktoken

    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist():
        ids = c.encode(t or "")
        assert ids == library.encode_ordinary(t or "") and c.decode(ids) == (t or "").encode()


def test_bpe_rows(spark):
    import public_tokenizers as P

    docs = [(1, None), (2, ""), (3, "hello wörld " * 5000), (3, "hello wörld " * 5000), (None, "x"), (4, "a" * 60_000)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trips(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows) and len(rows) == len(docs)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert bpe.round_trips(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert [r["ids"] for r in bpe.encode_documents(df.where("doc_id < 3"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()] == [[], []]


# --- op 10 ----------------------------------------------------------------------------------


def test_media(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "é" * 100), (4, "x" * 64), (4, "x" * 64), (5, "x" * 64), (None, "y" * 65), (6, "long " * 40_000)]
    from alleloom.llm import queries

    spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, digest string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op10_media(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = next((t or "") for d, t in docs if d == r["doc_id"]).encode()
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode(p)).hexdigest() and media.decode(media.encode(p)) == p
        assert (r["position"], r["caption"]) == (1, f"document {r['doc_id'] or 'without id'}")
    store = media.saved(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert store.inputFiles() and {media.decode(r["media"]).rstrip(b"\0").decode() for r in store.collect()} == {t or "" for _, t in docs}
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op10_media(spark, str(tmp_path / "none")).count() == 0


def test_sequences(spark):
    page = "<html><head><title>no</title></head><body>One<p>two <b>bold</b></p><figure><img src='media:aa' alt='alt'><figcaption>Cap</figcaption></figure><script>x()</script>tail<img src='media:bb'></body>"
    df = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "", 0), (4, "<p>unclosed <img src=media:zz", 0)], "page_id long, html string, sequence int").withColumn("payload", F.lit("x"))
    rows = {r["page_id"]: r["sequence"] for r in media.sequences(df).collect()}
    assert [(s["position"], s["kind"], s["text"], s["media"], s["caption"]) for s in rows[1]] == [
        (0, "text", "One", None, None), (1, "text", "two bold", None, None), (2, "image", None, "media:aa", "Cap"), (3, "text", "tail", None, None), (4, "image", None, "media:bb", None),
    ]
    assert rows[2] == [] and rows[3] == []
    store = spark.createDataFrame([("aa", 7), ("aa", 7), ("cc", 1)], "payload_sha256 string, size int")
    got = media.resolved(media.sequences(df), store, ["page_id", "payload"]).orderBy("position").toDF("page_id", "own", "position", "kind", "caption", "digest", "payload").collect()
    assert {r["own"] for r in got} == {"x"}
    assert [(r["position"], r["caption"], r["payload"] and r["payload"]["size"]) for r in got if r["page_id"] == 1] == [(2, "Cap", 7), (4, None, None)]


# --- the pipeline ---------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = [(i, t, k) for i, t, k in _languages(80)]
    long_passage = " ".join(f"los{i}ado" for i in range(70))
    docs += [(500, "que los ado ción " * 20, "cc"), (501, "que los ado ción " * 20, "cc"), (502, "123 456", "aa"), (503, None, "aa"), (504, long_passage, "cc"), (505, "ado " + long_passage + " que " + " ".join(f"ción{i}" for i in range(90)), "cc"), (506, "los ado mail: a.b@c.example.org que", "cc")]
    spark.createDataFrame([(*d, "s", len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept, frames = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns and out.schema["n_chars"].dataType == kept.schema["n_chars"].dataType
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        frames[name] = {r["doc_id"]: r for r in kept.collect()}
    ids = {d[0] for d in docs}
    assert ids - set(frames["language_id"]) == {502, 503}
    assert set(frames["language_id"]) - set(frames["near_duplicates"]) == {501}
    assert "los3ado" not in frames["repeated_passages"][505]["text"] and frames["repeated_passages"][504]["text"] == long_passage
    assert frames["repeated_passages"][505]["n_chars"] == len(frames["repeated_passages"][505]["text"])
    assert "a.b@c" not in frames["personal_data"][506]["text"]
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(frames["personal_data"])


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, nulls in every column and columns that operators name too: what stays has its own values."""
    import corpus_pipeline as P

    docs = [(i, t, k) for i, t, k in _languages(60)]
    docs += [docs[3], docs[3], (None, "scho icht ung ver token=abcdefghijkl1", "bb"), (None, "ba ka ta na " * 60, None), (None, None, None), (70, None, "aa"), (71, "", None), (72, "ba ka ta na " * 20_000, "aa")]
    own = "score double, lang_pred string, held_out boolean, n_words long, n_removed long, kept_words string, kept_text string, n_entities int, component_id long, _doc string, _tag string, row string, shard string"
    names = [x.split()[0] for x in own.split(", ")]
    values = (0.125, "x", None, -7, -8, "kw", "kt", -9, -10, "d", "t", "r", "s")
    rows = [(*d, None if i % 5 == 0 else "s", None if i % 7 == 0 else len(d[1] or ""), *values) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {own}")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        found = kept.collect()
        assert found and {tuple(r[c] for c in names) for r in found} == {values}
    # of the two documents without id that have a known language, one is nothing but passages of another document
    assert sum(r["doc_id"] is None for r in found) == 1 and not any("abcdefghijkl1" in r["text"] for r in found)
    assert sum(r["doc_id"] == docs[3][0] for r in found) == 3
    packed = P.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(WORD.findall(r["text"])) for r in found)

    (tmp_path / "none").mkdir()
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
