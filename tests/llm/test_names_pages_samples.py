"""Names without their title, pages with tags left out, and the language sample's threshold."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("alleloom.llm")

from alleloom.llm import langid, media, pii  # noqa: E402


def test_a_person_stays_one_without_the_title(spark):
    text = "Mrs. Anna Berg spoke. Later Berg said no. Anna Berg left; Berg's coat, BERG and a berg stayed."
    row = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first()
    assert row["n_entities"] == 7 and not re.search(r"Anna|Berg|BERG", row["text"])
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) spoke\. Later (\w+) said no\. (\w+) (\w+) left; (\w+)'s coat, (\w+) and a berg stayed\.", row["text"])
    given, family, f2, g2, f3, f4, f5 = m.groups()
    assert given == g2 and given.endswith("a") and {family, f2, f3, f4} == {family} and f5 == family.upper() and given != family


def test_names_of_two_roles_and_other_kinds():
    kinds = [(k, e) for _, _, k, e in pii.find("Mr. Martin Berg and Frau Martin: Martin Berg, then Martin. martin@x.org, Martin@X.org, Berg-Meier")]
    assert kinds == [("given-m-latin", "martin"), ("family-latin", "berg"), ("family-latin", "martin"), ("given-m-latin", "martin"), ("family-latin", "berg"), ("family-latin", "martin"), ("mail", "martin@x.org"), ("mail", "martin@x.org")]
    assert pii.find("Berg and Anna without a title") == [] and pii.find("") == []


def test_national_numbers():
    for text, entity in (("call 030 1234567 now", "0301234567"), ("555 123 4567", "5551234567"), ("555.123.4567", "5551234567"), ("0171/1234567", "01711234567")):
        ((a, b, kind, got),) = pii.find(text)
        new = pii.surrogate(b"k", kind, got, 0)
        assert (kind, got) == ("phone", entity) and len(new) == len(got) and new != got and (not got.startswith("0") or new[0] == "0")
        assert re.sub(r"\d", "9", pii.rendered(new, text[a:b])) == re.sub(r"\d", "9", text[a:b])
    assert pii.find("555 123-4567, 12 345 6789, 5551 123 4567, 555 123 45678, v1.555.123.4567") == []


def _kinds(page):
    return [(s["kind"], s["text"] or s["media"], s["caption"]) for s in media.parsed(page)]


def test_heads_whose_end_is_left_out():
    body = [("text", "hello", None), ("image", "a.png", None)]
    assert _kinds("<html><head><title>x</title><body><p>hello</p><img src='a.png'></body></html>") == body
    assert _kinds("<head><meta charset=utf-8><title>x</title><style>p{}</style><p>hello<p><img src='a.png'>") == body
    assert _kinds("<head><title>x</title>\n hello <img src='a.png'>") == body
    assert _kinds("<head><title>x</title><script>let a = '<p>no</p>'</script></head> hello <img src='a.png'>") == body
    assert _kinds("<head><title>x</title></head>") == [] == _kinds("<head>") == _kinds("<head><link rel=x></head><body></body>")


def test_noscript_and_figures():
    assert _kinds("<p>a</p><img data-src='b.png'><noscript><img src='b.png' alt='b'></noscript>") == [("text", "a", None), ("image", "b.png", "b")]
    nested = "<figure><figure><img src=1><figcaption>one</figcaption></figure><figure><img src=2></figure><figcaption>both</figcaption></figure><img src=3>"
    assert _kinds(nested) == [("image", "1", "one"), ("image", "2", "both"), ("image", "3", None)]
    assert _kinds("<figure><figcaption>before <p>it</p></figcaption><img src=1></figure>x") == [("image", "1", "before it"), ("text", "x", None)]
    assert _kinds("<figure><pre>code</pre><figcaption>said") == [("text", "code", None), ("text", "said", None)]
    assert _kinds("<figcaption>alone</figcaption><p>x") == [("text", "alone", None), ("text", "x", None)]
    assert [s["position"] for s in media.parsed(nested)] == [0, 1, 2]


def test_text_and_payloads_give_the_document_back(spark):
    docs = {1: ["first part", "{one} payload", "second & part", "{two}", "last"], 2: ["{one} payload", "{one} payload", "x"], 3: ["only text"]}
    payloads = sorted({p for d in docs.values() for p in d if p.startswith("{")})
    store = media.described(media.stored(spark.createDataFrame([(p,) for p in payloads], "text string")).select("media", "text")).withColumnRenamed("text", "payload_text")
    digest = {p: hashlib.sha256(media.padded(p)).hexdigest() for p in payloads}
    esc = lambda t: t.replace("&", "&amp;")
    pages = [(d, "<head><title>t</title>" + "".join(f"<figure><img src='media:{digest[p]}'><figcaption>{i}</figcaption></figure>" if p in digest else f"<p>{esc(p)}" for i, p in enumerate(parts))) for d, parts in docs.items()]
    seqs = media.sequences(spark.createDataFrame(pages, "doc_id long, html string"))
    found = media.resolved(seqs, store, ["doc_id"]).collect()
    assert all(r["caption"] == str(r["position"]) and r["payload"]["payload_sha256"] == r["digest"] for r in found)
    texts = {(r["doc_id"], s["position"]): s["text"] for r in seqs.collect() for s in r["sequence"] if s["text"]}
    whole = texts | {(r["doc_id"], r["position"]): r["payload"]["payload_text"] for r in found}
    assert {d: [whole[d, i] for i in range(len(p))] for d, p in docs.items()} == docs and len(whole) == sum(map(len, docs.values()))


def test_smallest_holds_the_smallest(spark):
    rows = [(lang, i) for lang, n in (("a", 3000), ("b", 40), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, id long")
    df = df.unionByName(df.where("id = 7").crossJoin(spark.range(2000)).drop("id").withColumn("id", F.lit(7).cast("long"))[["lang", "id"]])
    df = df.withColumn("th", F.lit(1).cast("long")).withColumn("h", F.xxhash64("id"))
    kept = langid.smallest(df, 20, "lang", "h", "th").select("lang", "id", "h").distinct().collect()
    every = df.select("lang", "id", "h").distinct().collect()
    for lang in "abc":
        want = sorted((r["h"], r["id"]) for r in every if r["lang"] == lang)[:20]
        got = sorted((r["h"], r["id"]) for r in kept if r["lang"] == lang)
        assert got[: len(want)] == want and len(got) < 200
    assert langid.smallest(df.limit(0), 20, "lang", "h", "th").count() == 0
