"""Media columns: interleaved document sequences.

`sequences` parses HTML into an ordered array of structs: text segments and media references, each with its position and
a media reference with its caption. A reference names its payload by digest (`media:<sha256>`). `saved` writes the media
table: digest and stored form, a portable graymap of 8-bit samples, 64 to a row, so its height is the payload's length
over 64. `described` reads the stored bytes back from that table and describes them. `resolved` joins references to
described payloads by digest; the join carries only digests and descriptions, positions and captions stay in the sequence.

Defined results: null and empty HTML give an empty sequence; null text is an empty payload (64 zero bytes); a reference
without a payload keeps its place with null description; equal payloads have one digest and equal descriptions.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alleloom.llm.common import written

ROW = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"
_ARROW_SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))
_SKIP = {"script", "style", "template", "title"}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "br", "hr", "nav", "header", "footer", "main", "aside", "figure", "body"}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}


class _Reader(HTMLParser):
    """Text between block borders becomes one segment; a media element becomes one reference where it stands.

    A head ends with its end tag or, where that is left out, with the first block, media element or text outside a title.
    What stands in `noscript` counts, as for a reader without scripts. A caption is for the media of its own figure, before
    it and after it, and for those of figures within that have no caption; without any it is text at the figure's end.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.head = False
        self.caption: list[str] | None = None
        self.figures: list[tuple[list[int], list[str]]] = []  # open figures: places of media, captions

    def _flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "media": None, "caption": None})

    def _end_caption(self):
        said = " ".join("".join(self.caption or []).split())
        self.caption = None
        if said and self.figures:
            self.figures[-1][1].append(said)
        elif said:
            self.words.append(said)
            self._flush()

    def _end_figure(self):
        self._end_caption()
        self._flush()
        media, captions = self.figures.pop()
        said = " ".join(captions)
        if said and not media:
            self.words.append(said)
            self._flush()
        elif said:
            for k in media:
                self.out[k]["caption"] = said
        elif self.figures:
            self.figures[-1][0].extend(media)

    def finish(self):
        """Ends what the page leaves open."""
        while self.figures:
            self._end_figure()
        self._end_caption()
        self._flush()

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag == "head":
            self.head = True
        if tag == "body" or not self.skip and (tag in _BLOCK or tag in _MEDIA or tag == "figcaption"):
            self.head = False
        if self.skip or self.head:
            return
        if tag in _BLOCK and self.caption is None:
            self._flush()
        elif tag in _BLOCK:
            self.caption.append(" ")
        if tag == "figure":
            self._end_caption()
            self.figures.append(([], []))
        elif tag == "figcaption":
            self._flush()
            self._end_caption()
            self.caption = []
        elif tag in _MEDIA:
            at = dict(attrs)
            if src := at.get("src"):
                self._flush()
                if self.figures:
                    self.figures[-1][0].append(len(self.out))
                self.out.append({"position": len(self.out), "kind": _MEDIA[tag], "text": None, "media": src, "caption": at.get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        if tag not in _SKIP:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "head":
            self.head = False
        elif self.skip or self.head:
            return
        elif tag == "figcaption" and self.caption is not None:
            self._end_caption()
        elif tag == "figure" and self.figures:
            self._end_figure()
        elif tag in _BLOCK and self.caption is None:
            self._flush()
        elif tag in _BLOCK:
            self.caption.append(" ")

    def handle_data(self, data):
        if self.skip:
            return
        self.head = self.head and not data.strip()
        if not self.head:
            (self.words if self.caption is None else self.caption).append(data)


def parsed(page: str | None) -> list[dict]:
    r = _Reader()
    r.feed(page or "")
    r.close()
    r.finish()
    return r.out


def _mapped(df: DataFrame, column: str, row, names: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    keep = [c for c in df.columns if c not in {n for n, _, _ in names}]
    schema = df.select([F.col(f"`{c}`") for c in keep]).schema
    for n, kind, _ in names:
        schema = schema.add(n, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(b.schema.get_field_index(column)).nbytes
            step = max(1, b.num_rows * (8 << 20) // max(size, 1))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                got = [row(x.as_py()) for x in part.column(part.schema.get_field_index(column))]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), *(pa.array([g[n] for g in got], kind) for n, _, kind in names)], names=[*keep, *(n for n, _, _ in names)])

    return df.mapInArrow(run, schema)


def sequences(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `sequence`: ordered text and media-reference structs; positions count from 0 without gaps."""
    return _mapped(pages, column, lambda x: {"sequence": parsed(x)}, [("sequence", SEQUENCE, _ARROW_SEQUENCE)])


def encode(payload: bytes) -> bytes:
    """The stored form: a binary graymap (P5) of 8-bit samples, ROW to a line; len(payload) is a multiple of ROW."""
    return b"P5 %d %d 255\n" % (ROW, len(payload) // ROW) + payload


def decode(media: bytes) -> bytes:
    m = re.match(rb"P5 (\d+) (\d+) 255\n", media)
    w, h = int(m[1]), int(m[2])
    out = media[m.end() :]
    if len(out) != w * h:
        raise ValueError("stored media are cut short")
    return out


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' rows as media: n_bytes (unpadded), digest of the payload, and `media`, the stored form."""

    def row(t):
        p = padded(t)
        return {"n_bytes": len((t or "").encode()), "digest": hashlib.sha256(p).hexdigest(), "media": encode(p)}

    return _mapped(docs, text, row, [("n_bytes", "long", pa.int64()), ("digest", "string", pa.string()), ("media", "binary", pa.binary())])


def saved(docs: DataFrame, text: str = "text") -> DataFrame:
    """The media table of docs' texts, written in the shared folder and read from there; it has stored()'s columns without the text."""
    return written(stored(docs, text).drop(text), "media")


def described(media: DataFrame, column: str = "media") -> DataFrame:
    """What reading the stored bytes back gives: lengths, digests, tail check and `feature` (size, mean, spread, edges)."""

    def row(m):
        p = decode(m)
        x = np.frombuffer(p, np.uint8)
        mean, edges = float(x.mean()), float(np.abs(np.diff(x.astype(np.int16))).mean())
        return {
            "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-ROW:]),
            "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(),
            "feature": f"{ROW}x{len(p) // ROW};mean={mean:.4f};std={float(x.std()):.4f};edges={edges:.4f}",
        }

    names = [("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    return _mapped(media, column, row, names).drop(column)


def resolved(seqs: DataFrame, media: DataFrame, keys: list[str], digest: str = "payload_sha256", sequence: str = "sequence") -> DataFrame:
    """One row per media reference of seqs: keys, position, kind, caption, digest and the payload's description.

    media may repeat digests; equal digests have equal descriptions, of which one is taken before the join. The description
    holds the digest as read back.
    """
    # one row per digest: map-side combine on the digest, so a payload used by a third of all rows is one small row
    one = media.groupBy(F.col(digest).alias("ref_digest")).agg(F.min(F.struct(*media.columns)).alias("payload"))
    refs = seqs.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("of"), F.explode(sequence).alias("r")).where("r.media like 'media:%'").select("of", F.col("r.position").alias("position"), F.col("r.kind").alias("kind"), F.col("r.caption").alias("caption"), F.expr("substring(r.media, 7)").alias("ref_digest"))
    return refs.join(one, "ref_digest", "left").select(*(F.col("of").getField(k).alias(k) for k in keys), "position", "kind", "caption", F.col("ref_digest").alias("digest"), "payload")


def page_of(digest: Column, caption: Column) -> Column:
    """A page that shows the payload of that digest in a figure with that caption (plain text, without markup)."""
    return F.concat(F.lit("<article><p>Document</p><figure><img src='media:"), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure></article>"))
