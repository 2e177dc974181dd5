"""Media columns: interleaved sequences of text and media references, parsed from HTML.

* ``sequences`` parses a page into ordered structs: runs of text, and media references (img, video,
  audio, source, embed) with the caption of their figure (or their alt text). Positions number both
  kinds together, so the order of the page survives.
* ``stored`` is the form of a payload: an 8-bit greyscale PNG of ``ROW`` samples a row, lossless;
  ``read_back`` checks the chunks' sums and returns the samples.
* ``resolve`` joins references to a store of media by digest (SHA-256 of the stored bytes). Positions
  and captions travel with the reference, so they stay aligned whatever order the join returns.
* ``roundtrip`` does this for documents: each becomes a page of its whole text, a paragraph for each line,
  with the text's payload as a referenced image after the first paragraph. The page is parsed where it is
  made: the text is stored once, in the image, and of the page its sequence: place, caption and reference
  of the medium, number and digest of the text items. These and the store are written, read back and joined.

Scale. Payload bytes are written once and never shuffled: they are read back and reduced to features
where they lie, and only the features (some 300 bytes a medium) are made unique by digest, which
combines map-side. The features are checkpointed before the join, so both inputs are plain scans and
adaptive execution can split a digest that a third of all documents share.

Defined results: null text is an empty text, null html an empty page; the padded payload of an empty
text is one row; a reference whose digest the store lacks keeps its place with null features; repeated
rows give repeated output rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as markup
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import checkpointed, fresh, scratch

ROW = 192
TAIL = 16
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}
_SILENT = {"script", "style", "template", "noscript"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "figure", "figcaption", "blockquote", "pre", "hr"}
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


# ---- parsing -------------------------------------------------------------------------------------


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BREAKS and self.caption is None:
            self._flush()
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            found = dict(attrs)
            if ref := found.get(_MEDIA[tag]):
                self._flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": found.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for at in self.figure or ():
                self.items[at]["caption"] = text or self.items[at]["caption"]
            if not self.figure and text:
                self.words.append(text)
                self._flush()
        elif tag == "figure":
            self.figure = None
        if tag in _BREAKS and self.caption is None:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The ordered items of one page. A caption outside a figure with media is text."""
    reader = _Page()
    reader.feed(page or "")
    reader.close()
    if reader.caption is not None:
        reader.handle_endtag("figcaption")
    reader._flush()
    return [{"position": n, **item} for n, item in enumerate(reader.items)]


def sequences(html: str | Column) -> Column:
    """The sequence of a column of pages."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    @F.arrow_udf(SEQUENCE)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([parse(p) for p in pages.to_pylist()], kind)

    return run((F.col(html) if isinstance(html, str) else html).cast("string"))


# ---- the stored form -----------------------------------------------------------------------------

_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(name: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")


def payload(text: str | None) -> bytes:
    """UTF-8 and spaces up to a positive multiple of ROW."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def stored(samples: bytes) -> bytes:
    """A greyscale PNG, ROW samples wide, of 8 bits each."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = rows
    header = ROW.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return _MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_back(image: bytes) -> bytes:
    """The samples of a PNG made by ``stored``; ValueError if a sum or the form is wrong."""
    if image[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, header = 8, [], b""
    while at < len(image):
        size, name = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != int.from_bytes(image[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk's sum is wrong")
        if name == b"IHDR":
            header = body
        elif name == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if header[8:] != bytes([8, 0, 0, 0, 0]) or lines[:, 0].any():
        raise ValueError("not of this form")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, integer mean and the histogram of the samples in eight equal bands."""
    values = np.frombuffer(samples, np.uint8)
    bands = np.bincount(values >> 5, minlength=8)
    return f"{ROW}x{len(values) // ROW};{int(values.sum(dtype=np.int64)) // max(1, len(values))};{'.'.join(map(str, bands.tolist()))}"


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(store: DataFrame) -> DataFrame:
    """The features of each stored medium (digest, media), read back from its bytes; one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                image = image.as_py()
                samples = read_back(image)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[p.split()[0] for p in FEATURES.split(", ")])

    made = store.select("digest", "media").where("media is not null").mapInArrow(run, FEATURES)
    rest = [F.min(c).alias(c) for c in made.columns[1:]]  # equal digests, equal rows
    return made.groupBy("digest").agg(*rest)


def resolve(refs: DataFrame, features: DataFrame, digest: str = "digest") -> DataFrame:
    """Every row of ``refs`` with the features of its digest (null where the store has none)."""
    (key,) = fresh(refs, "digest")
    known = checkpointed(features).withColumnRenamed("digest", key)
    return refs.join(known, F.col(digest) == F.col(key), "left").drop(key)


# ---- documents as pages --------------------------------------------------------------------------

SCHEME = "media:sha256:"
PAGED = "doc_id long, n_bytes long, position int, caption string, n_texts long, texts_sha256 string, digest string, media binary"


def page_of(text: str | None, digest: str, size: int, height: int) -> str:
    """The page of a text: its lines as paragraphs, the image after the first that is not blank."""
    lines = [line for line in (text or "").split("\n") if line and not line.isspace()]
    paragraphs = [f"<p>{markup.escape(line)}</p>" for line in lines]
    figure = f'<figure><img src="{SCHEME}{digest}" width="{ROW}" height="{height}"><figcaption>{size} bytes</figcaption></figure>'
    return f"<article>{''.join(paragraphs[:1])}{figure}{''.join(paragraphs[1:])}</article>"


def pages_of(docs: DataFrame) -> DataFrame:
    """The sequence of each document's page (see PAGED) and the image that the page refers to, a row for each medium.

    A text item is a line's words with single spaces; blank lines give none. texts_sha256 is of the items, joined by line feeds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist()):
                    samples = payload(text)
                    image = stored(samples)
                    digest = hashlib.sha256(image).hexdigest()
                    n = len((text or "").encode())
                    items = parse(page_of(text, digest, n, len(samples) // ROW))
                    texts = [i["text"] for i in items if i["kind"] == "text"]
                    summary = hashlib.sha256("\n".join(texts).encode()).hexdigest()
                    rows += [(doc, n, i["position"], i["caption"], len(texts), summary, i["ref"].removeprefix(SCHEME), image) for i in items if i["kind"] == "media"]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[p.split()[0] for p in PAGED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PAGED)


def roundtrip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the features of the medium as read back from the store, and its place and caption on the page, and the number and digest of the page's text items."""
    path = scratch(docs.sparkSession, "media")
    pages_of(docs).write.option("compression", "none").parquet(path)  # the images are compressed already
    written = docs.sparkSession.read.parquet(path)
    return resolve(written.drop("media"), described(written)).drop("digest")
