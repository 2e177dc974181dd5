import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import media


def row(doc, text):
    raw = (text or "").encode()
    size = max(192, -(-len(raw) // 192) * 192)
    full = raw + b" " * (size - len(raw))
    return doc, len(raw), size, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])


def test_documents_round_trip(spark):
    rng = random.Random(1)
    rows = [*ODD, *((100 + i, "é<b>&\x00 " * rng.randint(0, 90)) for i in range(40))]
    out = media.roundtrip(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=str) == sorted((row(*r[:2]) for r in rows), key=str)
    by = {}
    for r in out:  # equal texts, equal values; aligned captions
        assert r.caption == f"{r.n_bytes} bytes"
        values = (r.media_bytes, r.media_sha256, r.feature)
        assert by.setdefault(r.payload_sha256, values) == values
    image = media.stored(media.payload("one"))
    assert by[hashlib.sha256(media.payload("one")).hexdigest()][:2] == (len(image), hashlib.sha256(image).hexdigest())


def test_pages_hold_the_whole_text(spark):
    rows = [(1, "x" * 300 + " end\nsecond  <b>line</b> &amp; more\n \n" + "third " * 50), (2, "\n\nafter a blank line"), (3, ""), (4, None), *((100 + i, text) for i, (_, text, *_) in enumerate(ODD))]
    got = {r.doc_id: r for r in media.roundtrip(documents(spark, rows)).collect()}
    for doc, text in rows:
        items = [" ".join(line.split()) for line in (text or "").split("\n") if line.strip()]
        assert (got[doc].n_texts, got[doc].position) == (len(items), min(1, len(items)))
        assert got[doc].texts_sha256 == hashlib.sha256("\n".join(items).encode()).hexdigest()


def test_stored_form_is_lossless_and_checked():
    rng = random.Random(2)
    for n in (0, 1, 191, 192, 193, 5000):
        samples = media.payload("".join(chr(rng.randint(1, 0x2FF)) for _ in range(n)))
        image = media.stored(samples)
        assert media.read_back(image) == samples
        with pytest.raises((ValueError, zlib.error)):
            media.read_back(image[:60] + bytes([image[60] ^ 1]) + image[61:])


PAGE = """<html><script>no</script><p>First   <b>bold</b></p><figure><img src="a.png" alt="x"><figcaption>The <i>caption</i></figcaption></figure>
tail &amp; more<img src="b.png" alt="alone"><img><div>last</div><video src="c.mp4"></video></html>"""


def test_pages_keep_order_and_captions():
    items = media.parse(PAGE)
    assert [i["position"] for i in items] == list(range(6))
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        ("text", "First bold", None), ("media", "a.png", "The caption"), ("text", "tail & more", None),
        ("media", "b.png", "alone"), ("text", "last", None), ("media", "c.mp4", None),
    ]
    assert media.parse(None) == [] and media.parse("<figcaption>x") == [{"position": 0, "kind": "text", "text": "x", "ref": None, "caption": None}]


def test_references_resolve_by_digest(spark):
    image = media.stored(media.payload("hello"))
    digest = hashlib.sha256(image).hexdigest()
    store = spark.createDataFrame([(digest, image), (digest, image)], "digest string, media binary")
    refs = spark.createDataFrame([(1, 0, digest), (1, 2, "missing"), (2, 5, digest), (3, 1, None)], "page long, position int, digest string")
    out = sorted(map(tuple, media.resolve(refs, media.described(store)).select("page", "position", "payload_bytes").collect()))
    assert out == [(1, 0, 192), (1, 2, None), (2, 5, 192), (3, 1, None)]


def test_driver_pages_and_empty_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = pages.select(media.sequences("html").alias("s")).collect()
    assert len(out) == pages.count() and any(len(r.s) > 1 for r in out)
    assert media.roundtrip(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "a")]).withColumns({"html": F.lit(1), "digest": F.lit(2), "media": F.lit(3), "position": F.lit(4)})
    assert media.roundtrip(df).count() == 1
