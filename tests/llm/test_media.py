import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import media


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 192, bytes(range(256)) * 40, "é".encode() * 1000])
def test_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and payload.startswith(data) and len(payload) - len(data) <= 192 and payload
    stored = media.encode_image(payload)
    assert media.decode_image(stored) == payload
    damaged = bytearray(stored)
    damaged[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_image(bytes(damaged))


def test_parse_keeps_order_and_captions():
    html = "<h1>Title</h1><p>One <b>two</b></p><figure><img src='sha256:aa' alt='alt'><video src='v.mp4'></video><figcaption>A  caption</figcaption></figure><script>no()</script><p>Three<img src='sha256:bb' alt='beta'>four</p><img alt='no source'>"
    items = media.parse(html)
    assert [i["position"] for i in items] == list(range(len(items)))
    assert [i["text"] or i["ref"] for i in items] == ["Title", "One two", "sha256:aa", "v.mp4", "Three", "sha256:bb", "four"]
    assert [i["caption"] for i in items if i["kind"] == "media"] == ["A caption", "A caption", "beta"]
    assert items[2]["digest"] == "aa" and items[3]["digest"] == hashlib.sha256(b"v.mp4").hexdigest()
    assert media.parse(None) == media.parse("") == media.parse("<p> </p>") == []
    assert len(media.parse("<p>x" * 20_000)) == 20_000


def test_digest_join_resolves_payloads(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='sha256:d1'><p>b</p><img src='sha256:missing'>"), (1, "<img src='sha256:d1'>"), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("d1", bytearray(b"payload")), ("d2", bytearray(b"unused"))], "digest string, payload binary")
    got = media.resolve(media.interleave(pages), store).orderBy("page_id", "position", F.col("payload").isNull()).collect()
    assert [(r["position"], r["text"], None if r["payload"] is None else bytes(r["payload"])) for r in got] == [(0, None, b"payload"), (0, "a", None), (1, None, b"payload"), (2, "b", None), (3, None, None)]


def test_query_on_edge_cases(spark, edge, empty, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op4_media(spark, str(tmp_path)).collect()
    texts = [((r["doc_id"]), (r["text"] or "").encode()) for r in edge.select("doc_id", "text").collect()]
    expected = []
    for d, b in texts:
        p = media.pad(b)
        expected.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=repr) == sorted(expected, key=repr)
    by_text = {}
    for r in got:
        assert by_text.setdefault((r["n_bytes"], r["payload_sha256"]), (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.store_texts(empty).collect() == []


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = media.interleave(pages)
    assert out.count() == pages.count() and out.where("size(items) > 3").count() > pages.count() / 2


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='sha256:d1'>", "own text", "own kind", 7)], "page_id long, html string, text string, kind string, items long")
    store = spark.createDataFrame([("d1", bytearray(b"payload"), "paid")], "digest string, payload binary, caption string")
    out = media.resolve(media.interleave(pages, keep=("text", "kind", "items", "html")), store)
    assert out.columns == ["page_id", "text", "kind", "items", "html", "position", "item_kind", "item_text", "ref", "digest", "caption", "payload", "media_caption"]
    rows = out.orderBy("position").collect()
    assert [(r["text"], r["item_text"], r["items"], r["media_caption"]) for r in rows] == [("own text", "a", 7, None), ("own text", None, 7, "paid")]


def test_stored_form_and_feature_against_brute_force():
    import math

    for data in (b"a", b"hello world " * 50, bytes(range(256)) * 3, "é".encode() * 700):
        payload = media.pad(data)
        stored = media.encode_image(payload)
        rows = [b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192)]
        assert zlib.decompress(stored[stored.index(b"IDAT") + 4 : -16]) == b"".join(rows) and stored.endswith(b"IEND\xaeB`\x82")
        assert int.from_bytes(stored[16:20], "big") == 192 and int.from_bytes(stored[20:24], "big") == len(rows)
        bits, mean, deviation, entropy = media.describe(payload).split(":")
        n, step = len(payload), len(payload) // 64
        m = sum(payload) / n
        parts = [sum(payload[i * step : (i + 1) * step]) / step > m for i in range(64)]
        assert int(bits, 16) == int("".join("01"[x] for x in parts), 2)
        assert float(mean) == pytest.approx(m, abs=6e-4) and float(deviation) == pytest.approx(math.sqrt(sum((x - m) ** 2 for x in payload) / n), abs=6e-4)
        assert float(entropy) == pytest.approx(-sum(c / n * math.log2(c / n) for c in map(payload.count, range(256)) if c), abs=6e-5)


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_pages_query(spark):
    got = {r["page_id"]: r for r in media.media_pages(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        items = media.parse(p["html"])
        r = got[p["page_id"]]
        assert (r["n_items"], r["n_texts"], r["n_media"]) == (len(items), sum(x["kind"] == "text" for x in items), sum(x["kind"] == "media" for x in items))
        assert r["texts_sha256"] == hashlib.sha256("\n".join(x["text"] for x in items if x["kind"] == "text").encode()).hexdigest()
