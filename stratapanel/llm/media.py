"""Media columns: interleaved document sequences.

HTML becomes an ordered sequence of text and media-reference structs.  A media
reference names its payload by digest; a join on digests resolves payloads, and each
item keeps its position and its caption.  Payloads are stored as 8-bit greyscale PNG.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stratapanel.llm.common import cut, documents, free, plainly

#: Samples in a row of a stored image; level of its compression.
WIDTH, LEVEL = 192, 1
DIGEST = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>"
# Elements that end a block of text, that hold no text, and that refer to media.
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul", "title"))
HIDDEN = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


class _Sequence(HTMLParser):
    """Collects text blocks and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figures: list[list[dict]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            self.flush()
            given = dict(attrs)
            if ref := given.get("src"):
                digest = ref[len(DIGEST) :] if ref.startswith(DIGEST) else hashlib.sha256(ref.encode("utf-8", "replace")).hexdigest()
                self.items.append({"kind": "media", "text": None, "ref": ref, "digest": digest, "caption": given.get("alt")})
                if self.figures:
                    self.figures[-1].append(self.items[-1])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append([])
            elif tag == "figcaption" and self.figures:
                self.caption = []

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figures[-1] if self.figures else []:
                item["caption"] = caption or item["caption"]
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Items in order: {position, kind, text, ref, digest, caption}.

    A figure's caption belongs to each of its media items and isn't a text item;
    without one, the alternative text is the caption.  A reference that isn't a
    digest is known by the digest of its address.
    """
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i} | item for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns in ``keep``, items array): one row for each input row.

    Null, empty and textless HTML has no items; repeated rows are parsed each.  Where
    the id or ``keep`` is called items, the result is called media_items; it comes last.
    """
    (result,) = free(["items"], [id_col, *keep], "media_")
    picked = plainly(pages.select(f"`{id_col}`", *(f"`{c}`" for c in keep), F.col(html_col)))
    schema = StructType([*picked.schema.fields[:-1], StructField("items", StructType.fromDDL(f"items array<{ITEM}>")[0].dataType)])

    names = schema.names

    def read(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption"))]))
        for batch in batches:
            *rest, html = batch.columns
            yield pa.RecordBatch.from_arrays([*rest, pa.array([parse(h) for h in html.to_pylist()], kind)], names)

    return picked.mapInArrow(read, schema).toDF(id_col, *keep, result)


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each item, with the columns of ``media`` (unique digest, payload columns) for what its digest names.

    Text items and references without a payload have nulls there, so that positions
    stay aligned; an empty sequence gives no row.  A digest that very many items
    name is a skewed key of a plain join, which Spark splits.  ``sequences`` is of
    ``interleave``: its last column holds the items.  Item fields whose name another
    column of ``sequences`` has are called item_<name>, payload columns media_<name>.
    """
    *own, items = sequences.columns
    fields = [f.name for f in sequences.schema[-1].dataType.elementType.fields]
    named = free(fields, own, "item_")
    each = sequences.select(*(f"`{c}`" for c in own), F.explode(f"`{items}`").alias(free(["item"], own, "_")[0]))
    item = each.columns[-1]
    each = each.select(*(f"`{c}`" for c in own), *(F.col(item)[f].alias(n) for f, n in zip(fields, named)))
    payload = [c for c in media.columns if c != "digest"]
    key, *shown = free(["digest", *payload], each.columns, "media_")
    facts = media.select(F.col("digest").alias(key), *(F.col(f"`{c}`").alias(n) for c, n in zip(payload, shown)))
    return each.join(facts, F.col(named[fields.index("digest")]) == F.col(key), "left").drop(key)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit greyscale PNG whose rows are ``width`` successive bytes (a divisor of the length)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # a leading 0: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_image(stored: bytes) -> bytes:
    """The samples of an image that ``encode_image`` stored, checked chunk by chunk."""
    if stored[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, width, data = 8, 0, []
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if stored[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` and spaces up to a positive multiple of ``unit``."""
    return data + b" " * (-len(data) % unit if data else unit)


def describe(payload: bytes) -> str:
    """Average hash over 64 equal segments, mean, deviation, and entropy of the samples in bits."""
    samples = np.frombuffer(payload, np.uint8)
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(parts * 64 > parts.sum()).tobytes().hex()
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    return f"{bits}:{samples.mean():.3f}:{samples.std():.3f}:{-(share * np.log2(share)).sum():.4f}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, html, digest, media): each text as an image, and a page that shows it."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def write(batches):
        for batch in batches:
            pages, digests, stored, sizes = [], [], [], []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist()):
                media = encode_image(pad(data))
                digest = hashlib.sha256(media).hexdigest()
                name = escape(str(doc_id), quote=True)
                pages.append(f'<article><h1>Document {name}</h1><figure><img src="{DIGEST}{digest}" alt="{name}"><figcaption>{len(data)} bytes of text</figcaption></figure></article>')
                digests.append(digest), stored.append(media), sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "html", "digest", "media"])

    return picked.mapInArrow(write, f"doc_id {kind}, n_bytes long, html string, digest string, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """For each stored image (digest, media): sizes, digests and features of its bytes and of its samples."""

    def read(batches):
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                payload = decode_image(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return media.mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(store_texts(documents(spark, sf_dir)))
    facts = read_back(stored.select("digest", "media")).distinct()
    shown = resolve(interleave(stored, "doc_id", "html", ("n_bytes",)), facts).where("kind = 'media'")
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of each web page: its items, texts, references and captions, and the digest of its text blocks in order."""
    pages = interleave(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    refs = F.transform(F.filter("items", lambda x: x["kind"] == "media"), lambda x: F.concat_ws(" ", x["position"].cast("string"), x["ref"], x["caption"]))
    return pages.select(
        "page_id", F.size("items").alias("n_items"), F.size(texts).alias("n_texts"), F.size(refs).alias("n_media"),
        F.sha2(F.array_join(texts, "\n"), 256).alias("texts_sha256"), F.array_join(refs, "\n").alias("references"),
    )


QUERIES = {"op4_media": op4_media, "media_pages": media_pages}
ORACLES: dict[str, str] = {}
