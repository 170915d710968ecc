"""Interleaved document sequences: ordered text and media references, with payloads joined by digest.

``parse`` turns HTML into items: text runs and media references in reading order, each
with its position and caption. ``media_table`` keeps one stored payload per digest and
``resolve`` joins references to it, so that a payload travels once however many
documents show it, and position and caption stay in the referring row.

Stored form: 8-bit greyscale PNG, 24 samples wide, whose samples are the payload bytes.

Null HTML gives no items; null text is stored as empty text. A reference whose digest
is not in the media table keeps a null payload. Repeated rows resolve alike, references
repeated in one document keep their own positions, an empty table gives an empty one.
A very long text is one image, made and read whole by one task. Columns are kept, whatever
their names, but those named like a result (items; position, kind, text, ref, caption and the
media's columns) give way to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelens import session
from tracelens.llm import _text

WIDTH = 24
BLOCK = WIDTH * 24
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
SKIPPED = {"script", "style", "template", "noscript", "head"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "figure", "blockquote", "nav", "pre"}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(text: bytes) -> bytes:
    """The payload: the text and bytes 255 up to a positive multiple of the block."""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def store(payload: bytes) -> bytes:
    """A PNG whose samples are the payload; the same payload always gives the same bytes."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def load(stored: bytes) -> np.ndarray:
    """The samples of a greyscale PNG (rows, columns); checks every chunk's CRC."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk's CRC differs")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale without interlace is stored here")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and a 64-bit gradient hash of the samples."""
    count = np.bincount(samples.reshape(-1), minlength=256)
    total = count.sum()
    level = np.arange(256)
    mean = float((count * level).sum() / total)
    deviation = float(np.sqrt(max(0.0, (count * level * level).sum() / total - mean * mean)))
    p = count[count > 0] / total
    rows = np.linspace(0, samples.shape[0], 9).astype(np.int64)[:-1]
    columns = np.linspace(0, samples.shape[1], 10).astype(np.int64)[:-1]
    small = np.add.reduceat(np.add.reduceat(samples, rows, axis=0, dtype=np.int64), columns, axis=1)
    bits = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} dev={deviation:.4f} entropy={float(-(p * np.log2(p)).sum()):.4f} grad={bits}"


class _Items(HTMLParser):
    """Text runs and media references in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skipped = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        if self.skipped:
            return
        given = dict(attrs)
        if tag == "figcaption":
            self.caption = []
        elif tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        if tag in MEDIA_TAGS and given.get("src"):
            self.flush()
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or given.get("title")})

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped:
            return
        if tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] == "media" and caption:
                    item["caption"] = caption
        elif tag in BREAKS:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data):
        if not self.skipped:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    if not html:
        return []
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.items


def _map(df: DataFrame, kept: list[str], column: str, types: list[tuple[str, str]], values) -> DataFrame:
    """Adds columns computed by ``values(batch of the column) -> lists`` to the kept ones."""
    session.ship(df.sparkSession)
    names = [n for n, _ in types]
    kept = [c for c in kept if c not in names]
    schema = df.select(*kept).schema
    for n, t in types:
        schema = schema.add(StructType.fromDDL(f"{n} {t}").fields[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for batch in batches:
            sizes = np.append(0, np.cumsum([len(x) if x is not None else 0 for x in batch.column(len(kept)).cast(pa.large_binary()).to_pylist()]))
            for lo, hi in _text.row_slices(sizes, 4 << 20):
                part = batch.slice(lo, hi - lo)
                new = values(part.column(len(kept)).to_pylist())
                arrays = [*(c.cast(fields.field(i).type) for i, c in enumerate(part.columns[: len(kept)])), *(pa.array(x, fields.field(len(kept) + i).type) for i, x in enumerate(new))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return df.select(*[df[c] for c in kept], df[column].alias("__in")).mapInArrow(run, schema)


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages without their HTML, with ``items``: the sequence of text and media references."""
    return _map(pages, [c for c in pages.columns if c != html], html, [("items", ITEMS)], lambda x: [[parse_html(h) for h in x]])


def media_table(media: DataFrame, digest: str = "digest", payload: str = "media") -> DataFrame:
    """One stored payload per digest; equal ones meet in each task before the shuffle."""
    return media.groupBy(digest).agg(F.first(payload).alias(payload))


def resolve(sequences: DataFrame, media: DataFrame, digest: str = "digest") -> DataFrame:
    """A row per item: the sequence's columns, position, kind, text, ref, caption and the media's columns.

    References of the form ``sha256:<hex>`` are joined by that digest. Only references
    travel to the join; text items never do.
    """
    items = sequences.withColumn("__item", F.explode_outer("items")).drop("items")
    flat = items.select(*[c for c in items.columns if c != "__item"], "__item.*")
    flat = flat.withColumn("__digest", F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1))
    known = media.withColumnRenamed(digest, "__digest")
    shown = flat.where(F.col("kind") == "media").join(known, "__digest", "left").drop("__digest")
    rest = flat.where(~F.col("kind").eqNullSafe("media")).drop("__digest")
    return shown.unionByName(rest, allowMissingColumns=True)


def _stored(texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return raw, [store(pad(t)) for t in raw]


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest and media: each text's payload in stored form."""

    def values(texts):
        _, stored = _stored(texts)
        return [[hashlib.sha256(m).hexdigest() for m in stored], stored]

    return _map(docs, [], text, [("digest", "string"), ("media", "binary")], values)


def text_pages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A page per document that shows its payload by reference: key, n_bytes, html."""

    def values(texts):
        raw, stored = _stored(texts)
        pages = [
            f'<article><h1>Document</h1><p>Its text follows.</p><figure><img src="sha256:{hashlib.sha256(m).hexdigest()}" alt="text"><figcaption>{len(t)} bytes</figcaption></figure><p>End.</p></article>'
            for t, m in zip(raw, stored, strict=True)
        ]
        return [[len(t) for t in raw], pages]

    return _map(docs, [key], text, [("n_bytes", "long"), ("html", "string")], values)


def read_back(media: DataFrame) -> DataFrame:
    """Per digest what the stored bytes hold: payload size, digest, CRC of the last block, features."""

    def values(stored):
        out: list[list] = [[], [], [], [], [], []]
        for m in stored:
            samples = load(m)
            payload = samples.tobytes()
            for column, x in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(samples)), strict=True):
                column.append(x)
        return out

    types = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    return _map(media, ["digest"], "media", types, values)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through the media columns and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = read_back(media_table(store_texts(docs)))
    rows = resolve(parse(text_pages(docs)), known).where(F.col("kind") == "media")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
