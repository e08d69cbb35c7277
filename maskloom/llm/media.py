"""Media columns: interleaved document sequences, a content-addressed media store, and features of what it holds.

HTML is parsed into an ordered array of items: text, or a reference to media with its caption. A reference names its payload by digest.
Payloads lie in a store (a written table) as grey images of 8-bit samples, 64 to a row, losslessly; reading back undoes the
image format. An equi-join on the digest resolves references; positions and captions stay with their item. A payload is stored
once for each batch that has it; what is read back is distinct before the join, so a payload that a third of all documents share is one row there.

Defined results: a null or empty text is one row of 64 zero samples; a null page has no items; references that the store lacks
resolve to null; equal payloads have equal digests, stored bytes and features; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_RULE, Scratch, crc32_sql, prepare

ROW = 64
SCHEME = "sha256:"
ITEM = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class _Items(HTMLParser):
    """Collects items in the order of the page."""

    breaks = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tr td th article section figure blockquote pre".split())
    silent = frozenset("script style template noscript title".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict[str, Any]] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: list[dict[str, Any]] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.silent:
            self.hidden += 1
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source", "embed"):
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                item = {"position": len(self.items), "kind": "image" if tag == "img" else "media", "text": None, "ref": found["src"], "caption": found.get("alt") or found.get("title") or None}
                self.items.append(item)
                if self.figure is not None:
                    self.figure.append(item)
        elif tag in self.breaks:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for item in self.figure or []:
                item["caption"] = caption or item["caption"]
            self.caption = None
        elif tag in self.breaks:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.text.append(data)


def parse_items(html: str | None) -> list[dict[str, Any]]:
    """The ordered items of one page."""
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, html_col: str = "html", items_col: str = "items") -> DataFrame:
    """``pages`` with the ordered items in place of the HTML."""
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c != html_col]

    @F.pandas_udf(ITEM)
    def items(html: pd.Series) -> pd.Series:
        return pd.Series([parse_items(x) for x in html], dtype=object)

    return pages.select(*kept, items(F.col(html_col).cast("string")).alias(items_col))


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % ROW or (ROW if not payload else 0))


def to_image(payload: bytes) -> bytes:
    """An 8-bit grey PNG, ROW samples to a row, no row filter."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)
    lines[:, 1:] = samples

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def samples_of(image: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey PNG without row filters, as ``to_image`` writes it; checks every chunk's checksum."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width, height = 8, [], 0, 0
    while at < len(image):
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not supported")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Height, integer mean, entropy in thousandths of a bit, and a 64-bit hash of which columns lie above their mean."""
    count = np.bincount(samples.ravel(), minlength=256)
    p = count[count > 0] / samples.size
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = int("".join("1" if c * ROW > int(columns.sum()) else "0" for c in columns.tolist()), 2)
    return f"h={len(samples)};mean={int(samples.sum(dtype=np.int64)) * 1000 // samples.size};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)};columns={bits:016x}"


def digest(text: Column) -> Column:
    """The digest of a text's padded payload, in SQL."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.octet_length(text)
    pad = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW))).cast("int")
    return F.sha2(F.concat(text.cast("binary"), F.repeat(F.lit("\0"), pad).cast("binary")), 256)


def store(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, image: the media of each text, once for each distinct one of a batch. Write it to read it back."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, bytes] = {}
            for text in set(batch.column(0).to_pylist()):
                payload = padded((text or "").encode())
                made[hashlib.sha256(payload).hexdigest()] = to_image(payload)
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.binary())], ["digest", "image"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, image binary")


def read_back(stored: DataFrame) -> DataFrame:
    """One row for each digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = samples_of(image)
                payload = samples.tobytes()
                rows.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.mapInArrow(run, kind).distinct()


def resolve(sequenced: DataFrame, media: DataFrame, items_col: str = "items", every: bool = False) -> DataFrame:
    """One row for each item with a digest, or with ``every`` for each media item whatever its reference.

    The other columns, position, caption, and the columns of ``media`` (null if the store lacks it); the digest of other references is null.
    """
    kept = [c for c in sequenced.columns if c != items_col]
    digest = F.substr("_ref", F.lit(len(SCHEME) + 1)).alias("digest")
    refs = sequenced.select(*kept, F.explode(F.filter(items_col, lambda x: x["kind"] != "text" if every else x["ref"].startswith(SCHEME))).alias("_item"))
    refs = refs.select(*kept, F.col("_item.position").alias("position"), F.col("_item.caption").alias("caption"), F.col("_item.ref").alias("_ref"))
    if not every:
        return refs.withColumn("digest", digest).drop("_ref").join(media, "digest", "left")
    # On the whole reference: other references equal no payload's, and no null gathers them in one task.
    payload = media.withColumnRenamed("digest", "_digest")
    joined = refs.join(payload, F.col("_ref") == F.concat(F.lit(SCHEME), F.col("_digest")), "left")
    return joined.select(F.when(F.col("_ref").startswith(SCHEME), digest).alias("digest"), *kept, "position", "caption", *(c for c in media.columns if c != "digest"))


def document_page(text: Column, reference: Column, caption: Column) -> Column:
    """A document as a page: its lines are paragraphs, and after the first one stands a figure."""
    lines = F.split(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\n", -1)
    rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "</p><p>")
    return F.concat(F.lit("<article><p>"), F.get(lines, F.lit(0)), F.lit('</p><figure><img src="'), reference, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>"), rest, F.lit("</p></article>"))


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as a sequence of its lines and, after the first one, its payload: doc_id, n_bytes, n_items, position, caption and what ``read_back`` gives."""
    scratch = Scratch(docs.sparkSession)
    media = read_back(scratch.write(store(docs, text_col), "media", compression="uncompressed"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("bigint")
    html = document_page(text, F.concat(F.lit(SCHEME), digest(F.col(text_col))), F.concat(size.cast("string"), F.lit(" bytes")))
    sequenced = sequences(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), size.alias("n_bytes"), html.alias("html")))
    return resolve(sequenced.select("doc_id", "n_bytes", F.size("items").alias("n_items"), "items"), media).drop("digest")


#: What a stored payload must give back, in DuckDB; stored forms and features are held against plain versions in tests.
ORACLE_SQL = f"""SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(length(padded) // 2 AS BIGINT) AS payload_bytes, sha256(unhex(padded)) AS payload_sha256,
    CAST({crc32_sql(f"right(padded, {2 * ROW})")} AS BIGINT) AS tail_crc32
    FROM (SELECT doc_id, h, h || repeat('00', CASE WHEN h = '' THEN {ROW} ELSE ({ROW} - length(h) // 2 % {ROW}) % {ROW} END) AS padded
    FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)), ({CRC_RULE})"""
