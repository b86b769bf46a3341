"""What leaves the engine: encrypted pages and crops, result and summary JSON, the corrections log, redacted audit records."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve import dims
from docsieve.operators import trust
from docsieve.pixels.page import crop_box, grey, to_page
from docsieve.plugins import KeyProvider
from docsieve.security.crypto import encrypt


def png_bytes(img: np.ndarray) -> bytes:
    """A grey page as PNG."""
    h, w = img.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def page_png(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else png_bytes(grey(to_page(d, h, w))) for d, h, w in zip(data, height, width)])


def context(**parts: Column) -> Column:
    """The authenticated context: JSON with its keys in order."""
    return F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in sorted(parts.items())]))


def encrypted_pages(pages: DataFrame, keys: KeyProvider) -> DataFrame:
    """(document_id, page, name, secret): each page as PNG, encrypted under its own context."""
    ctx = context(doc_id=F.col("document_id"), page=F.col("page"))
    name = F.format_string("%s_page_%s.enc", F.col("document_id").cast("string"), F.col("page").cast("string"))
    return pages.select("document_id", "page", name.alias("name"), encrypt(page_png("data", "height", "width"), F.lit(keys.key()), ctx).alias("secret"))


def crop(img: np.ndarray, x: float, y: float, w: float, h: float) -> tuple[bytes, str]:
    """The place of a page as PNG, and its digest."""
    x0, y0, x1, y1 = crop_box(x, y, w, h, *img.shape[:2])
    png = png_bytes(np.ascontiguousarray(grey(img[y0:y1, x0:x1])))
    return png, hashlib.sha256(png).hexdigest()[:12]


def _no_place(place: list) -> bool:
    return any(v is None or v != v for v in place)


_CROP = T.StructType([T.StructField("png", T.BinaryType()), T.StructField("digest", T.StringType())])
CROP = "document_id BIGINT, page INT, field_name STRING, x DOUBLE, y DOUBLE, png BINARY, digest STRING"


@F.pandas_udf(_CROP)
def _crop(data: pd.Series, height: pd.Series, width: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    out = [(None, None) if d is None or _no_place(place) else crop(to_page(d, a, b), *place) for d, a, b, *place in zip(data, height, width, x, y, w, h)]
    return pd.DataFrame(out, columns=["png", "digest"])


def page_crops(document_id, page: int, img: np.ndarray, places: list[tuple]) -> list[tuple]:
    """CROP rows of one page from its places (field_name, x, y, w, h)."""
    return [(document_id, page, n, *(None if _no_place([v]) else v for v in at[:2]), *((None, None) if _no_place(at) else crop(img, *at))) for n, *at in places]


def crops(fields: DataFrame, pages: DataFrame, keys: KeyProvider) -> DataFrame:
    """Encrypted crop of each field (document_id, page, field_name, x, y, w, h): crop_ref and secret.

    The box is padded by 4 and kept inside the page; a box without a size is the
    page's corner. A field without a place or page has NULL for both. Pages are large
    whatever their table's size is thought to be, so they are never broadcast.
    """
    j = fields.join(pages.select("document_id", "page", "data", "height", "width").hint("merge"), ["document_id", "page"], "left")
    j = j.withColumn("c", _crop("data", "height", "width", "x", "y", "w", "h"))
    return encrypted_crops(j.select("document_id", "page", "field_name", "x", "y", "c.*"), keys)


def encrypted_crops(cut: DataFrame, keys: KeyProvider) -> DataFrame:
    """crop_ref and secret of crops (columns as CROP's)."""
    whole = lambda c: F.col(c).cast("int").cast("string")  # noqa: E731  towards zero
    crop_id = F.concat(F.lit("crop_"), F.col("document_id").cast("string"), F.lit("_p"), F.col("page").cast("string"), F.lit("_"), whole("x"), F.lit("_"), whole("y"), F.lit("_"), F.col("digest"))
    j = cut.withColumn("crop_id", crop_id)
    ctx = context(crop_id=F.col("crop_id"), doc_id=F.col("document_id"), page=F.col("page"))
    return j.select("document_id", "page", "field_name", F.concat(F.lit("crop://"), "crop_id").alias("crop_ref"), encrypt(F.col("png"), F.lit(keys.key()), ctx).alias("secret"))


def _field_cells() -> Column:
    """A document's scored fields in order of their names, as an aggregate."""
    breakdown = F.struct(F.col("native").alias("native_ocr"), F.col("consistency").alias("consistency_signal"), F.when(F.col("passed"), 1.0).otherwise(0.0).alias("validation_signal"), F.col("flags").alias("validation_flags"), "final")
    cell = F.struct("field_name", "value", F.col("final").alias("confidence"), F.col("agreement").alias("extraction_agreement"), F.when(F.col("passed"), "PASSED").otherwise("FAILED").alias("validation"), breakdown.alias("confidence_breakdown"))
    return F.array_sort(F.collect_list(cell), lambda a, b: F.when(a.field_name < b.field_name, -1).when(a.field_name > b.field_name, 1).otherwise(0)).alias("f")


def _as_json(j: DataFrame) -> DataFrame:
    as_map = F.map_from_entries(F.transform("f", lambda x: F.struct(x.field_name, x)))
    record = F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("status").alias("document_status"), "authenticity_flags", F.col("reasons").alias("escalation_reasons"), as_map.alias("fields"))
    return j.select("document_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def result_json(scored: DataFrame, status: DataFrame) -> DataFrame:
    """(document_id, json): a document's record with its fields. scored: ``trust.fuse_readings``; status: ``trust.escalate``, or what later rules made of it."""
    return _as_json(status.join(scored.groupBy("document_id").agg(_field_cells()), "document_id"))


def scored_json(scored: DataFrame) -> DataFrame:
    """The same with the status that the fields give: they are scored and grouped once."""
    return _as_json(trust.escalate(scored, more=(_field_cells(),)).where("document_id IS NOT NULL"))


def evaluation_json(outcomes: DataFrame) -> DataFrame:
    """One row, one JSON: overall figures, figures a field, calibration."""
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  a row a field or bucket
    overall = trust.metrics(outcomes, []).select(F.struct("precision", "recall", "f1", "tp", "fp", "fn").alias("overall"))
    j = overall.crossJoin(pack(trust.metrics(outcomes, ["field_name"]), "fields")).crossJoin(pack(trust.calibration(outcomes), "calibration"))  # one row each
    return j.crossJoin(outcomes.agg(F.countDistinct("document_id").alias("sample_count"))).select(F.to_json(F.struct("sample_count", "overall", "fields", "calibration")).alias("json"))


def append_corrections(corrections: DataFrame, path: str) -> None:
    """Add corrections to the log; what is there stays."""
    corrections.write.mode("append").json(path)


def redact(value, key: str = ""):
    """A value of an audit record as it may be written: digests under sensitive keys, dicts and lists of them gone through."""
    if any(s in key.lower() for s in dims.SENSITIVE_KEYS) and key:
        return f"[REDACTED:sha256={hashlib.sha256(value.encode()).hexdigest()[:12]}]" if isinstance(value, str) else "[REDACTED]"
    if isinstance(value, dict):
        return {k: redact(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v) if isinstance(v, dict) else v for v in value]
    return value


@F.pandas_udf(T.StringType())
def redacted_json(details: pd.Series) -> pd.Series:
    """JSON objects with all that is sensitive redacted at any depth; what is no JSON object is redacted whole."""

    def one(text):
        if text is None:
            return None
        try:
            found = json.loads(text)
        except ValueError:
            found = None
        return json.dumps(redact(found)) if isinstance(found, dict) else "[REDACTED]"

    return details.map(one)


def audit_rows(events: DataFrame) -> DataFrame:
    """events (timestamp, actor_id, document_id, action, details as JSON) as they may be stored."""
    return events.select("timestamp", "actor_id", "document_id", "action", redacted_json("details").alias("details"))
