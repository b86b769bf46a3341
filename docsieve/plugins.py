"""What this engine leaves to others: character recognition, vision models, PDF readers, keys.

Each is an object with one method, run over pages in Arrow batches on the
executors; it must be picklable, or open its model when it is first called there.
"""

from __future__ import annotations

import json
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.pixels.page import to_page
from docsieve.sources.records import vision_fields


class OcrEngine(Protocol):
    def read(self, page: np.ndarray) -> list[tuple[list[tuple[float, float]], str, float]]:
        """(corners, text, score) of each token of a page."""


class VisionBackend(Protocol):
    def ask(self, page: np.ndarray, prompt: str) -> str:
        """The model's answer: JSON of fields, see ``records.vision_fields``."""


class PdfReader(Protocol):
    def pages(self, content: bytes) -> list[tuple[np.ndarray, str | None]]:
        """(grey page, text layer) of each page; raises PermissionError if the file is encrypted."""


class KeyProvider(Protocol):
    def key(self) -> bytes:
        """A 256-bit key."""


class FixedKey:
    """A given key. There is no random fallback: what it encrypts could never be read again."""

    def __init__(self, key: bytes):
        if len(key) != 32:
            raise ValueError("the key must have 32 bytes")
        self._key = bytes(key)

    def key(self) -> bytes:
        return self._key


PROMPT = "Read this page and answer with one JSON object: field name to {value, confidence, bbox, raw_text}. No prose, no fences."
TOKENS = "document_id STRING, page INT, tok_seq INT, text STRING, conf DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


def box(corners: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    """(x, y, w, h) around corners."""
    a = np.array(corners, dtype=float)
    (x, y), (x1, y1) = a.min(0), a.max(0)
    return float(x), float(y), float(x1 - x), float(y1 - y)


def read_tokens(pages: DataFrame, engine: OcrEngine) -> DataFrame:
    """TOKENS of pages (document_id, page, height, width, data) in the engine's order; texts are trimmed."""
    names = [c.split()[0] for c in TOKENS.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.data is not None:
                    found = engine.read(to_page(r.data, r.height, r.width))
                    out += [(str(r.document_id), r.page, k, text.strip(), float(score), *box(corners)) for k, (corners, text, score) in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    return pages.select("document_id", "page", "height", "width", "data").mapInPandas(run, TOKENS)


def ask_vision(pages: DataFrame, backends: dict[str, VisionBackend], preferred: list[str], fallback: str = "local") -> DataFrame:
    """Fields of pages by the first preferred backend that is there, or by the fallback where it fails on a page.

    Columns of ``records.vision_fields`` and backend. Without the fallback a page's failure is raised.
    """
    name = next((n for n in preferred if n in backends), fallback)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.data is None:
                    continue
                used = name
                try:
                    text = backends[name].ask(to_page(r.data, r.height, r.width), PROMPT)
                    json.loads(text.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))
                except Exception:
                    if name == fallback or fallback not in backends:
                        raise
                    used, text = fallback, backends[fallback].ask(to_page(r.data, r.height, r.width), PROMPT)
                out.append((str(r.document_id), r.page, text, used))
            yield pd.DataFrame(out, columns=["document_id", "page", "response", "backend"])

    answers = pages.select("document_id", "page", "height", "width", "data").mapInPandas(run, "document_id STRING, page INT, response STRING, backend STRING")
    return vision_fields(answers).join(answers.select("document_id", "page", "backend"), ["document_id", "page"])


def pdf_pages(reader: PdfReader):
    """A function for ``files.ingest`` that reads PDFs page by page; a file's fault is its error."""
    from docsieve.sources.files import PAGES

    names = [c.split()[0] for c in PAGES.replace("MAP<STRING, STRING>", "MAP").split(", ")]

    def read(batches):
        for b in batches:
            for i, c in zip(b["document_id"], b["content"]):  # a batch a file: pages are large
                try:
                    got = reader.pages(bytes(c))
                    out = [(i, n, *p.shape, p.tobytes(), text, 0.0, {"page_count": str(len(got))}, None) for n, (p, text) in enumerate(got, 1)]
                except Exception as e:  # any fault of the file is its own result, not the job's
                    out = [(i, None, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(out, columns=names)

    return lambda files: files.mapInPandas(read, PAGES)


def misread(value: Column, field_name: Column, on: str) -> Column:
    """A test hook: the value of one field misread on purpose, a last 1 as I in InvoiceId, the first 0 as O in EmployeeId."""
    wrong = F.when(F.lit(on) == "InvoiceId", F.regexp_replace(value, "1$", "I")).when(F.lit(on) == "EmployeeId", F.regexp_replace(value, "^([^0]*)0", "$1O")).otherwise(value)
    return F.when(field_name == on, wrong).otherwise(value)
