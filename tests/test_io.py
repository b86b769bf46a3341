import io
import json
import struct
import sys
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsieve import plugins
from docsieve.operators import trust
from docsieve.plans import workload as W
from docsieve.plans.workload import draw_page
from docsieve.queries import QUERIES
from docsieve.security.crypto import decrypt
from docsieve.sinks import records as out
from docsieve.sources import files, records
from docsieve.streaming import stores

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors don't have the tests
KEY = plugins.FixedKey(b"0123456789abcdef0123456789abcdef")
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, rows=(), name="word/document.xml", extra=()):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>" if rows else ""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f"<w:document {_W}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
        for n, body in extra:
            z.writestr(n, body)
    return buf.getvalue()


def test_ingestion(spark, tmp_path):
    long = [f"Clause {i}: the parties agree on the following terms and no others." for i in range(40)]
    put = {
        "a.pdf": b"MZ\x90\0 no pdf", "b.pdf": b"plain text", "c.png": b"", "d.docx": docx(long, [("Item", "Qty"), ("Hosting", "2")]), "e.docx": docx(["x"], name="other.xml"),
        "f.docx": docx(["x"], extra=[("../evil", "y")]), "g.docx": docx(["x"], extra=[("big", "0" * 3_000_000)]), "h.docx": docx(long)[:-40], "i.pdf": b"%PDF-1.7 truncated",
        "j.png": out.png_bytes(draw_page(3, "clean")), "k.png": out.png_bytes(draw_page(3, "small")), "l.png": out.png_bytes(draw_page(3, "clean"))[:300],
    }
    for n, c in put.items():
        (tmp_path / n).write_bytes(c)
    docs, pages = files.ingest(files.read_files(spark, str(tmp_path)), image_path=str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in docs.collect()}
    assert {n for n, r in got.items() if r.status == "OK"} == {"d.docx", "j.png"} and len(got) == len(put)
    why = {n: r.reason for n, r in got.items()}
    assert "magic bytes" in why["a.pdf"] and "magic bytes" in why["b.pdf"] and "empty" in why["c.png"] and "lacks standard DOCX" in why["e.docx"] and "traversal" in why["f.docx"]
    assert "compression ratio" in why["g.docx"] and "Corrupted" in why["h.docx"] and why["i.pdf"].startswith(files.UNREADABLE) and "Resolution" in why["k.png"] and why["l.png"].startswith(files.UNREADABLE)
    assert got["d.docx"].document_id.startswith("doc_") and len(got["d.docx"].document_id) == 20
    text = [r.text_layer for r in pages.where("text_layer IS NOT NULL").collect()]
    assert len(text) == 1 and text[0].startswith("Clause 0") and text[0].endswith("--- Tables ---\nItem | Qty\nHosting | 2")
    want = files.requested(spark.createDataFrame([("x/none.pdf",)], "path STRING"), docs).first()
    assert want.status == "UNPROCESSABLE" and want.reason.endswith("none.pdf")


class FakePdf:
    def pages(self, content):
        if b"locked" in content:
            raise PermissionError("Document is encrypted")
        return [(draw_page(1, "clean"), "one"), (draw_page(2, "dark"), None)]


class FakeOcr:
    def read(self, page):
        return [([(1, 2), (11, 2), (11, 8), (1, 8)], " Total ", 0.9), ([(20, 2), (25, 2), (25, 9), (20, 9)], "7", 0.8)]


class FakeVision:
    def __init__(self, answer):
        self.answer = answer

    def ask(self, page, prompt):
        return self.answer


def test_plugins(spark):
    pdfs = spark.createDataFrame([("x", 20, b"%PDF-1.4 fine"), ("y", 21, b"%PDF-1.4 locked")], files.FILES)
    docs, _ = files.ingest(pdfs, pdf_pages=plugins.pdf_pages(FakePdf()))
    why = {r.path: r.reason for r in docs.collect()}
    assert why["x"].startswith("Page 2 quality failure: Contrast") and why["y"] == files.UNREADABLE + "Document is encrypted"
    p = draw_page(1, "clean")
    pages = spark.createDataFrame([("d", 1, *p.shape, p.tobytes()), ("e", 1, None, None, None)], "document_id STRING, page INT, height INT, width INT, data BINARY")
    assert [(r.text, r.x, r.y, r.w, r.h) for r in plugins.read_tokens(pages, FakeOcr()).orderBy("tok_seq").collect()] == [("Total", 1, 2, 10, 6), ("7", 20, 2, 5, 7)]
    backends = {"remote": FakeVision("sorry"), "local": FakeVision('```json\n{"InvoiceId": {"value": "INV-1", "confidence": 0.5, "bbox": [1, 2, 3, 4]}, "Total": 7.5, "Note": null}\n```')}
    got = {r.field_name: r for r in plugins.ask_vision(pages, backends, ["remote"]).collect()}
    assert got["InvoiceId"].conf == 0.5 and got["InvoiceId"].bbox == [1, 2, 3, 4] and got["Total"].value == "7.5" and got["Total"].conf == 0.9 and got["Note"].value is None and got["Note"].raw_text == "None" and got["Total"].backend == "local"
    with pytest.raises(ValueError):
        plugins.FixedKey(b"short")
    r = spark.createDataFrame([("INV-2024-9841", "InvoiceId"), ("EMP-0471", "EmployeeId")], "v STRING, f STRING").select(plugins.misread(F.col("v"), F.col("f"), "InvoiceId").alias("a"), plugins.misread(F.col("v"), F.col("f"), "EmployeeId").alias("b")).collect()
    assert [tuple(x) for x in r] == [("INV-2024-984I", "INV-2024-9841"), ("EMP-0471", "EMP-O471")]


def test_encrypted_pages_and_crops(spark):
    p = draw_page(5, "clean")
    pages = spark.createDataFrame([("d", 1, *p.shape, p.tobytes())], "document_id STRING, page INT, height INT, width INT, data BINARY")
    ctx, key = out.context(doc_id=F.col("document_id"), page=F.col("page")), F.lit(KEY.key())
    r = out.encrypted_pages(pages, KEY).select("name", decrypt(F.col("secret"), key, ctx).alias("png"), decrypt(F.col("secret"), key, F.lit("{}")).alias("none")).first()
    assert r.name == "d_page_1.enc" and bytes(r.png) == out.png_bytes(p) and r.none is None
    fields = spark.createDataFrame([("d", 1, "A", 50.9, 60.2, 30.0, 12.0), ("d", 1, "B", 900.0, 900.0, 5.0, 5.0), ("d", 2, "C", 1.0, 1.0, 1.0, 1.0), ("d", 1, "D", None, None, None, None)], "document_id STRING, page INT, field_name STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    got = {r.field_name: r for r in out.crops(fields, pages, KEY).collect()}
    assert got["A"].crop_ref.startswith("crop://crop_d_p1_50_60_") and got["A"].secret and got["B"].crop_ref.startswith("crop://crop_d_p1_900_900_") and got["C"].crop_ref is None and got["D"].secret is None


def test_field_crops_of_every_page(spark):
    got = QUERIES["field_crops"](spark, "/root/testdata/sf0.001").where("field_name = 'A'").select("document_id", "status").collect()
    suppliers = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select("s_suppkey").collect()}
    want = {(k, f"crop://crop_{k}_p{n}_40_40_") for k in suppliers for n in ((1, 2) if k % 5 == 0 else (1,))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and "_p2_" in str(want)


def test_crops_never_broadcast_pages(spark):
    pages = spark.createDataFrame([("d", 1, 64, 64, bytes(64 * 64))], "document_id STRING, page INT, height INT, width INT, data BINARY")
    fields = spark.createDataFrame([("d", 1, "A", 5.0, 6.0, 3.0, 1.0)], "document_id STRING, page INT, field_name STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    plans = [out.crops(fields, pages, KEY), QUERIES["field_crops"](spark, "/root/testdata/sf0.001")]
    assert all("Broadcast" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_records_score_documents_once(spark):
    plan = QUERIES["result_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 1 and plan.count("l_orderkey") and plan.count("RepartitionByExpression") == 1
    scored = trust.fuse_readings(W.readings(W.orders(spark, "/root/testdata/sf0.001")))
    same = lambda df: {tuple(r) for r in df.collect()}
    assert same(out.scored_json(scored)) == same(out.result_json(scored, trust.escalate(scored)))


def test_records(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"document_type": "invoice", "description": "d", "fields": {"InvoiceId": "INV-1", "Subtotal": 900.0}}))
    labels = records.read_labels(spark, str(tmp_path / "gt.json"))
    assert labels.first().fields == {"InvoiceId": "INV-1", "Subtotal": "900.0"}
    long = records.labels_long(labels.withColumn("document_id", F.lit("x")).unionByName(labels.withColumn("document_id", F.lit("x"))))
    assert long.count() == 2
    pairs = spark.createDataFrame([("a", "b"), ("a", "z"), ("q", "b")], "sample STRING, label STRING")
    path = lambda *x: spark.createDataFrame([(v,) for v in x], "path STRING")
    assert [tuple(r) for r in records.manifest(pairs, path("a", "a"), path("b")).select("sample", "label").collect()] == [("a", "b")]
    (tmp_path / "c.json").write_text(json.dumps([{"document_id": "d", "field_name": "TotalTax", "original_extracted_value": None, "corrected_value": None, "is_spurious_fp": True}, {"document_id": "e", "field_name": "f"}]))
    c = {r.document_id: r for r in records.read_corrections(spark, str(tmp_path / "c.json")).collect()}
    assert c["e"].reviewer_id == "reviewer_01" and c["e"].is_spurious_fp is False and c["d"].is_spurious_fp is True
    out.append_corrections(spark.createDataFrame([("d", "f")], "document_id STRING, field_name STRING"), str(tmp_path / "log"))
    out.append_corrections(spark.createDataFrame([("e", "f")], "document_id STRING, field_name STRING"), str(tmp_path / "log"))
    assert records.read_corrections(spark, str(tmp_path / "log")).count() == 2
    answers = spark.createDataFrame([("d", 1, "no json"), ("e", 1, None), ("f", 1, "[1]")], "document_id STRING, page INT, response STRING")
    assert records.vision_fields(answers).count() == 0


def test_exif(spark):
    def tiff(order):
        p = lambda f, *v: struct.pack(order + f, *v)
        make, when = b"Acme Camera\0", b"2024:03-15\0"
        first = p("H", 3) + p("HHII", 271, 2, len(make), 100) + p("HHI", 305, 2, 3) + b"ed\0\0" + p("HHII", 34665, 4, 1, 60) + p("I", 0)
        body = (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8) + first
        body = body.ljust(60, b"\0") + p("H", 1) + p("HHII", 36867, 2, len(when), 120) + p("I", 0)
        return body.ljust(100, b"\0") + make.ljust(20, b"\0") + when

    want = {"Make": "Acme Camera", "Software": "ed", "DateTimeOriginal": "2024:03-15"}
    rows = [(1, tiff("<")), (2, tiff(">")), (3, b"\xff\xd8\xff\xe1\0\x10Exif\0\0" + tiff("<")), (4, b"\xff\xd8 none"), (5, tiff("<")[:30]), (6, None), (7, b"")]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i INT, c BINARY").select("i", files.exif("c").alias("e")).collect()}
    assert got[1] == got[2] == got[3] == want and got[4] == got[6] == got[7] == {} and "Make" in got[5]


def test_service_answers(spark, tmp_path):
    from docsieve import api

    one = lambda *v: spark.createDataFrame([v], "document_id STRING, field_name STRING, original_extracted_value STRING, corrected_value STRING, is_spurious_fp BOOLEAN")
    path = str(tmp_path / "log")
    api.submit(one("d", "VendorName", "ACME", "Acme Ltd", False), path)
    got = api.submit(one("payslip-1", "TotalTax", None, None, True), path).first()
    assert (got.total_corrections, got.learned_aliases, got.learned_suppressions) == (2, 1, 1)
    assert api.corrections(records.read_corrections(spark, path)).where("original_value = 'ACME'").first().reviewer_id == "reviewer_01"
    known = spark.createDataFrame([("d", "{}"), ("e", "{}")], "document_id STRING, json STRING")
    assert api.document(known, "d").count() == 1 and api.document(known, "zz").count() == 0


def test_redaction(spark):
    details = {"status": "OK", "name": "Ada", "extracted_text": "secret", "ssn": 7, "nested": {"phone": "1", "n": 2}, "list": [{"dob": "x", "k": 1}, 3]}
    got = json.loads(spark.createDataFrame([(json.dumps(details),), (None,), ("free text",)], "d STRING").select(out.redacted_json("d").alias("d")).first().d)
    assert got["status"] == "OK" and got["name"].startswith("[REDACTED:sha256=") and got["ssn"] == "[REDACTED]" and got["nested"]["phone"].startswith("[RED") and got["nested"]["n"] == 2 and got["list"][0]["k"] == 1 and got["list"][0]["dob"].startswith("[RED") and got["list"][1] == 3


def test_streams(spark, tmp_path):
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    write = lambda rows: spark.createDataFrame(rows, stores.REGISTRY).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stores.register(spark.readStream.schema(stores.REGISTRY).parquet(str(src)), store, f"{tmp_path}/cp").awaitTermination()
        return sorted((r.document_id, r.matched_document_id, r.match_type, r.distance) for r in spark.read.parquet(f"{store}/matches").collect())

    write([("a", 1, "s1", [1, 0x0F0F0F0F0F0F0F0F]), ("b", 2, "s2", [3])])
    assert run() == [("b", "a", "NEAR_DUPLICATE", 1)]
    write([("c", 3, "s1", [1]), ("d", 4, "s9", [0xFF << 20, -1]), ("a", 5, "s1", [1])])
    want = [("a", "b", "NEAR_DUPLICATE", 1), ("a", "c", "EXACT", 0), ("b", "a", "NEAR_DUPLICATE", 1), ("c", "a", "EXACT", 0)]
    assert run() == want and run() == want
    stores.reset(spark, store)
    log = tmp_path / "log"
    spark.createDataFrame([(1, "d", "V", "STARBUCKS #1 ", "Starbucks", False), (2, "payslip-1", "TotalTax", None, None, True), (3, "d", "V", "same", "same", False), (4, "d", "V", "", "x", False)], stores.CORRECTIONS).write.parquet(str(log))
    stores.learn(spark.readStream.schema(stores.CORRECTIONS).parquet(str(log)), f"file://{tmp_path}/learnt", f"{tmp_path}/cp2").awaitTermination()
    assert [(r.original, r.corrected) for r in spark.read.parquet(f"{tmp_path}/learnt/aliases").collect()] == [("starbucks #1", "Starbucks")]
    assert [(r.document_type, r.field_name) for r in spark.read.parquet(f"{tmp_path}/learnt/suppressions").collect()] == [("payslip", "TotalTax")]
    events = "timestamp STRING, actor_id STRING, document_id STRING, action STRING, details STRING"
    spark.createDataFrame([("t", "a", "d", "X", '{"name": "Ada"}')], events).write.parquet(f"{tmp_path}/ev")
    stores.audit(spark.readStream.schema(events).parquet(f"{tmp_path}/ev"), f"{tmp_path}/audit", f"{tmp_path}/cp3").awaitTermination()
    assert "Ada" not in spark.read.parquet(f"{tmp_path}/audit").first().details
    assert np.array_equal(draw_page(7, "clean"), draw_page(7, "clean"))
