import pytest
from pyspark.sql import functions as F

from docsieve.functions import scalar as S

AGREE = [
    ("Contoso LogisticsInc.", "Contoso Logistics Inc.", "VendorName", "ocr==vision"), ("AcmeEnterpriseCorp", "Acme Enterprise Corp", "CustomerName", "ocr==vision"),
    ("$900.00", "900", "Subtotal", "ocr==vision"), ("2024-03-15", "03/15/2024", "InvoiceDate", "ocr==vision"), ("INV-2024-9841", "INV-2024-984I", "InvoiceId", "ocr!=vision"),
    ("ACCT-12345", "ACCT-1234S", "AccountNumber", "ocr!=vision"), ("Acme Corp International", "Acme Corp Internatinal", "CustomerName", "ocr_near_match"),
    ("$7,787.50", "7787.5", "GrossPay", "ocr==vision"), ("Sarah Chen", "Sara Chen", "EmployeeName", "ocr_near_match"), ("10.00", "10.80", "Subtotal", "ocr_near_match"),
    ("...", "???", "VendorName", "ocr!=vision"), (None, "x", "VendorName", "single_source"), ("", "", "VendorName", "ocr==vision"),
]


def test_agreement(spark):
    df = spark.createDataFrame(AGREE, "a STRING, b STRING, f STRING, want STRING")
    rows = df.withColumn("got", S.agreement(F.col("a"), F.col("b"), S.field_type(F.col("f")))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_fusion(spark):
    rows = [(1.0, "ocr==vision", 1.0, True, None), (0.9, "single_source", None, True, None), (0.95, "ocr_near_match", 1.0, True, None), (1.0, "ocr==vision", 1.0, False, 0.5)]
    df = spark.createDataFrame(rows, "n DOUBLE, a STRING, c DOUBLE, p BOOLEAN, cap DOUBLE")
    got = [r.x for r in df.select(S.fused(*map(F.col, ("n", "a", "c", "p", "cap"))).alias("x")).collect()]
    want = [1.0, (0.35 * 0.9 + 0.25 * 0.8 + 0.15) / 0.75, 0.35 * 0.95 + 0.25 * 0.85 + 0.4, 0.5]
    assert got == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("name,key", [("VendorAddress", "vendor_name"), ("CustomerId", "customer_name"), ("Id", "invoice_id"), ("---", "invoice_id"), ("PurchaseOrderNumber", "po_number"), ("SupplierName", "vendor_name"), ("GrossPay", "gross_pay")])
def test_entity_key(spark, name, key):
    assert spark.range(1).select(S.entity_key(F.lit(name))).first()[0] == key


def test_redaction_and_formats(spark):
    r = spark.range(1).select(S.redacted(F.lit("ssn"), F.lit("1")), S.redacted(F.lit("status"), F.lit("1")), S.file_format(F.lit(b"MZ\x90")), S.file_format(F.lit(b"%PDF-1.7"))).first()
    assert r[0].startswith("[REDACTED:sha256=") and (r[1], r[2], r[3]) == ("1", "UNKNOWN", "pdf")


def test_values_match(spark):
    from docsieve.queries import MATCH_CASES

    df = spark.createDataFrame(MATCH_CASES, "e STRING, g STRING, f STRING, w BOOLEAN")
    assert [r.x for r in df.withColumn("x", S.values_match(F.col("e"), F.col("g"), F.col("f"))).collect()] == [c[3] for c in MATCH_CASES]
