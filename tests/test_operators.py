import random

import numpy as np
from pyspark.sql import functions as F

from docsieve import dims
from docsieve.operators import forensics, layout, trust
from docsieve.pixels import page
from docsieve.queries import QUERIES


def test_paths_keep_single_sources_and_nulls(spark):
    a = spark.createDataFrame([("d", "Total", "5", 0.9, 1), (None, "Total", "1", 0.5, 1)], "document_id STRING, field_name STRING, value STRING, conf DOUBLE, agreement INT")
    b = spark.createDataFrame([("d", "Total", "9", 0.95), ("d", "Tax", None, 0.9)], "document_id STRING, field_name STRING, value STRING, conf DOUBLE")
    rows = {(r.document_id, r.field_name): r for r in trust.reconcile_paths(a, b).collect()}
    assert rows["d", "Total"].value == "9" and rows["d", "Total"].agreement == "ocr!=vision"
    assert rows["d", "Tax"].value is None and rows[None, "Total"].value == "1"


def test_outcomes_and_empty_metrics(spark):
    e = spark.createDataFrame([("d", "A", "1", 0.9), ("d", "B", "x", 0.9), ("d", "C", None, 0.9)], "document_id STRING, field_name STRING, value STRING, conf DOUBLE")
    t = spark.createDataFrame([("d", "A", "1."), ("d", "C", "z"), ("d", "B", "yyy"), ("d", "D", None)], "document_id STRING, field_name STRING, value STRING")
    m = trust.metrics(trust.outcomes(e, t), []).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (1, 1, 1, 0.5, 0.5)
    assert trust.calibration(trust.outcomes(e.limit(0), t)).count() == 3


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    h = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for i in range(60):
        x = h[i] & (2**64 - 1)
        for b in rng.choice(64, i % 12, replace=False):
            x ^= 1 << int(b)
        h.append(x - 2**64 if x >= 2**63 else x)
    df = spark.createDataFrame(list(enumerate(h)) + [(999, None)], "id BIGINT, h BIGINT")
    got = {(r.id_1, r.id_2, r.distance) for r in forensics.near_pairs(df).collect()}
    first = {}
    for i, x in enumerate(h):
        first.setdefault(x, i)
    reps = sorted(first.values())
    want = {(i, j, d) for i in reps for j in reps if i < j and (d := bin((h[i] ^ h[j]) & (2**64 - 1)).count("1")) <= 8}
    assert got == want and len(want) > 30


def test_near_members_give_every_pair(spark):
    rng = np.random.default_rng(2)
    h = [int(x) for x in rng.integers(-(2**62), 2**62, 20)]
    h += h[:8] + h[:4] + [x ^ 5 for x in h[2:12]] + [x ^ 5 for x in h[2:5]]
    df = spark.createDataFrame(list(enumerate(h)) + [(999, None)], "id BIGINT, h BIGINT")
    rows = {r.id: r for r in forensics.near_members(df).collect()}
    near = {frozenset((r.id_1, r.id_2)) for r in forensics.near_pairs(df).collect()}
    d = lambda i, j: bin((h[i] ^ h[j]) & (2**64 - 1)).count("1")
    n = range(len(h))
    want = {(i, j) for i in n for j in n if i < j and d(i, j) <= 8}
    got = {(i, j) for i in n for j in n if i < j and (rows[i].class_id == rows[j].class_id or frozenset((rows[i].class_id, rows[j].class_id)) in near)}
    assert set(rows) == set(n) and got == want and any(d(i, j) == 0 for i, j in want)
    for i in n:
        assert rows[i].n_same == sum(d(i, j) == 0 for j in n) - 1 and rows[i].n_near == sum(0 < d(i, j) <= 8 for j in n)


def test_exact_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "")], "id BIGINT, t STRING")
    assert sorted(map(tuple, forensics.exact_classes(df, "id", "t").collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (5, 3, 1)]


TOKENS = "document_id BIGINT, page INT, tok_seq INT, text STRING, conf DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


def tokens(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, 0.9, float(x), float(y), w, h) for i, (t, x, y, w, h) in enumerate(rows)], TOKENS)


def test_lines_and_rows(spark):
    tok = tokens(spark, [("b", 5, 0, 4.0, 10.0), ("a", 1, 10, 3.0, 12.0), ("c", 1, 60, 2.0, 9.0)])
    lines = layout.spatial_lines(tok, ["document_id", "page"]).orderBy("line_no").collect()
    assert [(r.text, r.x, r.y, r.w, r.h) for r in lines] == [("a b", 1, 0, 8, 22), ("c", 1, 60, 2, 9)]
    assert [r.row_no for r in layout.row_clusters(tok, ["document_id"]).orderBy("tok_seq").collect()] == [0, 0, 1]
    assert layout.row_clusters(tok.limit(0), ["document_id"]).count() == 0


def test_tables(spark):
    rows = [("Description", 10, 50, 80.0, 10.0), ("Qty", 200, 55, 20.0, 10.0), ("Line Total", 300, 48, 60.0, 10.0), ("Hosting", 12, 80, 50.0, 10.0), ("2", 205, 82, 8.0, 10.0), ("$1,350.00", 298, 79, 60.0, 10.0), ("Backup", 9, 115, 50.0, 10.0), ("$x", 310, 116, 9.0, 10.0), ("Subtotal: $9", 300, 150, 60.0, 10.0), ("after", 10, 190, 9.0, 9.0)]
    got = {(r.row_no, r.col_no): (r.value, r.value_num) for r in layout.tables(tokens(spark, rows)).collect()}
    assert got == {(0, 0): ("Hosting", None), (0, 1): ("2", 2.0), (0, 2): ("$1,350.00", 1350.0), (1, 0): ("Backup", None), (1, 1): ("", None), (1, 2): ("$x", None)}
    assert layout.tables(tokens(spark, rows[3:])).count() == 0 == layout.tables(tokens(spark, rows).limit(0)).count()


def test_fonts(spark):
    t = tokens(spark, [(f"word{i}", 10 + 70 * i, 100, 48.0, 18.0) for i in range(6)] + [("$9,999.00", 250, 270, 225.0, 38.0)])
    f = lambda *v: spark.createDataFrame([(1, 1, *v)], "document_id BIGINT, page INT, field_name STRING, value STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    odd = layout.font_anomalies(t, f("InvoiceTotal", "$9,999.00", 250.0, 270.0, 225.0, 38.0)).first()
    assert odd.reasons[0].startswith("Abnormal font height (38.0px vs median 18.0px)") and "pitch" in odd.reasons[1]
    assert layout.font_anomalies(t, f("Subtotal", "900.00", 250.0, 104.0, 48.0, 18.0)).count() == 0
    assert layout.font_anomalies(t, f("Subtotal", "9", 250.0, 104.0, 400.0, 180.0)).count() == 0


def test_first_match_and_tax(spark):
    c = spark.createDataFrame([("d", 1, 0, "Federal Tax: 5.00"), ("d", 1, 1, "Tax (8%): $7.20"), ("d", 1, 2, None), ("d", 1, 3, "Gross Pay: 4.580.49"), ("d", 2, 0, "invoice no: X-1"), ("d", 1, 4, "Medicare Tax 1.00")], "document_id STRING, page INT, cand_seq INT, text STRING")
    got = {(r.page, r.field_name): (r.value, r.value_num) for r in layout.first_matches(c, dims.PATTERNS_A).collect()}
    assert got == {(1, "TotalTax"): ("7.20", 7.2), (1, "GrossPay"): ("4580.49", 4580.49), (2, "InvoiceId"): ("X-1", None)}
    assert len(dims.PATTERNS_A) == len(dims.PATTERNS_B) == 20 and sum(len(p) for _, p in dims.PATTERNS_B) == 35


def test_pages_and_reasons(spark):
    rows = [("d", 1, "InvoiceId", "a", "INV-2024-1", 0.9), ("d", 1, "InvoiceId", "b", "INV-2024-I", 0.99), ("d", 2, "InvoiceId", "a", "INV-2024-2", 0.7), ("d", 1, "VendorName", "a", "O'Hara", 0.8), ("d", 1, "VendorName", "b", "Zed Ltd", 0.7)]
    df = spark.createDataFrame(rows, "document_id STRING, page INT, field_name STRING, source STRING, value STRING, conf DOUBLE")
    scored = {r.field_name: r for r in trust.fuse_readings(df).collect()}
    assert scored["InvoiceId"].value == "INV-2024-2" and scored["InvoiceId"].page == 2 and scored["InvoiceId"].agreement == "single_source" and scored["InvoiceId"].native == 0.7
    why = trust.escalate(trust.fuse_readings(df)).first()
    assert why.status == "NEEDS_REVIEW" and why.reasons[-1] == "Field 'VendorName': ocr!=vision disagreement (Path A=\"O'Hara\" selected; paths diverged)" and why.reasons[0].startswith("Field 'InvoiceId': final confidence 0.") and why.reasons[0].endswith("< threshold 0.90")
    assert trust.escalate(trust.fuse_readings(df.limit(0))).count() == 0


def test_duplicates_of_registered_files(spark):
    schema = "document_id STRING, seq BIGINT, sha STRING, phashes ARRAY<BIGINT>"
    a, b = 0x0F0F0F0F, 0x3333333300000000
    rows = [("a", 1, "s1", [a]), ("b", 2, "s2", [a ^ 1, b]), ("c", 3, "s2", [a]), ("a", 4, "s1", [a]), ("e", 5, None, None), ("f", 6, "s9", [b ^ 3])]
    df = spark.createDataFrame(rows, schema)
    flags = {r.document_id: r.flags for r in forensics.duplicate_flags(df).collect()}
    assert flags == {"b": ["DUPLICATE_NEAR_MATCH"], "c": ["DUPLICATE_EXACT_MATCH"], "a": ["DUPLICATE_NEAR_MATCH"], "f": ["DUPLICATE_NEAR_MATCH"]}
    new, old = df.where("seq = 3"), df.where("seq IN (1, 2)")
    got = sorted((r.matched_document_id, r.match_type, r.page_number, r.matched_page, r.distance) for r in forensics.duplicate_matches(new, old).collect())
    assert got == [("a", "NEAR_DUPLICATE", 1, 1, 0), ("b", "EXACT", 1, 1, 0)]


def test_bands_of_hashes_are_never_broadcast(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id INT, h BIGINT")
    plan = forensics._near(df, df.select(F.col("h").alias("h2")), 8, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_integrity_order_and_attach(spark):
    docs = spark.createDataFrame([("d",), ("e",)], "document_id STRING")
    one = lambda *f: spark.createDataFrame([("d", list(f))], "document_id STRING, flags ARRAY<STRING>")
    rep = forensics.integrity(docs, [one("AI_GENERATION_SUSPECTED"), one("FONT_INCONSISTENCY", "ELA_ANOMALY_DETECTED"), one("NEW_FLAG")])
    got = {r.document_id: r for r in rep.collect()}
    assert got["d"].flags == ["ELA_ANOMALY_DETECTED", "FONT_INCONSISTENCY", "AI_GENERATION_SUSPECTED", "NEW_FLAG"] and got["d"].score == 0.0 and got["e"].score == 1.0 and got["e"].status == "OK"
    res = spark.createDataFrame([("d", "OK", ["VALIDATION:X"]), ("z", "OK", ["VALIDATION:Y"])], "document_id STRING, status STRING, authenticity_flags ARRAY<STRING>")
    out = {r.document_id: r for r in forensics.attach(res, rep).collect()}
    assert out["d"].status == "NEEDS_REVIEW" and "VALIDATION:X" not in out["d"].authenticity_flags and "VALIDATION:X" in out["d"].all_flags and out["z"].authenticity_flags == ["VALIDATION:Y"]


def test_metadata_rules(spark):
    rows = [(1, "pdf", "ERP", "PyMuPDF", "D:20240315103000Z", "D:20240315103005+00'00'", None), (2, "pdf", "x", "Adobe Photoshop", "20240315", "D:20240320", None), (3, "pdf", "Report tool", "Acrobat", None, None, None), (4, "pdf", None, None, None, None, "broken"), (5, "png", None, "Photoshop", None, None, "broken"), (6, "pdf", None, None, "D:20241399", "D:2024", None)]
    df = spark.createDataFrame(rows, "document_id INT, format STRING, creator STRING, producer STRING, creation_date STRING, mod_date STRING, parse_error STRING")
    got = {r.document_id: r for r in forensics.metadata_flags(df).collect()}
    assert [i for i in got if got[i].flags] == [2, 3, 4] and got[1].seconds == 5 and got[2].seconds == 5 * 86400 and got[2].tool == "photoshop" and got[6].seconds is None


def test_near_texts_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    for w in list(words):
        x = list(w)
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(x) + 1)
            x[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        words.append("".join(x) or "a")
    words = sorted(set(words))
    rows = [(1, "vendor_name", "FREE_TEXT", "t:" + w, None, None, w) for w in words]
    df = spark.createDataFrame(rows, "bundle_id INT, entity_key STRING, kind STRING, cls STRING, num DOUBLE, day DATE, txt STRING")
    got = {(r.cls_1[2:], r.cls_2[2:]) for r in trust.near_classes(df).collect()}
    pairs = spark.createDataFrame([(x, y) for x in words for y in words if x != y], "x STRING, y STRING")
    n, lev = F.greatest(F.length("x"), F.length("y")), F.levenshtein("x", "y")
    want = {tuple(r) for r in pairs.where(((lev <= 2) & (n >= 5)) | ((n - lev) / n >= 0.85)).collect()}
    assert got == want and len(want) > 60


def test_near_texts_of_groups_of_any_size(spark):
    rng = random.Random(5)
    rows = []
    for group, size in ((1, 20), (2, 110)):
        base = [str(rng.randint(10, 999999)) for _ in range(size)]
        words = sorted(set(base) | {b[:k] + rng.choice("x01") + b[k + rng.randint(0, 1):] + rng.choice(["", "", "eur"]) for b in base for k in [rng.randrange(len(b))]})
        rows += [(group, "tax_amount", "NUMERIC", "c:" + w, 1e9 * len(w) + 10 * i if w.isdigit() else None, None, w) for i, w in enumerate(words)]  # numbers are far apart
    df = spark.createDataFrame(rows, "bundle_id INT, entity_key STRING, kind STRING, cls STRING, num DOUBLE, day DATE, txt STRING")
    got = {tuple(r) for r in trust.near_classes(df).select("bundle_id", "cls_1", "cls_2").collect()}
    pairs = spark.createDataFrame([(a[0], a[6], b[6]) for a in rows for b in rows if a[0] == b[0] and a[6] != b[6] and not (a[6].isdigit() and b[6].isdigit())], "g INT, x STRING, y STRING")
    n, lev = F.greatest(F.length("x"), F.length("y")), F.levenshtein("x", "y")
    want = {(r.g, "c:" + r.x, "c:" + r.y) for r in pairs.where(((lev <= 2) & (n >= 5)) | ((n - lev) / n >= 0.85)).collect()}
    assert got == want and len({w[0] for w in want}) == 2
    # most pieces of a text need not be looked for at every shift
    assert len(trust.text_probes("unrelated trading comp")) < 60


def test_pixels():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 255, (128, 128)).astype(np.uint8)
    near = img.copy()
    near[:4] = 255
    assert bin((page.phash(img) ^ page.phash(near)) & (2**64 - 1)).count("1") <= 16
    assert page.ela_blocks(np.zeros((8, 8))) == [] and len(page.ela_blocks(img)) == 15 * 15
    assert page.ela_anomalies(np.full((64, 64), 128, np.uint8)) == []
    lines = np.full((200, 200), 255, np.uint8)
    lines[40:160:20, 20:180] = 0
    turned = page.rotate(lines, 6)
    assert abs(abs(page.skew_angle(turned)) - 6) <= 1
    assert page.merge_regions([(0, 0, 10, 10, 1.0), (200, 0, 10, 10, 3.0), (20, 0, 10, 10, 2.0)]) == [(0, 0, 30, 10, 2.0), (200, 0, 10, 10, 3.0)]
    assert page.perturb(img, 1, 2).shape == img.shape and (page.perturb(img, 1, 2) == page.perturb(img, 1, 2)).all()
    assert page.crop_box(1, 1, 5, 5, 100, 100) == (0, 0, 10, 10) and page.crop_box(500, 1, 5, 5, 100, 100) == (0, 0, 10, 10)


def test_pages_stay_in_the_function_that_draws_them(spark):
    for name in ("page_hashes", "page_deskew"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1
