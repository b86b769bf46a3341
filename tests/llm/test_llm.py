import datetime as dt
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import history_dedup as H
from docsieve.llm import language, leakage, name_variants, packing, rank_fusion, record_linkage, survivorship

REG = "reg_id BIGINT, document_id STRING, batch_no INT, sha256_hash STRING, page_phashes ARRAY<STRING>, extra STRING"


def brute(uploads, sheets=()):
    """Sequential definition: pairs (accepted, later)."""
    seen, kept, pairs = set(), [], []
    for reg, doc, _, sha, pages, _ in sorted(uploads, key=lambda u: u[0]):
        if doc in seen:
            continue
        seen.add(doc)
        hs = [int(p, 16) for p in pages or [] if p]
        hit = []
        for r2, s2, h2 in kept:
            n = 0
            left = list(h2)
            for a in hs:
                m = next((b for b in left if bin(a ^ b).count("1") <= 8), None)
                if m is not None:
                    left.remove(m)
                    n += 1
            if (sha and sha == s2) or n * 2 > max(len(hs), len(h2)):
                hit.append(r2)
        pairs += [(r, reg) for r in hit]
        if not hit:
            kept.append((reg, sha, hs))
    return sorted(pairs)


@pytest.mark.parametrize("file_rows,first_slice", [(250_000, 2_000), (300, 7)])
def test_history_equals_brute_force(spark, monkeypatch, file_rows, first_slice):
    monkeypatch.setattr(H.HashForest.__init__, "__defaults__", (None, file_rows, first_slice))
    rng = random.Random(3)
    rows, base = [], []
    for i in range(1, 181):
        if base and rng.random() < 0.4:
            sha, pages = rng.choice(base)
            if rng.random() < 0.5:
                pages = [f"{int(p, 16) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 11))):016x}" for p in pages]
                sha = f"{rng.getrandbits(256):064x}"
        else:
            sha, pages = f"{rng.getrandbits(256):064x}", [f"{rng.getrandbits(64):016x}" for _ in range(rng.randint(1, 4))]
        base.append((sha, pages))
        rows.append((i, f"d{i}" if i % 50 else "d1", min(i // 40, 4), sha, pages, "x"))
    rows += [(181, "n1", 4, None, None, None), (182, None, 4, None, [], None), (183, "n3", 4, None, [], "y")]
    got = H.find_repeats(spark.createDataFrame(rows, REG)).collect()
    assert sorted((r.reg_id_1, r.reg_id_2) for r in got) == brute(rows)


def test_history_is_opened_again_and_never_overwritten(spark, tmp_path):
    sha, page = "ab" * 32, "00112233445566aa"
    frame = lambda *rows: H.normalised_uploads(spark.createDataFrame(list(rows), REG))
    first = H.HashForest(spark, f"file://{tmp_path}/forest")
    assert first.check(frame((1, "a", 0, sha, [page], ""))).count() == 0
    second = H.HashForest(spark, f"file://{tmp_path}/forest")
    assert second.state == first.state
    got = second.check(frame((2, "b", 1, None, ["00112233445566ab"], ""), (3, "c", 1, sha, None, ""), (4, "a", 1, sha, [page], "")))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3)]
    assert first._run(first.state["runs"]).count() > 0 and second.check(frame()).count() == 0


def test_history_settles_many_links_in_rounds(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (5, 6), (6, 7), (7, 8)], "r1 BIGINT, r2 BIGINT")
    forest = H.HashForest(spark)
    want = sorted(r.r for r in forest._repeats(links).collect())
    monkeypatch.setattr(H, "LINKS_ONE_TASK", 0)
    assert sorted(r.r for r in forest._repeats(links).collect()) == want == [2, 4, 6, 8]


def test_history_parses_and_leaves_common_sheets_out(spark):
    a, b, sheet = "00112233445566aa", "f0112233445566bb", "123456789abcdef0"
    rows = [(1, "a", 0, "AB" * 32, [a, sheet], ""), (2, "b", 1, "sha256:" + "ab" * 32, ["0x" + b], ""), (3, "c", 1, None, [a.upper() + " ", "n/a", sheet], "")]
    rows += [(10 + i, f"s{i}", 0, None, [sheet, f"{(i * 0x9E3779B97F4A7C15) % 2**64:016x}"], "") for i in range(30)]
    got = sorted(map(tuple, H.find_repeats(spark.createDataFrame(rows, REG)).collect()))
    assert got == [(1, 2), (1, 3)]


def test_history_keeps_the_pages_of_a_hot_file(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.getrandbits(64)
    noisy = lambda h: h ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 1, 2])))
    file, sheet, rows = [word() for _ in range(4)], word(), []
    for i in range(60):
        pages = [noisy(h) for h in file]
        if i % 5 == 0:
            del pages[rng.randrange(4)]
        if i % 7 == 0:
            pages.insert(0, word())  # another cover sheet
        rows.append(pages)
    rows += [[sheet, word()] for _ in range(15)] + [[noisy(sheet), word(), word()] for _ in range(15)]
    rows += [[word(), word()] for _ in range(30)]
    rng.shuffle(rows)
    rows = [(i, f"d{i}", min(i // 75, 2), None, [f"{h:016x}" for h in pages], "") for i, pages in enumerate(rows, 1)]
    df = spark.createDataFrame(rows, REG)
    forest = H.HashForest(spark, f"file://{tmp_path}/forest")
    got = sorted((r.reg_id_1, r.reg_id_2) for r in H.find_repeats(df, forest.path).collect())
    assert [c & (2**64 - 1) for c in H.HashForest(spark, forest.path).state["sheets"]] == [sheet]
    bare = [(*r[:4], [p for p in r[4] if bin(int(p, 16) ^ sheet).count("1") > 8], "") for r in rows]
    assert got == brute(bare) and len(got) > 50


def test_p1_found_takes_every_batch_by_itself(spark, monkeypatch, tmp_path):
    from docsieve.llm import queries

    rows = [(i, f"d{i}", i // 2, f"{i:064x}", [], "") for i in range(8)]
    spark.createDataFrame(rows, REG).write.parquet(f"{tmp_path}/dedup_registry.parquet")
    checked = []
    monkeypatch.setattr(H.HashForest, "check", lambda self, uploads: checked.append(sorted(r.batch_no for r in uploads.select("batch_no").distinct().collect())))
    queries.p1_found(spark, str(tmp_path))
    assert checked == [[0], [1], [2], [3]]


def test_history_empty(spark):
    assert H.find_repeats(spark.createDataFrame([], REG)).count() == 0


def test_layouts_lose_no_pair():
    rng = random.Random(1)
    for k in (1, 2, 3):
        lay = H.Layout(k)
        assert sum(lay.blocks) == 2**64 - 1
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 8))
            assert any(not diff & m for m in lay.masks)


def test_cover_layouts_lose_no_pair_and_cost_less():
    rng = random.Random(2)
    for k, radii in H.COVERS.items():
        lay = H.Layout(k)
        assert sum(r + 1 for r in radii) == H.RADIUS + 1 and sum(lay.blocks) == 2**64 - 1 and lay.recall(8) == 1.0 > lay.recall(9)
        assert all(x < 2**64 for x in lay.blocks) and len(set(lay.masks)) == len(lay.masks) == sum(2 ** (r + 1) - 1 for r in radii)
        for block, r in zip(lay.blocks, radii):  # the share of flipped bits of one block, in every way for up to 3
            inside = [m for m in lay.masks if m & block and not m & ~block & (2**64 - 1)]
            bits = [1 << i for i in range(64) if block >> i & 1]
            for c in combinations(bits, r) if r <= 3 else (rng.sample(bits, r) for _ in range(3000)):
                assert any(not sum(c) & m for m in inside)
    for rows in (10**6, 10**7, 10**8):
        assert H.choose_layout(rows).cost(rows) * 1.5 < min(H.Layout(k).cost(rows) for k in (1, 2, 3))


def test_survivorship(spark):
    t = dt.datetime(2025, 1, 1)
    members = spark.createDataFrame([("a", "g", t), ("b", "g", t.replace(day=2)), ("b", "g", t.replace(day=2)), ("c", "g", None), ("z", None, t)], "document_id STRING, group_id STRING, processed_at TIMESTAMP")
    claims = [
        ("a", 1, "name", "Acme Ltd", 0.5), ("b", 1, "name", "Acme…", 0.99), ("c", 1, "name", "n/a", 1.0),
        ("a", 2, "total", "5", 91.0), ("b", 2, "total", "6", 0.91), ("c", 2, "total", "7", -1.0),
        ("a", 5, "place", "50 Harbour Ro-", 0.9), ("b", 5, "place", "50 Harbour", 0.8), ("c", 5, "place", "50 harbour Row, X", 0.1),
        ("a", 3, "lone", "x", 1.0), ("a", 4, "none", None, None), ("b", 4, "none", "", float("nan")), ("z", 1, "name", "Q", 1.0),
    ]
    df = spark.createDataFrame(claims + claims[:1], "document_id STRING, claim_seq INT, entity_key STRING, value STRING, confidence DOUBLE").withColumn("group_id", F.lit("clash"))
    got = {r.entity_key: (r.document_id, r.claim_seq) for r in survivorship.surviving_values(df, members).collect()}
    assert got == {"name": ("a", 1), "total": ("b", 2), "none": ("b", 4), "place": ("c", 5)}
    assert survivorship.surviving_values(df.limit(0), members).count() == 0


def test_ranking(spark):
    rows = [("q", i, "e1" if i % 2 else "e2", float(i if i % 2 else i * 100), None if i == 4 else i / 10) for i in range(1, 9)]
    items = spark.createDataFrame(rows, "q STRING, i BIGINT, e STRING, s DOUBLE, t DOUBLE")
    got = [r.i for r in rank_fusion.least_trusted(rank_fusion.standard_score(items, ["q", "i"], ["s", "t"], {"s": "e"}), "q", "i", 2).collect()]
    assert sorted(got) == [1, 2]
    rng = random.Random(7)
    many = [(f"q{rng.randint(0, 3)}", i, rng.choice(["e1", "e2", None]), rng.choice([None, rng.gauss(50, 20)]), rng.choice([None, rng.random() ** 9])) for i in range(200)] + [("q9", 999, None, None, None)]
    many = spark.createDataFrame(many, "q STRING, i BIGINT, e STRING, s DOUBLE, t DOUBLE")
    plain = rank_fusion.least_trusted(rank_fusion.standard_score(many, ["q", "i"], ["s", "t"], {"s": "e"}), "q", "i", 3)
    found = rank_fusion.least_by_distance(many, "q", "i", ["s", "t"], {"s": "e"}, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    at = rank_fusion.positions(rank_fusion.median_rank(many, "q", "i", ["s", "t"]), "q", "i").toPandas()
    for _, g in at.groupby("q"):
        g = g.sort_values("position")
        assert list(g.position) == list(range(1, len(g) + 1)) and g.dropna().median_rank.round(9).is_monotonic_increasing
    assert rank_fusion.least_by_distance(many.limit(0), "q", "i", ["s", "t"], {"s": "e"}, 3).count() == 0
    ranks = {r.i: r.rank for r in rank_fusion.distributed_rank(items, "q", "i", "t").collect()}
    want = items.toPandas().dropna().set_index("i").t.rank()
    assert ranks == want.to_dict()
    med = {r.i: r.median_rank for r in rank_fusion.median_rank(items, "q", "i", ["s", "t"]).collect()}
    assert len(med) == 8 and min(med, key=med.get) == 1
    assert rank_fusion.standard_score(items.limit(0), ["q", "i"], ["s", "t"], {"s": "e"}).count() == 0


NAMES = [(1, "organisation", f"{x} Construction AG") for x in ("Farcarick",)] + [(2, "person", "Robert Brulanevik"), (3, "organisation", "Zanlizeworth Textiles Ltd")]
NAMES += [(4, "organisation", "Ace Construction Ltd")]
NAMES += [(100 + i, "organisation", f"Quork{chr(97 + i)}zup {t} {'AG' if i % 4 < 2 else 'Ltd'}") for i, t in enumerate(["Construction", "Textiles"] * 10)]


@pytest.mark.parametrize("kind,value,want", [
    ("organisation", "Farcarick Construction AG", 1), ("organisation", "Aktienges., Farrcarick Construction", 1), ("organisation", "M/s FARCARICK CONSTR. (HQ)", 1),
    ("organisation", "Far carick Construction", 1), ("organisation", "FarcarickConstructionAG", 1), ("organisation", "Farcarick Construction GmbH", None),
    ("organisation", "Farcarick Textiles AG", None), ("organisation", "The Zanlizeworth Txtls Limited", 3), ("organisation", "Sellomak Construction AG", None),
    ("person", "Brulanevik, Bobby", 2), ("person", "Mr. R. Brulanevik", 2), ("person", "Thomas Brulanevik", None), ("person", "ROBERT BRULANEVIK", 2), ("person", "", None), ("person", "x" * 500, None), ("person", "word " * 5000, None),
    ("organisation", "Ace Construction Ltd", 4), ("organisation", "ACE CONSTR. LIMITED", 4), ("organisation", "Ale Construction Ltd", None),
    ("organisation", "Farcarick" + " word" * 20000, None), ("person", "Rob Brulanevik", 2),
])
def test_name_variants(kind, value, want):
    stands = lambda *x: frozenset(x)
    lexicon = name_variants.Lexicon({"construction": stands("construction"), "textiles": stands("textiles"), "ag": stands("ag"), "ltd": stands("ltd"), "limited": stands("ltd"), "gmbh": stands("gmbh"), "aktienges": stands("ag"), "hq": stands(), "the": stands(), "ms": stands()}, {"mr": stands(), "bobby": stands("robert")})
    m = name_variants.Register(NAMES, lexicon).match(kind, value)
    assert (m and m[0]) == want


def test_lexicon_is_learnt_from_the_spellings(spark):
    tells = [f"Quork{chr(97 + i)}zup" for i in range(20)]
    values = [("organisation", f"{t} {('Constr.', 'Textiles')[k % 2]}") for k, t in enumerate(tells)]
    values += [("organisation", f"The {t} ({x})") for t in tells for x in ("HQ",)] + [("person", f"Bobby {x}") for x in ("Brulanevik", "Kelmaronak")] + [("person", None), (None, "x")]
    register = spark.createDataFrame(NAMES + [(900, "person", "Robert Kelmaronak")], "entity_id BIGINT, kind STRING, registered_name STRING")
    got = name_variants.learn(spark.createDataFrame(values, "kind STRING, value STRING").distinct(), register)
    assert got.organisation["constr"] == {"construction"} and got.organisation["hq"] == set() == got.organisation["the"]
    assert got.person == {"bobby": {"robert"}}
    links = name_variants.link_spellings(spark.createDataFrame(values + values[:3], "kind STRING, value STRING"), register)
    assert {r.entity_id for r in links.where("value LIKE '%Constr.%'").collect()} == {100 + i for i in range(0, 20, 2)} - {102, 110}  # these two sound the same
    assert name_variants.link_spellings(spark.createDataFrame([], "kind STRING, value STRING"), register).count() == 0


def test_trie_equals_brute_force():
    rng = random.Random(5)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(80)})
    t = name_variants.Trie()
    for w in words:
        t.add(w)

    def osa(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for q in ("abca", "ccb", "aabbc"):
        want = {w for w in words if osa(q, w) <= 1}
        assert {n for _, n in t.near(q, 1)} >= {w for w in want if w in words} - set() and {n for d, n in t.near(q, 1)} <= want


def test_record_linkage(spark):
    rows = []

    def doc(i, **f):
        keys = {"SupplierName": "vendor_name", "VendorName": "vendor_name", "BuyerName": "customer_name", "CustomerName": "customer_name", "OrderDate": "invoice_date", "InvoiceDate": "invoice_date", "OrderAmount": "invoice_total", "InvoiceTotal": "invoice_total", "PONumber": "po_number", "InvoiceId": "invoice_id"}
        rows.extend((i, k, keys[k], v) for k, v in f.items())

    doc("i1", InvoiceId="1", VendorName="Farcarick Construction AG", CustomerName="Zanlizeworth Ltd", InvoiceDate="2025-03-08", InvoiceTotal="USD 1,000.50")
    doc("o1", PONumber="7", SupplierName="Farcarik Constr. AG", BuyerName="ZANLIZEWORTH LTD", OrderDate="03/05/2025", OrderAmount="1.000,50")
    doc("o2", PONumber="8", SupplierName="Farcarick Construction AG", BuyerName="Zanlizeworth Ltd", OrderDate="05.02.2025", OrderAmount="1000.50")
    doc("o3", PONumber="9", SupplierName="Farcarick Construction AG", BuyerName="Zanlizeworth Ltd", OrderDate="2025-03-07", OrderAmount="77.00")
    doc("n", InvoiceId=None, VendorName=None)
    df = spark.createDataFrame(rows + rows[:3], "document_id STRING, field_name STRING, entity_key STRING, value STRING")
    got = record_linkage.link_records(df, ["construction", "textiles"]).collect()
    assert [(r.document_id_1, r.document_id_2) for r in got] == [("i1", "o1")] and got[0].confidence > 0.9
    assert record_linkage.link_records(df.limit(0), []).count() == 0


def test_record_linkage_candidates_by_any_sum_or_party(spark):
    schema = "id STRING, side INT, day INT, total BIGINT, net BIGINT, seller STRING, buyer STRING"
    rows = [
        ("i1", 1, 100, 1190, 1000, "farkarik", ""), ("o1", 0, 98, 1001, None, "farkarik", "zanlizeworth"),  # the order gives the net sum, a cent off
        ("i2", 1, 200, 5000, None, "farkarik", "zanlizeworth"), ("o2", 0, 199, None, None, "farkaryk", "sanlizeworth"),  # no sum, a buyer misread
        ("i3", 1, 300, 7000, None, "xarkarik", "zanlizeworth"), ("o3", 0, 299, None, 6000, "farkarik", "zanlizevorth"),  # sums of two kinds, a seller misread
        ("i7", 1, 700, 8583_18, None, "elusbaw", "zanlizeworth"), ("o7", 0, 698, 8583_20, None, "elushav", "zanlizeworth"),  # two cents off
        ("i4", 1, None, 9000, 8000, "farkarik", ""), ("o4", 0, 400, 8000, None, "farkarik", "zanlizeworth"),  # no day, no buyer
        ("i5", 1, 500, 100, 90, "farkarik", "zanlizeworth"), ("o5", 0, 499, 300, None, "farkarik", "zanlizeworth"),  # another sum
        ("i6", 1, 600, 100, None, "farkarik", "zanlizeworth"), ("o6", 0, 601, None, None, "farkarik", "zanlizeworth"),  # ordered after the invoice
    ]
    df = spark.createDataFrame(rows, schema).withColumn("seller_all", F.col("seller")).withColumn("buyer_all", F.col("buyer"))
    got = record_linkage.linkable_pairs(df).collect()
    assert sorted((r.l, r.r) for r in got) == [("i1", "o1"), ("i2", "o2"), ("i3", "o3"), ("i4", "o4"), ("i7", "o7")]


def test_record_linkage_keeps_documents_of_an_open_side(spark):
    rows = []

    def doc(i, seller, day, total, **more):
        rows.extend([(i, "VendorName", "vendor_name", seller), (i, "CustomerName", "customer_name", "Zanlizeworth Ltd"), (i, "issue_date", "invoice_date", day), (i, "GrandTotal", "invoice_total", total)])
        rows.extend((i, *k.split("__"), v) for k, v in more.items())

    doc("i1", "Farcarick AG", "2025-03-08", "10.50", InvoiceId__invoice_id="1")
    doc("o1", "Farcarick AG", "2025-03-05", "10.50", OrderId__po_number="7")  # an order field against CustomerName
    doc("i2", "Brulanevik AG", "2025-05-08", "20.50", AmountDue__invoice_total="20.50")
    doc("u2", "Brulanevik AG", "2025-05-05", "20.50")  # no telling field: may be the order
    doc("o3", "Quorkabzup AG", "2025-06-05", "30.50", po_ref__po_number="8")
    doc("u3", "Quorkabzup AG", "2025-06-06", "30.50")  # may be the invoice
    doc("u4", "Sellomak AG", "2025-07-05", "40.50")  # no partner but itself
    doc("p1", "Farcarick AG", "2025-03-08", "10.50", EmployeeId__employee_id="1")
    df = spark.createDataFrame(rows, "document_id STRING, field_name STRING, entity_key STRING, value STRING")
    got = record_linkage.link_records(df, []).collect()
    assert sorted((r.document_id_1, r.document_id_2) for r in got) == [("i1", "o1"), ("i2", "u2"), ("o3", "u3")]


def _greatest(edges):
    if not edges:
        return 0.0
    (a, b, w), rest = edges[0], edges[1:]
    return max(_greatest(rest), w + _greatest([e for e in rest if not {a, b} & {e[0], e[1]}]))


def test_assignment_has_the_greatest_total(spark, monkeypatch):
    schema = "l STRING, r STRING, confidence DOUBLE"
    pairs = [("a", "u", 0.9), ("u", "b", 0.8), ("c", "b", 0.7), ("u", "v", 0.85), ("v", "u", 0.85)]  # u stands on both sides
    got = record_linkage.assign(spark.createDataFrame(pairs, schema)).collect()
    assert len({x for r in got for x in (r.l, r.r)}) == 4 and sum(r.confidence for r in got) == pytest.approx(_greatest(pairs))
    rng = random.Random(9)
    for sides in (["l1 l2 l3 l4".split(), "r1 r2 r3 r4".split()], ["x1 x2 x3 x4 x5".split()] * 2):
        for _ in range(60):
            edges = list({(a, b): (a, b, rng.randint(75, 100) / 100) for a in sides[0] for b in sides[1] if a < b and rng.random() < 0.6}.values())
            best = record_linkage.best_assignment(edges)
            assert len({x for e in best for x in e[:2]}) == 2 * len(best) and sum(e[2] for e in best) == pytest.approx(_greatest(edges))
    trap = [("l1", "r1", 0.9), ("l1", "r2", 0.85), ("l2", "r1", 0.86)]  # the best pair first would be the worse choice
    assert sorted((r.l, r.r) for r in record_linkage.assign(spark.createDataFrame(trap, schema)).collect()) == [("l1", "r2"), ("l2", "r1")]
    monkeypatch.setattr(record_linkage, "EXACT_PAIRS", 0)
    assert [(r.l, r.r) for r in record_linkage.assign(spark.createDataFrame(trap, schema)).collect()] == [("l1", "r1")]


def test_assignment_is_exact_for_components_of_any_size(spark):
    n = 50  # one component of 2,500 pairs; the least sum of i * j is that of opposite orders, best pairs first would take equal ones
    pairs = [(f"l{i:02}", f"r{j:02}", 1 - 0.25 * i * j / n**2) for i in range(1, n + 1) for j in range(1, n + 1)]
    got = record_linkage.assign(spark.createDataFrame(pairs, "l STRING, r STRING, confidence DOUBLE")).collect()
    assert sorted((r.l, r.r) for r in got) == [(f"l{i:02}", f"r{n + 1 - i:02}") for i in range(1, n + 1)]


def test_assignment_is_exact_for_odd_rings_of_many_pairs():
    rng, ids = random.Random(4), [f"x{i}" for i in range(9)]
    for _ in range(60):
        edges = [(a, b, rng.randint(75, 100) / 100) for a, b in rng.sample([(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]], rng.randint(19, 32))]
        best = record_linkage.best_assignment(edges + [(b, a, w) for a, b, w in edges])
        assert len({x for e in best for x in e[:2]}) == 2 * len(best) and sum(e[2] for e in best) == pytest.approx(_greatest(edges))


def test_packing(spark):
    pytest.importorskip("tiktoken")
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 5, 40, 90])))) for i in range(300)]
    docs += [(1000, "word " * 700), (1001, ""), (1002, None), (1003, "same"), (1003, "same")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    rows = packing.pack(df, [(1, 128), (2, 512)], bins=8).toPandas()
    for t, cap in ((1, 128), (2, 512)):
        r = rows[rows.target_id == t]
        assert r.groupby("container_id").n_tokens.sum().max() <= cap
        assert set(r.doc_id) == {d for d, x in docs if x is not None}
        sizes = dict(zip([d for d, x in docs if x], packing.count_tokens([x for _, x in docs if x], packing.TOKENIZER)))
        for d, g in r[r.doc_id < 1001].groupby("doc_id"):
            assert g.n_tokens.sum() == sizes[d] and (len(g) == 1 or sizes[d] > cap)
    used = packing.utilisation(spark.createDataFrame(rows), {1: 128, 2: 512})
    assert (used[:, 1] > 0.7).all()


def _passage(rng, n=60):
    return " ".join(rng.choice(["the", "note", "came", "to"]) if k % 3 else f"Zx{rng.getrandbits(24):x} {rng.randint(1000, 99999)}.{k}" for k in range(n))


def test_leakage(spark):
    rng = random.Random(4)
    a, b = _passage(rng), _passage(rng)
    clause = " Goods remain the property of the seller until every outstanding amount has been paid in full by the buyer."
    items = [(1, a + clause), (2, b + clause)]
    part = " ".join(a.split()[10:45])
    docs = [(1, "Hello.\n" + a.upper().replace("O", "0")), (2, "x " * 50 + part.replace(" ", "\n") + " y" * 50), (3, clause), (4, " ".join(b.split()[:8])), (5, None), (6, ""), (7, _passage(rng, 400) + clause)]
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn("item_id", F.lit("clash")), items).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]
    assert leakage.leaked(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), []).count() == 0


def test_leakage_of_items_with_one_passage(spark):
    rng = random.Random(6)
    a, b, c = _passage(rng), _passage(rng), _passage(rng)
    items = [(1, a), (2, a), (3, b), (3, b), (3, b + " end of it"), (4, c)]
    docs = spark.createDataFrame([(1, "Hello.\n" + a), (2, b + " x"), (3, c), (4, _passage(rng))], "doc_id BIGINT, text STRING")
    assert sorted(map(tuple, leakage.leaked(docs, items).collect())) == [(1, 1), (1, 2), (2, 3), (3, 4)]


def test_leakage_of_short_and_shared_passages(spark):
    rng = random.Random(12)
    a, b = _passage(rng), _passage(rng)
    short, tiny = "Paid in Zarkow on 17 May 4821 by Ilmo Grunat", "Qx 77-Z"
    items = [(1, a), (2, " ".join([a, b])), (3, short), (4, tiny), (5, b)]  # 2 holds 1 and 5 whole
    docs = [(1, a), (2, b + " tail"), (3, "So: " + short.upper() + "."), (4, "the code qx77z it is"), (5, "Paid in Zarkow on 18 June"), (6, "Дом " * 40)]
    got = sorted(map(tuple, leakage.leaked(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), items).collect()))
    assert got == [(1, 1), (1, 2), (2, 2), (2, 5), (3, 3), (4, 4)]


def test_leakage_removes_the_spans(spark):
    rng = random.Random(13)
    a = _passage(rng)
    before, after = "Ältere Zeilen… davor, ganz “ruhig”.\n", "\nUnd danach – noch ein Satz."
    docs = spark.createDataFrame([(1, before + a + after), (2, "nothing here"), (3, None)], "doc_id BIGINT, text STRING").withColumn("n_removed", F.lit(9))
    got = {r.doc_id: r for r in leakage.without_leaks(docs, [(7, a)]).collect()}
    assert got[2].text == "nothing here" and got[3].text is None and got[1].n_removed == 1 and got[2].n_removed == 0
    assert got[1].text.startswith(before[:-2]) and got[1].text.endswith(after[2:]) and len(got[1].text) <= len(before + after) + 4
    assert leakage.without_leaks(docs.limit(0), []).count() == 0


EN = "The reader of the office has found that the signed note was lost before the end of the week and nobody knows the reason for it. "
DE = "Der Leser im Büro hat festgestellt, dass der unterschriebene Schein vor dem Ende der Woche verloren ging und niemand den Grund dafür kennt. "


def test_language(spark):
    train = [("en", EN * 5), ("de", DE * 5)] * 12 + [("de", EN * 5)]
    model = language.fit_words(train)
    docs = [(1, EN * 3, "en_GB", "a-1"), (2, DE * 3, "EN", "a-1"), (3, EN * 2 + DE * 2, "eng", "b-2"), (4, DE * 3, None, None), (5, "1234 ---", "xx", "c"), (6, None, None, "c"), (7, "", None, "c"), (8, DE * 3 + "\nInvoice No: 17\n", "deu", "a-2")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING").withColumn("prior", F.lit(1))
    got = sorted(map(tuple, language.corrected_labels(df, model).collect()))
    assert got == [(2, "de"), (3, "de"), (3, "en"), (4, "de")]
    assert language.corrected_labels(df.limit(0), model).count() == 0


def test_viterbi_equals_exhaustive():
    import itertools

    rng = np.random.default_rng(0)
    ev, start = rng.normal(0, 6, (6, 3)), rng.normal(0, 1, 3)
    best = max(itertools.product(range(3), repeat=6), key=lambda p: start[p[0]] + sum(ev[i, x] for i, x in enumerate(p)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:])))
    assert tuple(language._viterbi(ev, start)) == best
