"""Engine relations derived from the driver's tables: two readings of an invoice per order.

Path B is path A with errors that depend on the order's key, so that SQL can
say the same. Money is summed in whole cents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.runtime import table

INVOICE_FIELDS = ["InvoiceId", "CustomerName", "InvoiceDate", "DueDate", "Subtotal", "TotalTax", "InvoiceTotal"]


def money(cents: Column) -> Column:
    return F.concat((F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


def line_cents(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("document_id"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).alias("cents"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """k, od, name, sub, tax, total (cents; NULL for orders without lines)."""
    sums = line_cents(spark, sf).groupBy("document_id").agg(F.sum("cents").alias("sub"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey"), F.col("o_orderdate").cast("date").alias("od"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    j = o.join(c, "o_custkey").join(sums.withColumnRenamed("document_id", "k"), "k", "left")
    tax = F.floor(F.col("sub") * 0.08 + 0.5)
    return j.withColumn("tax", tax).select("k", "od", "name", "sub", "tax", (F.col("sub") + F.col("tax")).alias("total"))


def _rows(o: DataFrame, values: dict[str, Column], conf: Column) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("field_name"), v.alias("value")) for n, v in values.items()])
    return o.select(F.col("k").alias("document_id"), conf.alias("conf"), F.inline(cells)).where("value IS NOT NULL").select("document_id", "field_name", "value", "conf")


def _m(k: int) -> Column:
    return F.col("k") % k


def conf_a() -> Column:
    return 0.80 + (_m(20)) / 100


def conf_b() -> Column:
    return 0.80 + ((F.col("k") * 7) % 20) / 100


def values_a() -> dict[str, Column]:
    ymd = lambda c: F.date_format(c, "yyyy-MM-dd")
    return {
        "InvoiceId": F.when(_m(19) == 0, F.concat(F.lit("inv#"), "k")).otherwise(F.concat(F.lit("INV-"), F.year("od"), F.lit("-"), "k")),
        "CustomerName": F.col("name"),
        "InvoiceDate": ymd(F.col("od")),
        "DueDate": F.when(_m(17) == 0, None).when(_m(29) == 0, "not-a-date").when(_m(23) == 0, ymd(F.date_sub("od", 5))).when(_m(43) == 0, ymd(F.col("od"))).otherwise(ymd(F.date_add("od", 30))),
        "Subtotal": money(F.col("sub")),
        "TotalTax": money(F.col("tax")),
        "InvoiceTotal": F.when(_m(31) == 0, money(F.col("total") + 10000)).otherwise(money(F.col("total"))),
    }


def values_b() -> dict[str, Column]:
    return {
        "InvoiceId": F.when(_m(19) == 0, F.concat(F.lit("inv#"), "k")).when(_m(7) == 1, F.concat(F.lit("INV-"), F.year("od"), F.lit("-"), "k", F.lit("I"))).otherwise(F.concat(F.lit("INV-"), F.year("od"), F.lit("-"), "k")),
        "CustomerName": F.when(_m(7) == 2, F.upper(F.expr("substr(name, 1, length(name) - 1)"))).when(_m(7) == 3, F.concat(F.lit("Unrelated O'Trading "), "k")).otherwise(F.upper("name")),
        "InvoiceDate": F.when(_m(7) == 4, F.date_format("od", "MM/dd/yyyy")).when(_m(7) == 5, F.date_format("od", "dd-MM-yyyy")).when(_m(11) == 5, F.date_format(F.date_add("od", 1), "yyyy-MM-dd")).otherwise(F.date_format("od", "yyyy-MM-dd")),
        "DueDate": F.when(_m(29) == 0, "not-a-date").when(_m(23) == 0, F.date_format(F.date_sub("od", 5), "yyyy-MM-dd")).when(_m(43) == 0, F.date_format("od", "yyyy-MM-dd")).otherwise(F.date_format(F.date_add("od", 30), "yyyy-MM-dd")),
        "Subtotal": F.when(_m(11) == 1, money(F.col("sub") + 50)).when(_m(11) == 2, money(F.col("sub") + 500)).otherwise(money(F.col("sub"))),
        "TotalTax": F.when(_m(13) == 0, None).otherwise(money(F.col("tax"))),
        "InvoiceTotal": F.concat(F.when(_m(3) == 0, "$").otherwise(""), F.when(_m(31) == 0, money(F.col("total") + 10000)).otherwise(money(F.col("total")))),
    }


def path_a(o: DataFrame) -> DataFrame:
    return _rows(o, values_a(), conf_a())


def path_b(o: DataFrame) -> DataFrame:
    return _rows(o, values_b(), conf_b())


def truth(o: DataFrame) -> DataFrame:
    """Labels: path A without its planted errors; NULL (no label) for orders divisible by 13."""
    v = {
        "InvoiceId": F.concat(F.lit("INV-"), F.year("od"), F.lit("-"), "k"), "CustomerName": F.col("name"),
        "InvoiceDate": F.date_format("od", "dd-MM-yyyy"), "DueDate": F.date_format(F.date_add("od", 30), "yyyy-MM-dd"),
        "Subtotal": money(F.col("sub")), "TotalTax": money(F.col("tax")), "InvoiceTotal": money(F.col("total")),
    }
    return _rows(o, {f: F.when(_m(13) != 0, c) for f, c in v.items()}, F.lit(1.0)).drop("conf")


def passes(a: DataFrame) -> DataFrame:
    """Three readings of each field of path A; the later ones miss, differ or find nothing by the order's key."""
    k = F.col("document_id")
    second = F.when(k % 9 == 0, "?").otherwise(F.concat(F.lit(" "), F.upper("value")))
    third = F.when(k % 6 == 0, None).otherwise(F.col("value"))
    cells = F.array(F.struct(F.lit(1).alias("pass"), F.col("value").alias("v")), F.struct(F.lit(2).alias("pass"), second.alias("v")), F.struct(F.lit(3).alias("pass"), third.alias("v")))
    return a.select("document_id", "field_name", F.inline(cells)).where("v IS NOT NULL").select("document_id", "field_name", "pass", F.col("v").alias("value"))


def readings(o: DataFrame) -> DataFrame:
    """All readings of all documents: both paths, the repeated passes, a second page of some, the sums of their lines.

    Orders are read once; each gives its rows from one array.
    """
    va, vb = values_a(), values_b()
    cell = lambda page, name, source, value, conf: F.struct(F.lit(page).alias("page"), F.lit(name).cast("string").alias("field_name"), F.lit(source).alias("source"), value.alias("value"), conf.cast("double").alias("conf"))
    none = F.lit(None)
    cells = [cell(1, n, "a", v, conf_a()) for n, v in va.items()] + [cell(1, n, "b", v, conf_b()) for n, v in vb.items()]
    for n, v in va.items():
        cells += [cell(1, n, "pass", F.when(_m(9) == 0, "?").otherwise(F.concat(F.lit(" "), F.upper(v))), none), cell(1, n, "pass", F.when(_m(6) == 0, None).otherwise(v), none)]
    cells.append(cell(2, "InvoiceTotal", "a", F.when(_m(37) == 0, money(F.col("total") + 500)), F.lit(0.9)))
    cells.append(cell(1, None, "line", F.when(_m(41) == 0, money(F.col("sub") + 100)).otherwise(money(F.col("sub"))), none))
    return o.select(F.col("k").alias("document_id"), F.inline(F.array(*cells))).where("value IS NOT NULL")


def bundle_claims(o: DataFrame) -> DataFrame:
    """An invoice and a purchase order per order, the same facts under other names, some contradicting."""
    k, doc = F.col("k"), lambda p: F.concat(F.lit(p), F.col("k"))
    inv = [("InvoiceNumber", F.concat(F.lit("INV-"), k)), ("SupplierName", F.col("name")), ("InvoiceDate", F.date_format("od", "yyyy-MM-dd")), ("GrandTotal", money(F.col("total")))]
    po = [
        ("InvoiceRef", F.when(k % 7 == 1, F.concat(F.lit("INV-9"), k)).otherwise(F.concat(F.lit("INV-"), k))),
        ("VendorName", F.when(k % 7 == 2, F.concat(F.lit("Other Trading "), k)).otherwise(F.upper("name"))),
        ("OrderDate", F.when(k % 7 == 3, F.date_format(F.date_add("od", 3), "yyyy-MM-dd")).otherwise(F.date_format("od", "MM/dd/yyyy"))),
        ("OrderAmount", F.when(k % 7 == 4, money(F.col("total") + 700)).when(k % 7 == 5, "  ").otherwise(F.concat(F.lit("$"), money(F.col("total"))))),
    ]
    cells = [F.struct(doc("inv-").alias("document_id"), F.lit(0).alias("doc_seq"), F.lit(i).alias("claim_seq"), F.lit(n).alias("field_name"), v.alias("value")) for i, (n, v) in enumerate(inv)]
    cells += [F.struct(doc("po-").alias("document_id"), F.lit(1).alias("doc_seq"), F.lit(i).alias("claim_seq"), F.lit(n).alias("field_name"), v.alias("value")) for i, (n, v) in enumerate(po)]
    return o.select(F.col("k").alias("bundle_id"), F.inline(F.array(*cells))).where("value IS NOT NULL")


def page_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """An invoice page an order as tokens: labels with values, a table of its lines, totals; some are tampered with.

    Heights are 16; where the key is divisible by 10 the total is 38 tall, by 14 it is
    spread to twice the pitch. Lines of an order beyond the tenth go to a second page.
    """
    o = orders(spark, sf).where("sub IS NOT NULL")
    k = F.col("k")

    def tok(seq: int, text: Column, x: float, y: Column, h: Column | None = None, pitch: Column | None = None) -> Column:
        t = text.cast("string")
        return F.struct(F.lit(1).alias("page"), F.lit(seq).alias("tok_seq"), t.alias("text"), (0.90 + k % 10 / 100).alias("conf"), F.lit(float(x)).alias("x"), y.cast("double").alias("y"), (F.length(t) * (pitch if pitch is not None else F.lit(8.0))).alias("w"), (h if h is not None else F.lit(16.0)).cast("double").alias("h"))

    y = lambda v: F.lit(float(v))
    tall, wide = F.when(k % 10 == 0, 38.0).otherwise(16.0), F.when(k % 14 == 0, 17.0).otherwise(8.0)
    head = [
        tok(0, F.concat(F.lit("Vendor Name: "), "name"), 40, y(20)), tok(1, F.lit("Invoice Id:"), 40, y(60)), tok(2, F.concat(F.lit("INV-"), F.year("od"), F.lit("-"), k), 200, F.when(k % 3 == 0, 72.0).otherwise(62.0)),
        tok(3, F.concat(F.lit("Invoice Date: "), F.date_format("od", "yyyy-MM-dd")), 40, y(100)), tok(4, F.concat(F.lit("Due Date: "), F.date_format(F.date_add("od", 30), "MM/dd/yyyy")), 400, y(104)),
        tok(5, F.lit("Description"), 40, y(160)), tok(6, F.lit("Qty"), 300, y(163)), tok(7, F.lit("Line Total"), 500, y(158)),
        tok(90, F.concat(F.lit("Subtotal: $"), money(F.col("sub"))), 400, y(700)), tok(91, F.concat(F.lit("Federal Tax: $"), money(F.col("tax"))), 40, y(740)), tok(92, F.concat(F.lit("Tax (8%): $"), money(F.col("tax"))), 400, y(742)),
        tok(93, F.lit("Invoice Total:"), 400, y(780)), tok(94, F.concat(F.lit("$"), money(F.col("total"))), 560, y(782), tall, wide),
    ]
    fixed = o.select(k.alias("document_id"), F.inline(F.array(*head)))
    li = table(spark, sf, "lineitem").join(o.select(k.alias("l_orderkey")), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rn = li.select(F.col("l_orderkey").alias("k"), "l_partkey", "l_quantity", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).alias("cents"), (F.row_number().over(order) - 1).alias("rn"))
    at = (F.lit(195.0) + (F.col("rn") % 10) * 40)
    cell = lambda i, text, x, dy: F.struct((F.lit(1) + F.floor(F.col("rn") / 10)).cast("int").alias("page"), (F.lit(10 + i) + F.col("rn") * 3).cast("int").alias("tok_seq"), text.alias("text"), (0.90 + k % 10 / 100).alias("conf"), F.lit(float(x)).alias("x"), (at + dy).cast("double").alias("y"), (F.length(text) * 8.0).alias("w"), F.lit(16.0).alias("h"))
    body = rn.select(k.alias("document_id"), F.inline(F.array(cell(0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), 44, 0), cell(1, F.col("l_quantity").cast("int").cast("string"), 305, 4), cell(2, F.concat(F.lit("$"), money(F.col("cents"))), 498, -3))))
    return fixed.unionByName(body)


#: Pages whose rows leave a function in one Arrow batch.
PAGES_AT_ONCE = 64
#: What is wrong with a generated page, by its key's remainder by 8.
PAGE_KINDS = ["clean", "clean", "blurred", "dark", "blank", "small", "spliced", "skewed"]


def draw_page(key: int, kind: str, side: int = 640) -> np.ndarray:
    """A grey page of text-like strokes; the words depend on the key alone."""
    rng = np.random.default_rng(key)
    size = 200 if kind == "small" else side
    page = np.full((size, size), 245, np.uint8)
    if kind != "blank":
        for y in range(40, size - 40, 24):
            x = 40
            while x < size - 80:
                n = int(rng.integers(12, 60))
                for c in range(x, min(x + n, size - 40), 6):
                    page[y:y + int(rng.integers(8, 14)), c:c + 3] = 30
                x += n + 10
    else:
        page[:] = 255
    if kind == "blurred":
        p = page.astype(float)
        for _ in range(120):
            p = (p + np.roll(p, 1, 0) + np.roll(p, -1, 0) + np.roll(p, 1, 1) + np.roll(p, -1, 1)) / 5
        page = p.astype(np.uint8)
    if kind == "dark":
        page = (page // 16).astype(np.uint8)
    if kind == "spliced":
        page = np.repeat(page[:, :, None], 3, axis=2)
        page[280:344, 280:408] = rng.integers(0, 256, (64, 128, 3))
    if kind == "skewed":
        from docsieve.pixels.page import rotate

        page = rotate(page, -6.0)
    return page


def page_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, page): a page a supplier, two of every fifth."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.cast("bigint").alias("document_id"), F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("page"))
    return rows.repartition(spark.sparkContext.defaultParallelism)


def each_page(spark: SparkSession, sf: str, fn: Callable[[int, int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """The rows of fn(document_id, page, pixels) over all pages.

    A page is drawn and used by one function, one at a time, so that a task holds one page and no pixels are sent.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, len(b), PAGES_AT_ONCE):
                part = b.iloc[at:at + PAGES_AT_ONCE]
                rows = [r for i, n in zip(part["document_id"], part["page"]) for r in fn(int(i), int(n), draw_page(int(i) * 10 + int(n), PAGE_KINDS[int(i) % 8] if n == 1 else "clean"))]
                yield pd.DataFrame(rows, columns=names)

    return page_keys(spark, sf).mapInPandas(run, schema)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """A grey page a supplier, drawn where it is needed, with something wrong by its key; page 2 of every fifth is clean."""

    def draw(batches):
        for b in batches:
            for i, n in zip(b["document_id"], b["page"]):
                p = draw_page(int(i) * 10 + int(n), PAGE_KINDS[int(i) % 8] if n == 1 else "clean")
                yield pd.DataFrame([(i, n, p.shape[0], p.shape[1], p.tobytes())], columns=["document_id", "page", "height", "width", "data"])

    return page_keys(spark, sf).mapInPandas(draw, "document_id BIGINT, page INT, height INT, width INT, data BINARY")
