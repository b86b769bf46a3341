"""From two readings of a document to scored fields, evaluation and reconciliation.

All are projections, joins on (document_id, field_name) and grouped folds; a
document's rows stay together from the first shuffle on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve import dims
from docsieve.functions import scalar as S
from docsieve.runtime import written

KEY = ["document_id", "field_name"]


READING = "document_id, page INT, field_name STRING, source STRING, value STRING, conf DOUBLE"
#: The fields that the checks look at.
CHECKED = [
    "Subtotal", "TotalTax", "InvoiceTotal", "GrossPay", "TotalDeductions", "NetPay", "InvoiceDate", "DueDate", "PayPeriodStart", "PayPeriodEnd", "PayDate",
    "InvoiceId", "DocumentNumber", "EmployeeId",
]


def reconcile_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of both paths; the value of the surer one (a on ties), its confidence times the penalty.

    Inputs: document_id, page, field_name, value, conf; one row a key. NULL keys match nothing.
    """
    keys = [c for c in ("document_id", "page", "field_name") if c in a.columns]
    left = a.select(*keys, F.col("value").alias("value_a"), F.col("conf").alias("conf_a"))
    right = b.select(*keys, F.col("value").alias("value_b"), F.col("conf").alias("conf_b"))
    return _chosen(left.join(right, keys, "full"))


def _chosen(j: DataFrame) -> DataFrame:
    """value_a, conf_a, value_b, conf_b with agreement, value and native confidence."""
    kind = S.field_type(F.col("field_name"))
    j = j.withColumn("agreement", S.agreement(F.col("value_a"), F.col("value_b"), kind))
    use_a = F.col("value_b").isNull() | (F.col("value_a").isNotNull() & (F.col("conf_a") >= F.col("conf_b")))
    conf = F.when(use_a, F.col("conf_a")).otherwise(F.col("conf_b"))
    single = F.col("agreement") == "single_source"
    native = F.when(single, conf).otherwise(S.half_up(conf * S.penalty(F.col("agreement")), 3))
    return j.withColumn("value", F.when(use_a, F.col("value_a")).otherwise(F.col("value_b"))).withColumn("native", native)


def fuse_readings(readings: DataFrame, n_passes: int = 3) -> DataFrame:
    """From all readings of a document to its scored fields, after one shuffle by document.

    readings: READING; source is 'a' or 'b' (the paths), 'pass' (a repeated
    reading of path a) or 'line' (the sum of a line item of the first table, no
    field name). One row a field: both values, agreement, value, native, consistency
    (share of the n_passes readings equal to path a's without case and outer
    blanks, one that finds nothing counts as unequal; NULL without a value of path
    a), flags, passed, cap, final, best (final at full consistency), and the
    document's summary_flags. Of several pages, a field's last page counts.
    """
    by_doc = readings.repartition("document_id")  # all that follows is grouped within it
    text = F.lower(F.trim("value"))
    pick = lambda src, c: F.max(F.when(F.col("source") == src, F.col(c)))
    field = by_doc.groupBy("document_id", "page", "field_name").agg(
        pick("a", "value").alias("value_a"), pick("a", "conf").alias("conf_a"), pick("b", "value").alias("value_b"), pick("b", "conf").alias("conf_b"),
        F.collect_list(F.when(F.col("source") == "pass", text)).alias("again"),  # as many as passes
        F.sum(F.when(F.col("source") == "line", F.col("value").try_cast("double"))).alias("line_sum"), F.count(F.when(F.col("source") == "line", 1)).alias("n_lines"),
    )
    same = 1 + F.size(F.filter("again", lambda v: v == F.lower(F.trim("value_a"))))
    field = field.withColumn("consistency", F.when(F.col("value_a").isNotNull(), S.half_up(same / float(n_passes), 3))).drop("again")
    rows = _chosen(field.where("value_a IS NOT NULL OR value_b IS NOT NULL OR n_lines > 0"))
    last = F.struct("page", "value_a", "conf_a", "value_b", "conf_b", "agreement", "value", "native", "consistency")
    rows = rows.groupBy("document_id", "field_name").agg(F.max_by(last, "page").alias("r"), F.sum("line_sum").alias("line_sum"), F.sum("n_lines").alias("n_lines")).select("document_id", "field_name", "r.*", "line_sum", "n_lines")
    doc = rows.groupBy("document_id").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in CHECKED],
        F.sum("line_sum").alias("line_sum"), F.sum("n_lines").alias("n_lines"),
        F.collect_list(F.when(F.col("field_name").isNotNull(), F.struct("field_name", "page", "value_a", "value_b", "agreement", "value", "native", "consistency"))).alias("fields"),  # a document's fields are few
    )
    checked = with_checks(doc).select("document_id", "checks", "summary_flags", F.explode("fields").alias("f")).select("document_id", "f.*", "checks", "summary_flags")
    check = F.try_element_at("checks", F.col("field_name"))
    checked = checked.withColumn("c", check).drop("checks")
    passed, cap = F.coalesce(F.col("c.passed"), F.lit(True)), F.col("c.cap")
    flags = F.coalesce(F.col("c.flags"), F.array(F.lit("NO_VALIDATOR_APPLIED")))
    final = S.fused(F.col("native"), F.col("agreement"), F.col("consistency"), passed, cap)
    best = S.fused(F.col("native"), F.col("agreement"), F.lit(1.0), passed, cap)
    return checked.select("document_id", "field_name", "page", "value_a", "value_b", "agreement", "value", "native", "consistency", flags.alias("flags"), passed.alias("passed"), cap.alias("cap"), final.alias("final"), best.alias("best"), "summary_flags")


def with_checks(doc: DataFrame) -> DataFrame:
    """A wide row a document (the CHECKED fields as text, line_sum, n_lines) with its checks and summary_flags.

    checks: field name to (flags, passed, cap). Line sums only give a flag;
    subtotal + tax against the total, gross less deductions against net, the
    order of dates and the form of identifiers fail their fields. Amounts that
    are no plain numbers take no part.
    """
    num = {c: S.plain_number(F.col(c)) for c in dims.MONEY_FIELDS}
    day = {c: S.first_date(F.col(c), S.VALIDATION_DATES) for c in ("InvoiceDate", "DueDate", "PayPeriodStart", "PayPeriodEnd", "PayDate")}
    doc = doc.select("*", *[v.alias(f"n_{k}") for k, v in num.items()], *[v.alias(f"d_{k}") for k, v in day.items()])
    n, d, off = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"d_{c}")), dims.MONEY_TOLERANCE
    lines = F.when((F.col("n_lines") > 0) & n("Subtotal").isNotNull(), F.when(F.abs(S.half_up(F.coalesce("line_sum", F.lit(0.0)), 2) - n("Subtotal")) <= off, "LINE_SUM_OK").otherwise("LINE_SUM_FAIL"))
    tax_ok = F.abs(S.half_up(n("Subtotal") + n("TotalTax"), 2) - n("InvoiceTotal")) <= off
    pay_ok = F.abs(S.half_up(n("GrossPay") - n("TotalDeductions"), 2) - n("NetPay")) <= off
    due_ok, span_ok, paid_ok = d("InvoiceDate") < d("DueDate"), d("PayPeriodStart") < d("PayPeriodEnd"), d("PayDate") >= d("PayPeriodEnd")
    no = lambda c: F.coalesce(~c, F.lit(False))

    def entry(flags: list, failed: F.Column, cap: F.Column) -> F.Column:
        return F.struct(F.array_compact(F.array(*flags)).alias("flags"), (~failed).alias("passed"), F.when(failed, cap).cast("double").alias("cap"))

    money = entry([lines, F.when(tax_ok, "TAX_TOTAL_OK").when(~tax_ok, "TAX_TOTAL_FAIL"), F.when(tax_ok, "ARITHMETIC_OK")], no(tax_ok), F.lit(0.50))
    slip = F.when(pay_ok.isNotNull(), entry([F.when(pay_ok, "PAYSLIP_ARITHMETIC_OK").otherwise("PAYSLIP_ARITHMETIC_FAIL")], no(pay_ok), F.lit(0.50)))

    def date(name: str, ok: F.Column, fails: bool = True) -> F.Column:
        bad = F.col(name).isNotNull() & d(name).isNull()
        failed = bad | no(ok) if fails else bad
        flags = [F.when(bad, "DATE_UNPARSEABLE"), F.when(ok, "DATE_LOGIC_OK"), F.when(no(ok), "DATE_LOGIC_FAIL") if fails else F.lit(None).cast("string")]
        return F.when(F.col(name).isNotNull(), entry(flags, failed, F.when(bad, 0.40).otherwise(0.45)))

    def identifier(name: str) -> F.Column:
        ok = F.trim(F.col(name)).rlike(r"^[A-Z]{2,6}-\d{4}-[A-Za-z0-9]+$")
        return F.when(F.col(name).isNotNull(), entry([F.when(ok, "ID_FORMAT_OK").otherwise("ID_FORMAT_FAIL")], no(ok), F.lit(0.55)))

    parts = {"Subtotal": money, "TotalTax": money, "InvoiceTotal": money, "GrossPay": slip, "TotalDeductions": slip, "NetPay": slip}
    parts |= {"InvoiceDate": date("InvoiceDate", due_ok), "DueDate": date("DueDate", due_ok), "PayPeriodStart": date("PayPeriodStart", span_ok), "PayPeriodEnd": date("PayPeriodEnd", span_ok), "PayDate": date("PayDate", paid_ok, False)}
    parts |= {c: identifier(c) for c in ("InvoiceId", "DocumentNumber", "EmployeeId")}
    summary = [F.when(no(tax_ok), "ARITHMETIC_INCONSISTENCY"), F.when(no(pay_ok), "PAYSLIP_ARITHMETIC_INCONSISTENCY"), F.when(no(due_ok), "DATE_ORDER_VIOLATION"), F.when(no(span_ok), "PAY_PERIOD_ORDER_VIOLATION")]
    checks = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])
    return doc.withColumn("checks", checks).withColumn("summary_flags", F.array_compact(F.array(*summary)))


def validations(doc: DataFrame) -> DataFrame:
    """(document_id, field_name, flags, passed, cap) of the checks that apply, from ``with_checks``' wide rows."""
    rows = with_checks(doc).select("document_id", F.explode("checks").alias("field_name", "c")).where("c IS NOT NULL")
    return rows.select("document_id", "field_name", "c.flags", "c.passed", "c.cap")


def escalate(scored: DataFrame, threshold: float = dims.ESCALATE_BELOW, more: tuple[F.Column, ...] = ()) -> DataFrame:
    """Status of each document with its reasons and flags. scored: as of ``fuse_readings``.

    Reasons in order: arithmetic, then field by field by name a low final
    confidence and a disagreement of the paths; each once. authenticity_flags
    are the summary flags, marked VALIDATION:. more: further aggregates of a document's fields, by their names.
    """
    low = F.when(F.col("final") < threshold, S.low_confidence_reason(F.col("field_name"), F.col("final"), threshold))
    differ = F.when(F.col("agreement") == "ocr!=vision", S.disagreement_reason(F.col("field_name"), F.col("value")))
    rows = scored.withColumn("why", F.array_compact(F.array(low, differ)))
    g = rows.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("field_name", "why"))).alias("why"), F.first("summary_flags").alias("summary_flags"), F.min("final").alias("min_conf"), F.count("*").alias("n_fields"), *more,
    )
    first = F.when(F.array_contains("summary_flags", "ARITHMETIC_INCONSISTENCY"), F.array(F.lit("Arithmetic inconsistency: Subtotal + TotalTax != InvoiceTotal"))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_distinct(F.concat(first, F.flatten(F.transform("why", lambda x: x.why))))
    return g.select(
        "document_id", reasons.alias("reasons"), F.transform("summary_flags", lambda f: F.concat(F.lit("VALIDATION:"), f)).alias("authenticity_flags"), "min_conf", "n_fields", *g.columns[5:],
    ).withColumn("status", F.when(F.size("reasons") > 0, "NEEDS_REVIEW").otherwise("OK"))


def consistency(passes: DataFrame, n_passes: int = 3) -> DataFrame:
    """Share of the n_passes readings equal to the first. Columns: key, pass, value; one that is absent or NULL is a miss."""
    hit = F.lower(F.trim("value"))
    g = passes.groupBy(*KEY).agg(F.max(F.when(F.col("pass") == 1, hit)).alias("ref"), F.collect_list(hit).alias("all"))  # as many as passes
    return g.where("ref IS NOT NULL").select(*KEY, S.half_up(F.size(F.filter("all", lambda v: v == F.col("ref"))) / float(n_passes), 3).alias("consistency"))


def line_sums(lines: DataFrame, subtotals: DataFrame) -> DataFrame:
    """Sum of the line items (document_id, cents) against the subtotal (document_id, value): LINE_SUM_OK, LINE_SUM_FAIL or NO_LINES."""
    sums = lines.groupBy("document_id").agg((F.sum("cents") / 100).alias("line_sum"))
    d = subtotals.join(sums, "document_id", "left")
    ok = F.abs(F.col("line_sum") - S.plain_number(F.col("value"))) <= dims.MONEY_TOLERANCE
    return d.select("document_id", F.when(ok, "LINE_SUM_OK").when(~ok, "LINE_SUM_FAIL").otherwise("NO_LINES").alias("flag"))


def payslip_arithmetic(slips: DataFrame) -> DataFrame:
    """Gross less deductions against net. Columns: document_id, gross, deductions, net (text)."""
    g, d, n = (S.plain_number(F.col(c)) for c in ("gross", "deductions", "net"))
    ok = F.abs(S.half_up(g - d, 2) - n) <= dims.MONEY_TOLERANCE
    return slips.select("document_id", F.when(ok, "PAYSLIP_ARITHMETIC_OK").when(~ok, "PAYSLIP_ARITHMETIC_FAIL").otherwise("NO_VALIDATOR_APPLIED").alias("flag"), F.when(~ok, 0.50).alias("cap"))


def outcomes(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """TP, FP or FN of each field; a value that is NULL is absent, a wrong value is a FP only."""
    e = extracted.where("value IS NOT NULL").select(*KEY, "value", "conf")
    t = truth.where("value IS NOT NULL").select(*KEY, F.col("value").alias("truth"))
    j = e.join(t, KEY, "full")
    hit = S.values_match(F.col("value"), F.col("truth"), F.col("field_name"))
    return j.withColumn("outcome", F.when(F.col("value").isNull(), "FN").when(F.col("truth").isNull(), "FP").when(hit, "TP").otherwise("FP"))


def metrics(out: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, n_gt, n_ext, precision, recall and F1 (of the rounded two) by the given columns.

    n_gt counts the labels that were found right or missed, n_ext the values found.
    """
    n = [F.sum((F.col("outcome") == x).cast("int")).cast("bigint").alias(x.lower()) for x in ("TP", "FP", "FN")]
    g = out.groupBy(*by).agg(*n).na.fill(0, ["tp", "fp", "fn"])
    g = g.withColumn("n_gt", F.col("tp") + F.col("fn")).withColumn("n_ext", F.col("tp") + F.col("fp"))
    p = F.when(F.col("tp") + F.col("fp") > 0, S.half_up(F.col("tp") / (F.col("tp") + F.col("fp")), 4)).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, S.half_up(F.col("tp") / (F.col("tp") + F.col("fn")), 4)).otherwise(0.0)
    g = g.withColumn("precision", p).withColumn("recall", r)
    f = F.when(F.col("precision") + F.col("recall") > 0, S.half_up(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4)).otherwise(0.0)
    return g.withColumn("f1", f)


def calibration(out: DataFrame) -> DataFrame:
    """Accuracy against mean confidence per bucket; empty buckets are kept."""
    spark = out.sparkSession
    buckets = spark.createDataFrame([("High", 0), ("Medium", 1), ("Low", 2)], "bucket STRING, ord INT")
    name = F.when(F.col("conf") >= 0.90, "High").when(F.col("conf") >= 0.75, "Medium").otherwise("Low")
    g = out.where("outcome <> 'FN'").groupBy(name.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum((F.col("outcome") == "TP").cast("int")).cast("bigint").alias("correct"), F.sum(F.floor(F.col("conf") * 1000 + 0.5)).alias("milli")
    )
    j = g.join(F.broadcast(buckets), "bucket", "right").na.fill(0, ["n", "correct", "milli"])  # three rows
    acc = F.when(F.col("n") > 0, S.half_up(F.col("correct") / F.col("n"), 4)).otherwise(0.0)
    mean = F.when(F.col("n") > 0, S.half_up(F.col("milli") / 1000 / F.col("n"), 4)).otherwise(0.0)
    return j.select("bucket", "n", "correct", acc.alias("accuracy"), mean.alias("mean_conf"), S.half_up(F.abs(mean - acc), 4).alias("gap"))


def claims_of(fields: DataFrame) -> DataFrame:
    """Claims with their canonical entity; blank values are dropped."""
    return fields.where("trim(value) <> ''").withColumn("entity_key", S.entity_key(F.col("field_name")))


def shared_entities(claims: DataFrame) -> DataFrame:
    """Entities of a bundle that two documents speak of."""
    g = claims.groupBy("bundle_id", "entity_key").agg(F.count("*").alias("n_claims"), F.min("document_id").alias("lo"), F.max("document_id").alias("hi"))
    return g.where("lo <> hi").select("bundle_id", "entity_key", "n_claims")


def conflicts(claims: DataFrame) -> DataFrame:
    """First contradiction of each entity and pair of documents of a bundle.

    claims: bundle_id, document_id, doc_seq, claim_seq, entity_key, value. Equal
    claims of a document are one; the comparison takes the entity's name for the
    field's. For bundles of a transaction's papers, which are few; all documents
    of a bundle meet. ``profile_conflicts`` is for any bundle.
    """
    kind, order = S.field_type(F.col("entity_key")), F.struct("doc_seq", "claim_seq")
    read = S.readable(F.col("value"), kind)
    c = claims.select("bundle_id", "entity_key", "document_id", "value", order.alias("o"), read[0].alias("n"), read[1].alias("d"), kind.alias("kind"))
    a, b = (c.select("bundle_id", "entity_key", *([F.col("kind")] if i == 1 else []), *[F.col(x).alias(f"{x}_{i}") for x in ("document_id", "value", "o", "n", "d")]) for i in (1, 2))
    j = a.join(b, ["bundle_id", "entity_key"]).where("o_1 < o_2 AND document_id_1 <> document_id_2")
    differ = S.agreement_of(F.col("value_1"), F.col("value_2"), F.col("kind"), (F.col("n_1"), F.col("d_1")), (F.col("n_2"), F.col("d_2"))) == "ocr!=vision"
    pair = [F.least("document_id_1", "document_id_2"), F.greatest("document_id_1", "document_id_2")]
    w = Window.partitionBy("bundle_id", "entity_key", *pair).orderBy("o_1", "o_2")
    return j.where(differ).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("bundle_id", "entity_key", "document_id_1", "document_id_2", "value_1", "value_2")


def value_classes(claims: DataFrame) -> DataFrame:
    """Claims with the class of their value: values of one class agree with the same others.

    Adds kind, cls, num, day and txt (what near values are found by). Values are read once.
    """
    kind = S.field_type(F.col("entity_key"))
    num, day = S.readable(F.col("value"), kind)
    c = claims.where("document_id IS NOT NULL").withColumn("kind", kind).withColumn("num", num).withColumn("day", day).withColumn("txt", S.bare(F.trim("value")))
    cls = (
        F.when(F.col("kind") == "IDENTIFIER", F.concat(F.lit("i:"), F.trim("value")))
        # readable values keep their text: against an unreadable value of the field they are compared as texts
        .when(F.col("num").isNotNull(), F.concat_ws(":", F.lit("n"), F.col("num").cast("string"), "txt")).when(F.col("day").isNotNull(), F.concat_ws(":", F.lit("d"), F.col("day").cast("string"), "txt"))
        .when(F.col("txt") != "", F.concat(F.lit("t:"), F.col("txt"))).otherwise(F.concat(F.lit("r:"), F.trim("value")))
    )
    return c.withColumn("cls", cls)


def _edits(n: F.Column) -> F.Column:
    """Edits that two near texts may be apart, the longer of n letters."""
    return F.greatest(F.when(n >= 5, 2).otherwise(0), F.floor(0.15 * n + 1e-9)).cast("int")


#: Texts of a bundle's entity up to which all meet each other; what is found does not depend on it.
FEW_TEXTS = 64


def near_classes(classes: DataFrame) -> DataFrame:
    """(bundle_id, entity_key, cls_1, cls_2) of different classes that agree, both ways round.

    classes: bundle_id, entity_key, kind, cls, num, day, txt; distinct. Numbers within
    1 meet in neighbouring whole numbers. Texts within k edits meet by a
    partition: cut into k + 1 pieces, one of them has a piece that stands in
    the other, shifted by k at most, so an equi-join finds all and no large group
    is compared in pairs. The few texts of a small group all meet, with the same result.
    """
    keys = ["bundle_id", "entity_key"]
    one = classes.where("num IS NOT NULL").select(*keys, F.col("cls").alias("cls_1"), F.col("num").alias("x"), F.floor("num").cast("bigint").alias("at"))
    two = one.withColumnRenamed("cls_1", "cls_2").withColumnRenamed("x", "y").withColumn("at", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)))
    numbers = one.join(two, [*keys, "at"]).where((F.abs(F.col("x") - F.col("y")) <= 1.0) & (F.col("cls_1") != F.col("cls_2"))).select(*keys, "cls_1", "cls_2")
    days = classes.where("day IS NOT NULL").select(*keys, "cls", "day")
    dates = days.withColumnRenamed("cls", "cls_1").join(days.withColumnRenamed("cls", "cls_2"), [*keys, "day"]).where("cls_1 <> cls_2").select(*keys, "cls_1", "cls_2")  # one date in a few notations
    readable = F.col("num").isNotNull() | F.col("day").isNotNull()
    t = classes.where("kind <> 'IDENTIFIER' AND txt <> ''").select(*keys, "cls", readable.alias("read"), "txt")
    # two readable values are never compared as texts
    t = t.join(t.groupBy(*keys).agg(F.count("*").alias("n_texts"), F.count_if(~F.col("read")).alias("n_free")), keys).where("n_texts > 1 AND n_free > 0")
    few = t.where(F.col("n_texts") <= FEW_TEXTS)
    pair = few.select(*keys, F.col("cls").alias("cls_1"), F.col("txt").alias("t1"), F.col("read").alias("read_1")).join(few.select(*keys, F.col("cls").alias("cls_2"), F.col("txt").alias("t2"), F.col("read").alias("read_2")), keys)
    texts = pair.where("cls_1 < cls_2 AND NOT (read_1 AND read_2)").where(_near_texts()).select(*keys, "cls_1", "cls_2")
    texts = texts.unionByName(_near_by_pieces(t.where(F.col("n_texts") > FEW_TEXTS), keys))
    both = texts.unionByName(texts.select(*keys, F.col("cls_2").alias("cls_1"), F.col("cls_1").alias("cls_2")))
    return numbers.unionByName(dates).unionByName(both).distinct()


def _near_texts() -> F.Column:
    longest, lev = F.greatest(F.length("t1"), F.length("t2")), F.levenshtein("t1", "t2")
    return ((lev <= 2) & (longest >= 5)) | ((longest - lev) / longest >= 0.85)


def _near_by_pieces(t: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cls_1, cls_2) of near texts (keys, cls, txt, read, n_texts, n_free) of large groups.

    All texts are cut, and those that are not readable look for the pieces. Group and
    piece are one hash in the rows that are joined; what meets is compared, its group too.
    """
    t = written(t.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    n = F.length("txt")
    # the longer of a near pair has n letters more at most: k is taken for that length
    k = _edits(F.greatest(n + 2, F.ceil(n * 100 / 85)).cast("int"))
    piece = F.expr("transform(sequence(0, k), i -> struct(n, i, substring(txt, CAST(floor(n * i / (k + 1)) AS INT) + 1, CAST(floor(n * (i + 1) / (k + 1)) AS INT) - CAST(floor(n * i / (k + 1)) AS INT)) AS piece, false AS longer))")
    cut = t.withColumn("n", n).withColumn("k", k).where("k > 0").select(*keys, F.col("id").alias("id_1"), F.col("txt").alias("t1"), F.col("read").alias("read_1"), F.inline(piece))
    probe = t.where("NOT read").select(*keys, F.col("id").alias("id_2"), F.col("txt").alias("t2"), F.inline(_probes("txt", F.col("n_free") < F.col("n_texts"))))
    hashed = lambda df, *cols: df.select(F.xxhash64(*keys, "n", "i", "piece").alias("h"), *cols)
    met = hashed(cut, "id_1", "t1", "read_1").join(hashed(probe, "id_2", "t2", "longer"), "h")
    # a cut text that is longer than the one that looks for it is met only if it is readable: else it looks itself
    met = met.where("id_1 <> id_2 AND (read_1 OR NOT longer)").where(_near_texts()).select("id_1", "id_2").distinct()
    named = lambda i: t.select(F.col("id").alias(f"id_{i}"), F.struct(*keys).alias(f"g_{i}"), F.col("cls").alias(f"cls_{i}"))
    return met.join(named(1), "id_1").join(named(2), "id_2").where("g_1 = g_2").select("g_1.*", "cls_1", "cls_2")


def text_probes(t: str, longer: bool = False) -> list[tuple[int, int, str, bool]]:
    """(n, i, piece, n is beyond its length) by which a text may meet piece i of one of n letters that is near it; longer ones too if asked for.

    If i is the first piece with at most i edits before its end, it is whole, moved by i
    at most from the front, and by k - i at most from the back.
    """

    def edits(n: int) -> int:
        return max(2 if n >= 5 else 0, int(0.15 * n + 1e-9))

    most = lambda n: max(n + 2, -(-n * 100 // 85))
    out, size = {}, len(t)
    for n in range(max(1, size - edits(size)), (most(size) if longer else size) + 1):
        k = edits(most(n))
        for i in range(k + 1 if k else 0):
            at = n * i // (k + 1)
            length = n * (i + 1) // (k + 1) - at
            for shift in range(max(-i, size - n - (k - i), -at), min(i, size - n + (k - i)) + 1):
                if at + shift + length <= size:
                    out[n, i, t[at + shift:at + shift + length], n > size] = None
    return list(out)


_PROBE = [("n", T.IntegerType()), ("i", T.IntegerType()), ("piece", T.StringType()), ("longer", T.BooleanType())]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in _PROBE])))
def _probes(texts: pd.Series, longer: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("n", "i", "piece", "longer"), p)) for p in text_probes(t, bool(x))] for t, x in zip(texts, longer)])


def contradicted(claims: DataFrame) -> DataFrame:
    """(bundle_id, entity_key, document_id, class_id, n_conflicts) of every document with a claim of an entity.

    class_id is the first document with the same set of value classes;
    n_conflicts the other documents of the bundle with a value that contradicts
    one of this document's. It is counted as all documents less those that agree,
    of which there are few: equal sets of classes count once, and only sets whose
    first classes agree are compared, so a bundle of a third of all claims costs
    its agreements and not its square.
    """
    keys = ["bundle_id", "entity_key"]
    rows = written(value_classes(claims).select(*keys, "document_id", "kind", "cls", "num", "day", "txt").distinct(), "claim-classes")
    prof = rows.groupBy(*keys, "document_id").agg(F.sort_array(F.collect_set("cls")).alias("profile"))
    sets = written(prof.groupBy(*keys, "profile").agg(F.count("*").alias("n"), F.min("document_id").alias("class_id")), "claim-sets")
    classes = rows.select(*keys, "kind", "cls", "num", "day", "txt").distinct()
    near = written(near_classes(classes), "near-classes")
    same = sets.select(*keys, F.explode("profile").alias("cls_1")).distinct().withColumn("cls_2", F.col("cls_1"))
    edges = near.unionByName(same.select(*keys, "cls_1", "cls_2"))
    left = sets.select(*keys, F.col("profile").alias("p1"), F.element_at("profile", 1).alias("cls_1"))
    right = sets.select(*keys, F.col("profile").alias("p2"), F.col("n").alias("n2"), F.element_at("profile", 1).alias("cls_2"))
    pairs = left.join(edges, [*keys, "cls_1"]).join(right, [*keys, "cls_2"])
    single = pairs.where("size(p1) = 1 AND size(p2) = 1").select(*keys, "p1", "n2")
    more = pairs.where("size(p1) > 1 OR size(p2) > 1").select(*keys, "p1", "p2", "n2")
    cells = more.select("*", F.explode("p1").alias("cls_1")).select("*", F.explode("p2").alias("cls_2")).join(edges.withColumn("ok", F.lit(1)), [*keys, "cls_1", "cls_2"], "left")
    all_ok = cells.groupBy(*keys, "p1", "p2").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok"), F.max("n2").alias("n2")).where("ok = 1").select(*keys, "p1", "n2")
    agree = single.unionByName(all_ok).groupBy(*keys, F.col("p1").alias("profile")).agg(F.sum("n2").alias("agree"))
    total = sets.groupBy(*keys).agg(F.sum("n").alias("total"))
    # a document with values that contradict each other agrees with none of its own set, itself left out
    own = F.when(F.col("self_ok"), 0).otherwise(1)
    selfs = all_ok_self(sets, edges, keys)
    count = sets.join(total, keys).join(agree, [*keys, "profile"], "left").join(selfs, [*keys, "profile"], "left").withColumn("self_ok", F.coalesce("self_ok", F.lit(True)))
    count = count.select(*keys, "profile", "class_id", (F.col("total") - F.coalesce("agree", F.lit(0)) - own).alias("n_conflicts"))
    return prof.join(count, [*keys, "profile"]).select(*keys, "document_id", "class_id", F.col("n_conflicts").cast("bigint").alias("n_conflicts"))


def all_ok_self(sets: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the classes of a set of several agree among themselves: (keys, profile, self_ok)."""
    many = sets.where("size(profile) > 1").select(*keys, "profile")
    cells = many.select("*", F.explode("profile").alias("cls_1")).select("*", F.explode("profile").alias("cls_2")).join(edges.withColumn("ok", F.lit(True)), [*keys, "cls_1", "cls_2"], "left")
    return cells.groupBy(*keys, "profile").agg(F.min(F.coalesce("ok", F.lit(False))).alias("self_ok"))


def learned_aliases(corrections: DataFrame) -> DataFrame:
    """The last correction of each value, without regard to case; columns seq, original, corrected, spurious.

    Empty values and corrections that change nothing teach nothing.
    """
    o, c = F.trim("original"), F.trim("corrected")
    rows = corrections.where((F.col("original") != "") & (F.col("corrected") != "") & ~F.coalesce("spurious", F.lit(False)) & (o != c))
    return rows.groupBy(F.lower(o).alias("original")).agg(F.max_by(c, "seq").alias("corrected"))


def suppressions(corrections: DataFrame) -> DataFrame:
    kind = F.when(F.contains(F.lower("document_id"), F.lit("payslip")), "payslip").otherwise("generic")
    return corrections.where("spurious").select(kind.alias("document_type"), "field_name").distinct()


def confidence_modifiers(corrections: DataFrame, step: float = 0.05) -> DataFrame:
    """(field_name, modifier) of every field that was ever corrected."""
    return corrections.where("field_name IS NOT NULL").select("field_name", F.lit(step).alias("modifier")).distinct()


def training_summary(corrections: DataFrame) -> DataFrame:
    """One row: corrections, learning events (as an audit counts them), and distinct aliases and suppressions learnt."""
    o, c = F.trim("original"), F.trim("corrected")
    spurious = F.coalesce("spurious", F.lit(False))
    teaches = (F.col("original") != "") & (F.col("corrected") != "") & ~spurious & (o != c)
    kind = F.when(F.contains(F.lower("document_id"), F.lit("payslip")), "payslip").otherwise("generic")
    return corrections.agg(
        F.count("*").alias("total_corrections"), F.count(F.when(teaches, 1)).alias("alias_events"), F.count(F.when(spurious, 1)).alias("suppression_events"),
        F.countDistinct(F.when(teaches, F.lower(o))).alias("learned_aliases"), F.countDistinct(F.when(spurious, F.struct(kind, "field_name"))).alias("learned_suppressions"),
    )


def apply_feedback(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Drop suppressed fields, then put learned values in place of known misreadings."""
    kind = F.when(F.contains(F.lower("document_id"), F.lit("payslip")), "payslip").otherwise("generic")
    sup = suppressions(corrections)
    keep = fields.withColumn("kind", kind).join(
        sup.withColumnRenamed("field_name", "sup_field"), (F.col("field_name") == F.col("sup_field")) & ((F.col("kind") == F.col("document_type")) | (F.col("document_type") == "generic")), "left_anti"
    ).drop("kind")
    al = learned_aliases(corrections).withColumnRenamed("original", "alias_of")
    return keep.join(al, F.lower(F.trim("value")) == F.col("alias_of"), "left").withColumn("value", F.coalesce("corrected", "value")).drop("alias_of", "corrected")
