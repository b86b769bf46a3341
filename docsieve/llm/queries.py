"""Queries of the training-data problems, over the driver's whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from docsieve.llm import history_dedup, language, leakage, name_variants, packing, rank_fusion, record_linkage, survivorship
from docsieve.runtime import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that repeat an earlier accepted one; each batch is checked by itself against the history."""
    return history_dedup.find_repeats(table(spark, sf_dir, "dedup_registry"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving claim of each field of each group of copies."""
    alias = F.broadcast(table(spark, sf_dir, "field_aliases").select("field_name", "entity_key").distinct())  # 60 rows, fixed
    claims = table(spark, sf_dir, "claims").join(alias, "field_name")
    return survivorship.surviving_values(claims, table(spark, sf_dir, "results"))


SIGNALS = ["native_ocr", "agreement_signal", "consistency_signal", "validation_signal"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.one_row_per_item(
        table(spark, sf_dir, "confidence_breakdowns"), ["queue_id", "item_id"], SIGNALS, {"native_ocr": "engine"}, "scored_at"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three least trusted items of each review queue."""
    return rank_fusion.least_by_distance(_items(spark, sf_dir), "queue_id", "item_id", SIGNALS, {"native_ocr": "engine"}, 3)


def p5_median_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median rank aggregation of each queue's items."""
    out = rank_fusion.positions(rank_fusion.median_rank(_items(spark, sf_dir), "queue_id", "item_id", SIGNALS), "queue_id", "item_id")
    return out.select("queue_id", "item_id", "position", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"))


def _eval_items(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    rows = table(spark, sf_dir, "eval_items").select("item_id", "passage").where("passage IS NOT NULL").distinct()
    return sorted((r.item_id, r.passage) for r in rows.collect())  # 420 rows, a fixed table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items."""
    return leakage.leaked(table(spark, sf_dir, "documents"), _eval_items(spark, sf_dir))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate stretch with its measures, before the thresholds."""
    return leakage.leak_spans(table(spark, sf_dir, "documents"), _eval_items(spark, sf_dir))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked spans: length and digest of the text that is left, spans cut."""
    out = leakage.without_leaks(table(spark, sf_dir, "documents"), _eval_items(spark, sf_dir))
    return out.select("doc_id", "n_removed", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing, wrong or too narrow label, and the languages they are written in."""
    docs = table(spark, sf_dir, "documents")
    return language.corrected_labels(docs, language.train(docs))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    docs = table(spark, sf_dir, "documents")
    return language.label_segments(docs, language.train(docs)).withColumn("confidence", F.round("confidence", 6))


def p8_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the confidence can be trusted: against the labels, which are no evidence here."""
    docs = table(spark, sf_dir, "documents")
    return language.calibration(docs, language.train(docs))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of every target filled with whole documents."""
    rows = table(spark, sf_dir, "pack_targets").select("target_id", "capacity_tokens").distinct().collect()  # 3 rows, fixed
    return packing.pack(table(spark, sf_dir, "documents"), sorted((r.target_id, r.capacity_tokens) for r in rows))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, field_name, kind, value of every field that names a vendor or an employee."""
    kinds = F.create_map(*[F.lit(x) for x in ("vendor_name", "organisation", "employee_name", "person", "VendorName", "organisation", "EmployeeName", "person")])
    alias = F.broadcast(table(spark, sf_dir, "field_aliases").where("entity_key IN ('vendor_name', 'employee_name')").select("field_name", "entity_key").distinct())  # fixed
    claims = table(spark, sf_dir, "claims").join(alias, "field_name").select("document_id", "field_name", kinds[F.col("entity_key")].alias("kind"), "value")
    labels = table(spark, sf_dir, "doc_labels").select("document_id", F.explode("fields").alias("field_name", "value")).where("field_name IN ('VendorName', 'EmployeeName')")
    return claims.unionByName(labels.select("document_id", "field_name", kinds[F.col("field_name")].alias("kind"), "value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that mean a registered entity but do not spell its name as registered."""
    named, register = written(_named(spark, sf_dir).where("value IS NOT NULL"), "named"), table(spark, sf_dir, "name_register")
    links = name_variants.link_spellings(named, register)
    known = F.broadcast(register.select("entity_id", "registered_name").distinct())  # fixed
    other = links.join(known, "entity_id").where("value <> registered_name").select("kind", "value", "entity_id")
    return named.join(other, ["kind", "value"]).select("document_id", "field_name", "entity_id").distinct()


def _linkable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    alias = F.broadcast(table(spark, sf_dir, "field_aliases").select("field_name", "entity_key").distinct())  # 60 rows, fixed
    claims = table(spark, sf_dir, "claims").join(alias, "field_name").select("document_id", "field_name", "entity_key", "value")
    parties = claims.where("entity_key IN ('vendor_name', 'customer_name')").select(F.lit("organisation").alias("kind"), "value").distinct()
    return claims, sorted(name_variants.learn(parties, table(spark, sf_dir, "name_register")).organisation)


def p2_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices and orders of one transaction, with confidence."""
    return record_linkage.link_records(*_linkable(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices and orders of one transaction."""
    return p2_linked(spark, sf_dir).select("document_id_1", "document_id_2")


_EDGES, _OMITTED = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", r"[\s\x{00A0}]*(\.{2,}|[…‐-]+)[\s\x{00A0}.…]*$"
_PLACE = ", ".join("'" + x + "'" for x in survivorship.PLACEHOLDERS)
_P4 = f"""WITH who AS (SELECT document_id, group_id, max(processed_at) processed_at FROM results WHERE group_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT DISTINCT field_name, entity_key FROM field_aliases),
x AS MATERIALIZED (SELECT group_id, entity_key, document_id, claim_seq, processed_at,
  lower(regexp_replace(regexp_replace(value, '{_EDGES}', '', 'g'), '{_OMITTED}', '')) v,
  lower(regexp_replace(coalesce(value, ''), '{_EDGES}', '', 'g')) IN ({_PLACE}) OR NOT regexp_matches(coalesce(value, ''), '[\\p{{L}}\\p{{N}}]') blank,
  CASE WHEN confidence >= 0 THEN round(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END, 3) ELSE -1.0 END trust
  FROM claims JOIN a USING (field_name) JOIN who USING (document_id) WHERE entity_key IS NOT NULL),
vals AS (SELECT DISTINCT group_id, entity_key, v FROM x WHERE NOT blank),
cut AS (SELECT DISTINCT p.group_id, p.entity_key, p.v FROM vals p JOIN vals q ON p.group_id = q.group_id AND p.entity_key = q.entity_key AND p.v <> q.v AND starts_with(q.v, p.v)),
r AS (SELECT x.*, row_number() OVER (PARTITION BY group_id, entity_key ORDER BY (NOT blank AND cut.v IS NULL) DESC, trust DESC, processed_at DESC NULLS LAST, document_id DESC, claim_seq) rn,
  min(document_id) OVER (PARTITION BY group_id, entity_key) d1, max(document_id) OVER (PARTITION BY group_id, entity_key) d2
  FROM x LEFT JOIN cut USING (group_id, entity_key, v))
SELECT group_id, entity_key, document_id, claim_seq FROM r WHERE rn = 1 AND d1 <> d2"""
_ITEMS = """it AS (SELECT * FROM (SELECT queue_id, item_id, engine, native_ocr, agreement_signal, consistency_signal, validation_signal, row_number() OVER (PARTITION BY queue_id, item_id
  ORDER BY scored_at DESC NULLS LAST, native_ocr DESC NULLS LAST, agreement_signal DESC NULLS LAST, consistency_signal DESC NULLS LAST, validation_signal DESC NULLS LAST, engine DESC NULLS LAST) rn
  FROM confidence_breakdowns WHERE queue_id IS NOT NULL AND item_id IS NOT NULL) WHERE rn = 1)"""


def _z(c: str, over: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(({c} - avg({c}) OVER ({over})) / nullif(stddev_pop({c}) OVER ({over}), 0), 0) END"


_P5 = f"""WITH {_ITEMS}, z AS (SELECT queue_id, item_id, {_z('native_ocr', 'PARTITION BY engine')} a, {', '.join(f"{_z(c, '')} {n}" for c, n in zip(SIGNALS[1:], 'bcd'))} FROM it),
r AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY coalesce(list_avg(list_filter([a, b, c, d], lambda x: x IS NOT NULL)), 0), item_id) rn FROM z) SELECT queue_id, item_id FROM r WHERE rn <= 3"""


def _r(c: str, n: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY queue_id, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY queue_id, {c}) - 1) / 2.0::double) / count({c}) OVER (PARTITION BY queue_id) END {n}"


_P5M = f"""WITH {_ITEMS}, k AS (SELECT queue_id, item_id, {', '.join(_r(c, n) for c, n in zip(SIGNALS, 'abcd'))} FROM it),
m AS (SELECT queue_id, item_id, list_median(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) m, list_avg(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) n FROM k)
SELECT queue_id, item_id, row_number() OVER (PARTITION BY queue_id ORDER BY round(m, 9) NULLS LAST, round(n, 9) NULLS LAST, item_id) "position", round(m, 6) median_rank, round(n, 6) mean_rank FROM m"""

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_linked, p3_found, p4_found, p5_found, p5_median_rank, p6_packed, p7_found, p7_spans, p7_cleaned, p8_found, p8_segments, p8_calibration)}
SQL: dict[str, str] = {"p4_found": _P4, "p5_found": _P5, "p5_median_rank": _P5M}
