"""JSON inputs: labels, manifests, corrections, the answers of vision models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "document_type STRING, description STRING, fields MAP<STRING, STRING>"
CORRECTIONS = (
    "document_id STRING, field_name STRING, original_extracted_value STRING, corrected_value STRING, evidence_bbox ARRAY<DOUBLE>, "
    "reviewer_id STRING, timestamp STRING, notes STRING, is_spurious_fp BOOLEAN"
)
DEFAULT_CONFIDENCE, DEFAULT_BOX = 0.90, [0.0, 0.0, 100.0, 30.0]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file: its path and LABELS; a file that is no JSON has NULL fields."""
    return spark.read.schema(LABELS).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())


def labels_long(labels: DataFrame) -> DataFrame:
    """(document_id, field_name, value) of labels with a MAP of fields; repeated rows once."""
    return labels.where("document_id IS NOT NULL").select("document_id", F.explode("fields").alias("field_name", "value")).distinct()


def manifest(pairs: DataFrame, samples: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (sample, label) of a manifest of which both exist. samples, labels: path."""
    have = lambda df, c: df.select(F.col("path").alias(c)).distinct()
    return pairs.join(have(samples, "sample"), "sample", "left_semi").join(have(labels, "label"), "label", "left_semi")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections with what a record may leave out filled in: reviewer, time, notes, no spurious field."""
    c = spark.read.schema(CORRECTIONS).option("multiLine", "true").json(path)
    return c.na.fill({"reviewer_id": "reviewer_01", "timestamp": "", "notes": "", "is_spurious_fp": False})


def vision_fields(answers: DataFrame) -> DataFrame:
    """Fields of a model's answers (document_id, page, response): JSON, perhaps in a code fence.

    One row a field: field_name, value (as text), conf, bbox, raw_text. A value
    may stand alone or in an object; confidence, box and text have defaults. An
    answer that is no JSON object has no fields.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim("response"), r"^```(json)?", ""), r"```$", ""))
    rows = answers.select("document_id", "page", F.explode(F.from_json(clean, "MAP<STRING, STRING>")).alias("field_name", "raw"))
    obj = F.startswith(F.trim("raw"), F.lit("{"))
    part = lambda c: F.get_json_object("raw", f"$.{c}")
    value = F.when(obj, part("value")).otherwise(F.col("raw"))
    box = F.coalesce(F.when(obj, F.from_json(part("bbox"), "ARRAY<DOUBLE>")), F.array(*[F.lit(x) for x in DEFAULT_BOX]))
    return rows.select(
        "document_id", "page", "field_name", value.alias("value"), F.coalesce(F.when(obj, part("confidence").try_cast("double")), F.lit(DEFAULT_CONFIDENCE)).alias("conf"), box.alias("bbox"),
        F.coalesce(F.when(obj, part("raw_text")), value, F.lit("None")).alias("raw_text"), F.lit("path_b_vision").alias("source_path"),
    )
