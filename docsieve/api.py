"""The service's answers as queries: each is a DataFrame over the engine's relations, for whatever serves them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators import trust
from docsieve.sinks import records as sinks


def documents(results: DataFrame) -> DataFrame:
    """All documents (document_id, document_type), each once."""
    return results.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max("document_type").alias("document_type"))


def document(records: DataFrame, document_id: str) -> DataFrame:
    """One document's record (document_id, json) of ``sinks.result_json``; no row if there is none (404)."""
    return records.where(F.col("document_id") == document_id)


def evaluation_summary(outcomes: DataFrame) -> DataFrame:
    """One row, one JSON."""
    return sinks.evaluation_json(outcomes)


def corrections(log: DataFrame) -> DataFrame:
    """The corrections as they were recorded."""
    cols = ["document_id", "field_name", F.col("original_extracted_value").alias("original_value"), "corrected_value", "reviewer_id", "timestamp", "notes", "is_spurious_fp"]
    return log.select(*cols)


def submit(correction: DataFrame, path: str) -> DataFrame:
    """Record corrections (``records.CORRECTIONS``) in the log at path and learn from all of it: one row of what was learnt."""
    from docsieve.sources.records import read_corrections

    sinks.append_corrections(correction, path)
    log = read_corrections(correction.sparkSession, path)
    return trust.training_summary(log.select("document_id", "field_name", F.col("original_extracted_value").alias("original"), F.col("corrected_value").alias("corrected"), F.col("is_spurious_fp").alias("spurious")))
