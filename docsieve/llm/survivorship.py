"""Problem 4: the best representative of each duplicate group, field by field.

One aggregation per (group, attribute) keeps the maximum of a composite struct
(complete, trust, time, tie-breakers), so nothing is collected or sorted per
group and the maximum combines on the map side: a hot group costs no more than
its rows. Whether a value is only the beginning of another one is found from the
distinct values in sort order: all values between a beginning and its
continuation start with it, so looking at the next one is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.runtime import written

#: What people and extractors write where there is nothing.
PLACEHOLDERS = [
    "-", "--", "---", ".", "?", "??", "???", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown",
    "unreadable", "illegible", "[illegible]", "missing", "tbd", "tba", "xxx", "x", "#n/a", "not available", "not provided",
]

#: Blanks around a value; marks of omission at its end (dots, an ellipsis, a hyphen where a word was broken off).
EDGES, OMITTED = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", r"[\s\x{00A0}]*(\.{2,}|[…‐-]+)[\s\x{00A0}.…]*$"


def bare_value(value: Column) -> Column:
    """The value without surrounding blanks and without marks of omission at its end."""
    v = F.regexp_replace(value, EDGES, "")
    return F.regexp_replace(v, OMITTED, "")


def is_blank(value: Column) -> Column:
    """NULL, blank, only marks, or a placeholder word."""
    v = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), EDGES, ""))
    return v.isin(PLACEHOLDERS) | ~v.rlike(r"[\p{L}\p{N}]")


def trust_share(confidence: Column) -> Column:
    """Confidence as a share to three decimals; per cent is divided; absent or negative is -1."""
    c = F.when(F.isnan(confidence), None).otherwise(confidence)
    c = F.when(c > 1, c / 100).otherwise(c)
    return F.when(c >= 0, F.round(c, 3)).otherwise(F.lit(-1.0))


def _beginnings(values: DataFrame) -> DataFrame:
    """The values (group_id, entity_key, v; distinct) that another value of the same field begins with.

    All values are laid into one sorted order, in ranges, so that a hot field is
    many ranges too. Each looks at the next value; the last of a range at the
    first of the next range, of which there is one row a range.
    """
    key = F.struct("group_id", "entity_key", "v")
    ordered = written(values.repartitionByRange("group_id", "entity_key", "v").withColumn("pid", F.spark_partition_id()), "values")
    heads = ordered.groupBy("pid").agg(F.min(key).alias("head"))
    after = heads.select("pid", F.lead("head").over(Window.orderBy("pid")).alias("head"))
    near = ordered.withColumn("next", F.lead(key).over(Window.partitionBy("pid").orderBy("group_id", "entity_key", "v")))
    near = near.join(F.broadcast(after), "pid").withColumn("next", F.coalesce("next", "head"))
    same = (F.col("next.group_id") == F.col("group_id")) & (F.col("next.entity_key") == F.col("entity_key"))
    return near.where(same & F.startswith(F.col("next.v"), F.col("v"))).select("group_id", "entity_key", "v")


def surviving_values(claims: DataFrame, members: DataFrame) -> DataFrame:
    """The surviving claim of each (group_id, entity_key).

    claims: document_id, claim_seq, entity_key, value, confidence; members:
    document_id, group_id, processed_at. Repeated rows count once. Only fields
    on which two documents of the group have a claim are given. Complete values
    go first, then the trusted, then those processed later (NULL is earliest),
    then the greater document_id, then the lower claim_seq, so ties are settled.
    NULL keys drop the row; empty inputs give no rows.
    """
    who = (
        members.where("group_id IS NOT NULL AND document_id IS NOT NULL")
        .groupBy("document_id", "group_id").agg(F.max("processed_at").alias("processed_at"))
    )
    rows = claims.select("document_id", "claim_seq", "entity_key", "value", "confidence").join(who, "document_id")
    rows = rows.where("entity_key IS NOT NULL").withColumn("v", F.lower(bare_value(F.col("value")))).withColumn("blank", is_blank(F.col("value")))
    values = rows.where("NOT blank").select("group_id", "entity_key", "v").distinct()
    cut = _beginnings(values).withColumn("cut", F.lit(True))
    rows = rows.join(cut, ["group_id", "entity_key", "v"], "left")
    best = F.struct(
        (~F.col("blank") & F.col("cut").isNull()).alias("complete"),
        trust_share(F.col("confidence")).alias("trust"),
        F.coalesce("processed_at", F.lit("0001-01-01").cast("timestamp")).alias("at"),
        F.col("document_id"),
        (-F.col("claim_seq")).alias("neg_seq"),
    )
    return (
        rows.groupBy("group_id", "entity_key")
        .agg(F.max(best).alias("b"), F.min("document_id").alias("d1"), F.max("document_id").alias("d2"))
        .where("d1 <> d2")
        .select("group_id", "entity_key", F.col("b.document_id").alias("document_id"), (-F.col("b.neg_seq")).alias("claim_seq"))
    )
