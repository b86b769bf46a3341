"""Long-lived state as streams: the registry of uploads, the log of corrections, the audit log.

Each micro-batch is written under its own number, and a repeated one replaces
itself, so a stream that is started again from its checkpoint changes nothing
twice. No watermark: a file is compared with all that arrived before it. The
streams' checkpoints belong into a folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsieve.operators import forensics, trust
from docsieve.sinks.records import audit_rows

REGISTRY = "document_id STRING, seq BIGINT, sha STRING, phashes ARRAY<BIGINT>"
MATCHES = "document_id STRING, matched_document_id STRING, seq BIGINT, match_type STRING, page_number INT, matched_page INT, distance INT, similarity DOUBLE"
CORRECTIONS = "seq BIGINT, document_id STRING, field_name STRING, original STRING, corrected STRING, spurious BOOLEAN"


def _before(spark: SparkSession, path: str, schema: str, epoch: int) -> DataFrame:
    """What was stored by the batches before this one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, epoch BIGINT").parquet(path).where(F.col("epoch") < epoch).drop("epoch")


def reset(spark: SparkSession, path: str) -> None:
    """Forget a store."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def register(uploads: DataFrame, path: str, checkpoint: str, index: bool = True) -> StreamingQuery:
    """Check a stream of uploads (REGISTRY) against all before them and add them to the registry at path.

    path/matches gets MATCHES, path/registry the uploads; index=False only checks.
    An id that comes again replaces its entry and is never matched with itself.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*[c.split()[0] for c in REGISTRY.split(", ")]).persist()
        seen = _before(spark, f"{path}/registry", REGISTRY, epoch)
        last = seen.groupBy("document_id").agg(F.max_by(F.struct("sha", "phashes"), "seq").alias("r"), F.min("seq").alias("seq")).select("document_id", "seq", "r.*")
        found = forensics.duplicate_matches(new, last.unionByName(new))
        found.write.mode("overwrite").parquet(f"{path}/matches/epoch={epoch}")
        if index:
            new.write.mode("overwrite").parquet(f"{path}/registry/epoch={epoch}")
        new.unpersist()

    return uploads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn(corrections: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a stream of CORRECTIONS and learn anew from all of them after each batch: path/aliases and path/suppressions by epoch."""
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/epoch={epoch}")
        log = _before(spark, f"{path}/log", CORRECTIONS, epoch + 1)
        trust.learned_aliases(log).write.mode("overwrite").parquet(f"{path}/aliases/epoch={epoch}")
        trust.suppressions(log).write.mode("overwrite").parquet(f"{path}/suppressions/epoch={epoch}")

    return corrections.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit events, redacted."""
    return audit_rows(events).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
