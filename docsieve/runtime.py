"""Session-level helpers: shared scratch folder, lineage cuts, table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_leaving: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a
    cluster a machine-local path would be lost with its executor.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="docsieve-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder, removed when the application ends."""
    base = f"{scratch_dir(spark)}/docsieve/{spark.sparkContext.applicationId}"
    if base not in _leaving:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _leaving.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder, read it back.

    Survives the loss of executors and, unlike a row checkpoint, is columnar,
    compressed and can be pruned by later readers.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
