"""Writing intermediate tables to the shared scratch folder.

A long chain of joins and ranks is cut by writing a table and reading it
back.  The folder comes from ``spark.checkpoint.dir`` so that every executor
sees it and a lost executor costs nothing already written.  Only a local
session, which has no cluster to share with, falls back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder of this session."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/hearthline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write ``df`` once to scratch (to ``at`` where given) and return a scan of the written table.

    The result has a short lineage and real file sizes, which lets the
    optimizer choose its later joins from measured rather than guessed sizes.
    The shuffle files of the write go with its end, as nothing but this write
    reads them: every task of every shuffle holds three files of a disk block
    at least, so hundreds of small steps would fill a disk.
    """
    spark = df.sparkSession
    path = at or scratch_path(spark, name)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table below the scratch folder that nothing will read again."""
    if not path.startswith(f"{scratch_root(spark)}/hearthline/"):
        raise ValueError(f"{path} is no scratch table")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
