"""Incremental loading: new files are read once and land in yearly partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_PROGRESS_KEPT = "spark.sql.streaming.numRecentProgressUpdates"
#: More batches than one run can have; only those that happen take room.
_MOST_BATCHES = 10_000_000


def incremental_year_load(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> int:
    """Append files not seen before to ``target``, partitioned by ``year``.

    The checkpoint remembers what was read, so an interrupted or repeated run
    continues where the last one stopped and never loads a file twice.
    ``transform`` must yield a ``year`` column.  A batch takes at most ``files_per_batch`` files, so a long backlog
    is worked off in bounded steps.  Returns the rows this run wrote: each batch observes its own count, and all
    batches of the run are kept until they are summed.
    """
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )
    rows = transform(stream) if transform else stream
    kept = spark.conf.get(_PROGRESS_KEPT)
    # The setting is read after every batch.
    spark.conf.set(_PROGRESS_KEPT, str(_MOST_BATCHES))
    try:
        query = _started(rows.observe("loaded", F.count(F.lit(1)).alias("rows")), target, checkpoint)
        query.awaitTermination()
    finally:
        spark.conf.set(_PROGRESS_KEPT, kept)
    return sum(p["observedMetrics"]["loaded"]["rows"] for p in query.recentProgress if "loaded" in p["observedMetrics"])


def _started(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("year")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
