"""A list kept up to date from a stream of changes, equal to one upsert of all changes however the stream is cut into batches.

The stream's state is one row for each key that changed: its latest row and its first version, which says where a new key goes.  Both are aggregates that
Spark merges before the shuffle, so a hot key costs a row for each task.  Each micro-batch writes the keys that it changed under its batch id; a batch that
is run again replaces what it had written.  Late changes are taken: an older version than the state's changes nothing but, perhaps, the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from fieldweave.sources.catalog import upserted_in_place

_FIRST = "_first"


def latest_changes(changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: that of the highest ``version``, with the lowest as ``_first``; of equal versions the one whose other values are higher, so that order plays no part."""
    others = [c for c in changes.columns if c not in (key, version)]
    rows = changes.groupBy(key).agg(F.max(F.struct(version, *others)).alias("_row"), F.min(version).alias(_FIRST))
    return rows.select(key, "_row.*", _FIRST)


def upsert_stream(changes: DataFrame, key: str, version: str, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the keys that each micro-batch changes to ``log``; the checkpoint has the state of all keys."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    writer = latest_changes(changes, key, version).writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def logged_changes(spark: SparkSession, log: str, schema: StructType, key: str, version: str) -> DataFrame:
    """What ``log`` has last for each key, with ``_first``; ``schema`` is that of the changes."""
    full = StructType([*schema.fields]).add(_FIRST, schema[version].dataType).add("batch_id", LongType())
    rows = spark.read.schema(full).option("basePath", log).parquet(log)
    kept = [c for c in rows.columns if c not in (key, "batch_id")]
    return rows.groupBy(key).agg(F.max(F.struct("batch_id", *kept)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in kept])


def upserted_list(current: DataFrame, log: str, schema: StructType, key: str, version: str, staging: str, pos: str = "pos") -> DataFrame:
    """``current`` after all that ``upsert_stream`` has written, as ``upserted_in_place`` would have it."""
    changes = logged_changes(current.sparkSession, log, schema, key, version)
    return upserted_in_place(current, changes, key, version, staging, pos, first=_FIRST)
