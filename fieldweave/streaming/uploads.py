"""Uploads as a stream of files: each lands once under a name of its own, and too large ones are refused by their size alone.

The stream lists files and their lengths; a file's bytes are read only once it has been accepted.  A micro-batch first writes down where each of its
uploads goes, then their bytes: if it is cut short, the next run finds what was written down and goes on from there, so
no upload lands twice or takes another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldweave.operators.requests import checked_uploads, upload_targets
from fieldweave.sources.files import listing, with_bytes, write_files

_LANDING = "source string, size bigint, path string, status int, reason string"


def read_uploads(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of files that are dropped into ``inbox``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(inbox)


def judged(batch: DataFrame, root: str, directory: str, max_bytes: int) -> DataFrame:
    """``batch`` (path, length) with ``name``, ``target``, ``status`` and ``reason``; 413 for what is larger than ``max_bytes``."""
    rows = batch.select(F.col("path").alias("source"), F.col("length").alias("size"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(directory).alias("directory"))
    rows, fits = checked_uploads(rows, root), F.col("size") <= max_bytes
    refused = (F.col("status") == 200) & ~fits
    return rows.withColumns({"status": F.when(refused, 413).otherwise(F.col("status")), "reason": F.when(refused, "too_large").otherwise(F.col("reason"))})


def land_batch(batch: DataFrame, batch_id: int, root: str, landings: str, directory: str, max_bytes: int, at: Column) -> None:
    spark = batch.sparkSession
    book = f"{landings}/batch_id={batch_id}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{book}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = judged(batch.select("path", "length"), root, directory, max_bytes)
        there = listing(spark, root).select("path").persist()  # listed once
        placed = upload_targets(rows, there, at, ["source"]).select("source", "size", "path", "status", "reason")
        refused = rows.filter("status <> 200").select("source", "size", F.lit(None).cast("string").alias("path"), "status", "reason")
        placed.unionByName(refused).write.mode("overwrite").parquet(book)
        there.unpersist()
    book_rows = spark.read.schema(_LANDING).parquet(book).filter("status = 200")
    write_files(with_bytes(book_rows, "source").filter("content IS NOT NULL").select(F.col("path").alias("output_path"), "content"), aside=root)


def land_uploads(uploads: DataFrame, root: str, landings: str, checkpoint: str, directory: str = "inputs", max_bytes: int = 64 << 20, at: Column | None = None, available_now: bool = True) -> StreamingQuery:
    """Land a stream of uploads below ``root``/``directory``; ``landings`` gets a row for each, with its path or why it was refused."""
    stamp = F.current_timestamp() if at is None else at
    writer = uploads.writeStream.foreachBatch(lambda batch, batch_id: land_batch(batch, batch_id, root, landings, directory, max_bytes, stamp)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def landed(spark: SparkSession, landings: str) -> DataFrame:
    """(source, size, path, status, reason, batch_id) of all uploads."""
    return spark.read.schema(_LANDING + ", batch_id bigint").option("basePath", landings).parquet(landings)
