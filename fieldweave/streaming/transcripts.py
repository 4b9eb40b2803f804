"""Transcripts as a stream of files: each is extracted once against the template catalog as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldweave.plans.pipeline import extract_answers
from fieldweave.schemas import SUBMISSION


def read_submissions(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of JSON submissions dropped into a folder; ``max_files`` bounds one micro-batch."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", max_files).json(path)


def write_answers(submissions: DataFrame, templates: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the answers of a stream to a Parquet folder; the checkpoint makes each file count once."""
    writer = extract_answers(submissions, templates).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)
