"""Submissions as a stream, each filled exactly once: a micro-batch is one idempotent job known by its batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fieldweave.operators.extract import rule_responses
from fieldweave.plans.fill_job import fill_job


def fill_stream(
    submissions: DataFrame, templates: DataFrame, widgets: DataFrame, files: DataFrame, out: str, checkpoint: str, extractor: Callable[[DataFrame], DataFrame] = rule_responses, available_now: bool = True
) -> StreamingQuery:
    """Fill a stream of submissions below ``out``.

    The checkpoint says which submissions a batch id has, so a batch that was cut short anywhere is run again over the same rows and
    writes the same files and folders; what it had written before is replaced, not added to.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        fill_job(batch, templates, widgets, files, out, batch_id, extractor)

    writer = submissions.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
