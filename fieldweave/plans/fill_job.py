"""A whole fill as one job that can be run again: answers, filled PDFs, then submission rows.

All that a job writes is known by its ``batch_id``: PDFs at paths made of the submissions' ids, rejects and submissions in folders of the batch, which are
written anew if the job is.  Submissions are written last, so a row is there only if its PDF is; a job that is run again after
any of the writes ends with the same files and rows.  ``streaming.fills`` runs it for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.operators.extract import rule_responses
from fieldweave.plans.pipeline import fill_forms
from fieldweave.sources.files import write_files
from fieldweave.sources.pdf import filled_pdfs

_REJECT = "id bigint, template_id string, input_text string, status int, reason string, batch_id bigint"
_DONE = "id bigint, template_id bigint, input_text string, output_pdf_path string, batch_id bigint"


def fill_job(
    submissions: DataFrame, templates: DataFrame, widgets: DataFrame, files: DataFrame, out: str, batch_id: int, extractor: Callable[[DataFrame], DataFrame] = rule_responses, compat: bool = False, match: str = "position"
) -> None:
    """Fill ``submissions`` (id, template_id, input_text), whose ids are distinct, below ``out``: ``pdfs/``, ``rejects/batch_id=..`` and ``submissions/batch_id=..``.

    ``files`` (pdf_path, content) has the templates' PDFs and ``widgets`` their widgets.  A submission is rejected with 4xx for what it asks, and with 500 if its PDF can't be filled.
    """
    rows = submissions.select("id", "template_id", "input_text").withColumn("template_id", F.col("template_id").cast("string"))
    readable = files.select("pdf_path").distinct().withColumn("readable", F.lit(True))
    filled, rejected = fill_forms(rows, templates, widgets, extractor, compat, match, readable)
    staged = f"{out}/_work/batch_id={batch_id}"
    made = filled_pdfs(files, filled.withColumn("value", F.coalesce("value", F.lit(""))))
    path = F.concat(F.lit(f"{out}/pdfs/"), F.col("submission_id").cast("string"), F.lit("_filled.pdf"))
    made.withColumn("output_path", F.when(F.col("error").isNull(), path)).write.mode("overwrite").parquet(staged)
    made = submissions.sparkSession.read.schema("submission_id bigint, pdf_path string, content binary, error string, output_path string").parquet(staged)
    write_files(made.filter("error IS NULL"), aside=f"{out}/pdfs")
    failed = rows.join(made.filter("error IS NOT NULL").select(F.col("submission_id").alias("id"), F.col("error").alias("reason")), "id").withColumn("status", F.lit(500))
    columns = ["id", "template_id", "input_text", "status", "reason"]
    rejected.select(*columns).unionByName(failed.select(*columns)).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
    paths = made.filter("error IS NULL").select(F.col("submission_id").alias("id"), F.col("output_path").alias("output_pdf_path"))
    done = rows.join(paths, "id").select("id", F.col("template_id").cast("bigint").alias("template_id"), "input_text", "output_pdf_path")
    done.write.mode("overwrite").parquet(f"{out}/submissions/batch_id={batch_id}")
    folder = submissions.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(submissions.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def filled_submissions(spark: SparkSession, out: str) -> DataFrame:
    """(id, template_id, input_text, output_pdf_path, batch_id) of all jobs below ``out``."""
    return spark.read.schema(_DONE).option("basePath", f"{out}/submissions").parquet(f"{out}/submissions")


def rejects(spark: SparkSession, out: str) -> DataFrame:
    """(id, template_id, input_text, status, reason, batch_id) of all jobs below ``out``."""
    return spark.read.schema(_REJECT).option("basePath", f"{out}/rejects").parquet(f"{out}/rejects")
