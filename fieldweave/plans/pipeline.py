"""The whole path from submissions to filled widgets, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.extract import answers, rule_responses
from fieldweave.operators.fill import fill_problems, filled_widgets
from fieldweave.operators.prompts import prompts_for, with_template
from fieldweave.operators.requests import checked_submissions


def extract_answers(submissions: DataFrame, templates: DataFrame, extractor: Callable[[DataFrame], DataFrame] = rule_responses) -> DataFrame:
    """Answers of every field of every submission.  Works on a streaming ``submissions`` too, joined with the static templates."""
    return answers(extractor(prompts_for(submissions, templates)))


LIST = 1000
BROADCAST_TEMPLATES = 1_000_000


def fan_out(submissions: DataFrame, templates: DataFrame) -> DataFrame:
    """Every submission against every template: one row for each pair.

    Template ids are kept in lists of about ``LIST``; a submission is joined with each list by its number and expanded.  The lists go to every task if
    there are at most ``BROADCAST_TEMPLATES`` ids, which are counted.
    """
    n = templates.count()
    n_lists = max(1, -(-n // LIST))
    lists = templates.select(F.pmod(F.xxhash64("id"), F.lit(n_lists)).alias("_list"), F.col("id").cast("bigint").alias("_id")).groupBy("_list").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
    rows = submissions.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_lists - 1).cast("bigint"))))
    joined = rows.join(F.broadcast(lists) if n <= BROADCAST_TEMPLATES else lists, "_list")
    return joined.withColumn("template_id", F.explode("_ids")).drop("_list", "_ids")


def fill_forms(
    submissions: DataFrame, templates: DataFrame, widgets: DataFrame, extractor: Callable[[DataFrame], DataFrame] = rule_responses, compat: bool = False, match: str = "position", pdfs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(filled widgets, rejected submissions with status and reason); a submission whose PDF can't be filled is rejected with 500."""
    judged = checked_submissions(submissions, templates)
    accepted = judged.filter("status = 200").withColumn("template_id", F.col("template_id").cast("bigint"))
    of = with_template(accepted, templates, "pdf_path").select(F.col("id").alias("submission_id"), "pdf_path")
    problems = fill_problems(of, widgets, pdfs).withColumnsRenamed({"submission_id": "id", "reason": "_problem"})
    failed = judged.filter("status = 200").join(problems, "id").withColumns({"status": F.lit(500), "reason": F.col("_problem")}).drop("_problem")
    found = extract_answers(accepted.join(problems, "id", "left_anti"), templates, extractor)
    of = of.join(problems, of["submission_id"] == problems["id"], "left_anti")
    return filled_widgets(of, widgets, found, compat, match), judged.filter("status <> 200").unionByName(failed.select(*judged.columns))
