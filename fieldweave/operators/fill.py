"""Answers into widgets: by position as the forms are filled, or by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.text import humanize, stringify


def positional_fill(widgets: DataFrame, answers: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Widgets with the answer of the same ordinal, all of a key's widgets kept.

    Surplus widgets stay untouched (null), surplus answers go; a null answer takes its widget's turn.  One equi-join on (key, ordinal).
    """
    return widgets.join(answers, [*key, pos], "left")


def filled_widgets(submissions: DataFrame, widgets: DataFrame, answers: DataFrame, compat: bool = False, match: str = "position") -> DataFrame:
    """(submission_id, pdf_path, page, annot_ix, pos, name, filled, value) for each widget of each submission's PDF.

    ``submissions`` has (submission_id, pdf_path); ``answers`` has (submission_id, pos, field, is_plural, values).  ``match="name"`` joins on the
    humanised names, ignoring case, instead of the ordinal; of several fields with one name the first is used.
    """
    of = submissions.select("submission_id", "pdf_path").join(widgets, "pdf_path")
    given = answers.select("submission_id", "pos", "field", "is_plural", "values", F.lit(True).alias("_given"))
    if match == "position":
        joined = positional_fill(of, given.drop("field"), ["submission_id"])
    elif match == "name":
        key = F.lower(humanize(F.col("field")))
        first = given.groupBy("submission_id", key.alias("_name")).agg(F.min_by(F.struct("is_plural", "values", "_given"), "pos").alias("_a")).select("submission_id", "_name", "_a.*")
        joined = of.withColumn("_name", F.lower(humanize(F.col("name")))).join(first, ["submission_id", "_name"], "left")
    else:
        raise ValueError(f"unknown match {match}")
    filled = F.coalesce(F.col("_given"), F.lit(False))
    value = F.when(filled, stringify(F.col("values"), F.col("is_plural"), compat))
    return joined.select("submission_id", "pdf_path", "page", "annot_ix", "pos", "name", filled.alias("filled"), value.alias("value"))


def surplus(widgets: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_widgets, n_answers, unfilled, dropped) for each key on either side."""
    w = widgets.groupBy(*key).agg(F.count("*").alias("n_widgets"))
    a = answers.groupBy(*key).agg(F.count("*").alias("n_answers"))
    both = w.join(a, key, "full").na.fill(0, ["n_widgets", "n_answers"])
    more = lambda x, y: F.greatest(F.col(x) - F.col(y), F.lit(0))
    return both.withColumns({"unfilled": more("n_widgets", "n_answers"), "dropped": more("n_answers", "n_widgets")})


def fill_rate(answers: DataFrame, *by: str) -> DataFrame:
    """(by, n, found, rate): how often a value was found."""
    return answers.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("values").isNotNull()).alias("found")).withColumn("rate", F.col("found") / F.col("n"))


def fill_problems(submissions: DataFrame, widgets: DataFrame, pdfs: DataFrame | None = None) -> DataFrame:
    """(submission_id, reason) of submissions whose PDF can't be filled: missing, not readable, or without widgets.

    ``submissions``: (submission_id, pdf_path); ``pdfs``: (pdf_path, readable) of the files there are, without which a PDF counts as there and readable.
    """
    rows = submissions.select("submission_id", "pdf_path").join(widgets.select("pdf_path", F.lit(True).alias("_any")).distinct(), "pdf_path", "left")
    if pdfs is None:
        rows = rows.withColumn("_readable", F.lit(True))
    else:
        rows = rows.join(pdfs.select("pdf_path", F.col("readable").alias("_readable")), "pdf_path", "left")
    reason = F.when(F.col("_readable").isNull(), "template_pdf_missing").when(~F.col("_readable"), "template_pdf_not_readable").when(F.col("_any").isNull(), "template_pdf_without_widgets")
    return rows.select("submission_id", reason.alias("reason")).filter("reason IS NOT NULL")
