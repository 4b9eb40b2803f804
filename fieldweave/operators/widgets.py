"""Form widgets in the order in which they are filled: by page, top to bottom, left to right, then as annotated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.field_types import from_form_code
from fieldweave.functions.text import humanize, py_strip


def is_widget() -> Column:
    return (F.col("subtype") == "/Widget") & (F.coalesce(F.col("t"), F.lit("")) != "")


def ordered_widgets(annotations: DataFrame) -> DataFrame:
    """Fillable widgets with ``pos`` from 0 for each PDF, ``name``, ``description`` and ``type``.

    A PDF's widgets meet in one task; they are as many as one form has, and forms spread by path.
    """
    name = py_strip(F.coalesce(F.col("t"), F.lit("")))
    order = Window.partitionBy("pdf_path").orderBy("page", F.col("rect")[1].desc(), F.col("rect")[0], "annot_ix")
    widgets = annotations.filter(is_widget()).withColumn("pos", F.row_number().over(order) - 1)
    return widgets.select(
        "pdf_path", "page", "annot_ix", "pos", name.alias("name"), F.coalesce(F.nullif(py_strip(F.col("tu")), F.lit("")), humanize(name)).alias("description"), from_form_code(F.col("ft")).alias("type")
    )


def widget_counts(pdfs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(pdf_path, n_widgets): null for a PDF that could not be read, 0 for one without widgets.  ``pdfs``: (pdf_path, readable)."""
    n = annotations.filter(is_widget()).groupBy("pdf_path").agg(F.count("*").alias("n"))
    return pdfs.join(n, "pdf_path", "left").select("pdf_path", F.when(F.col("readable"), F.coalesce("n", F.lit(0))).alias("n_widgets"))


def count_mismatches(templates: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, n_fields, n_widgets, verdict) comparing what a template declares with what its PDF has."""
    fields = F.coalesce(F.size("fields"), F.lit(0)).cast("bigint")
    joined = templates.select("id", "pdf_path", F.greatest(fields, F.lit(0)).alias("n_fields")).join(counts, "pdf_path", "left")
    verdict = F.when(F.col("n_widgets").isNull(), "unreadable").when(F.col("n_fields") > F.col("n_widgets"), "surplus_fields").when(F.col("n_fields") < F.col("n_widgets"), "surplus_widgets").otherwise("match")
    return joined.select("id", "n_fields", "n_widgets", verdict.alias("verdict"))


def seeded_fields(widgets: DataFrame) -> DataFrame:
    """(pdf_path, fields) to start a template from: each widget's description, or its name."""
    name = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.lit(""))
    return widgets.groupBy("pdf_path").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name"), "type"))).alias("fields"))
