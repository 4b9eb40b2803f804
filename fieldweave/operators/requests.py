"""Checks of requests and paths: every check keeps the rows it rejects, with the reason and the status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.text import basename, is_blank, is_pdf, py_strip, renamed_on_collision


def checked(rows: DataFrame, *checks: tuple[str, int, Column]) -> DataFrame:
    """``rows`` with ``status`` (200, or that of the first check that holds) and ``reason`` (null if none does); checks are (reason, status, failed)."""
    reason, status = F.lit(None).cast("string"), F.lit(200)
    for name, code, failed in reversed(checks):
        hit = F.coalesce(failed, F.lit(True))
        reason, status = F.when(hit, name).otherwise(reason), F.when(hit, code).otherwise(status)
    return rows.withColumns({"status": status, "reason": reason})


def resolved(path: Column, root: str) -> Column:
    """The path below ``root`` with ``.`` and ``..`` worked out, as an absolute path, or as a URI if ``root`` is one; null if it leads outside."""
    store, base = re.fullmatch(r"((?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?)(.*?)/*", root, re.DOTALL).groups()
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))

    def step(done: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(absolute, "/", -1), F.array().cast("array<string>"), step), "/"))
    return F.when((clean == base) | clean.startswith(base + "/"), F.concat(F.lit(store), clean))


def checked_uploads(uploads: DataFrame, root: str, default_directory: str = "inputs") -> DataFrame:
    """``uploads`` (filename, directory) with ``name``, ``target`` folder, ``status`` and ``reason``."""
    given = F.when(F.coalesce(F.col("directory"), F.lit("")) == "", F.lit(default_directory)).otherwise(F.col("directory"))
    rows = uploads.withColumns({"name": basename(F.coalesce(F.col("filename"), F.lit(""))), "target": resolved(py_strip(given), root)})
    return checked(
        rows,
        ("filename_required", 400, F.col("name") == ""),
        ("not_a_pdf", 400, ~is_pdf(F.col("name"))),
        ("directory_required", 400, is_blank(given)),
        ("outside_root", 400, F.col("target").isNull()),
    )


def checked_files(paths: DataFrame, listing: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """``paths`` with ``resolved``, ``status`` and ``reason``; ``listing`` (path) has the files there are."""
    rows = paths.withColumn("resolved", resolved(py_strip(F.col(path_col)), root))
    there = listing.select(F.col("path").alias("resolved"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, "resolved", "left")
    return checked(
        rows,
        ("path_required", 400, is_blank(F.col(path_col))),
        ("outside_root", 400, F.col("resolved").isNull()),
        ("not_found", 404, F.col("_there").isNull()),
        ("not_a_pdf", 400, ~is_pdf(F.col("resolved"))),
    ).drop("_there")


def checked_templates(rows: DataFrame) -> DataFrame:
    """``rows`` (name, filename, directory, fields) with ``status`` and ``reason``: all but the fields' content is required."""
    return checked(
        rows,
        ("name_required", 422, is_blank(F.col("name"))),
        ("file_required", 422, is_blank(F.col("filename"))),
        ("directory_required", 422, is_blank(F.col("directory"))),
        ("fields_required", 422, F.coalesce(F.size("fields"), F.lit(0)) < 1),
    )


def upload_targets(uploads: DataFrame, existing: DataFrame, at: Column, order: list[str]) -> DataFrame:
    """Accepted uploads with the ``path`` to write, each its own.

    Of uploads of one name the first by ``order`` keeps it, unless a file has it already; the others get the time, and a number from 2 on
    where a file or another upload of the batch has that name too.
    """
    wanted = uploads.filter("status = 200").withColumn("_path", F.concat("target", F.lit("/"), "name"))
    taken = existing.select(F.col("path").alias("_path"), F.lit(True).alias("_taken")).distinct()
    rank = F.row_number().over(Window.partitionBy("_path").orderBy(*order))
    rows = wanted.join(taken, "_path", "left").withColumn("_rank", rank - F.when(F.col("_taken"), 0).otherwise(1))  # 0 keeps its name
    rows = rows.withColumn("_new", renamed_on_collision(F.col("_path"), at))
    # the highest number that any file or kept name has for each new name; the plain one is number 1
    names = taken.select("_path").union(rows.filter("_rank = 0").select("_path"))
    plain = F.regexp_replace("_path", r"_([0-9]{1,9})(\.[^./]*)?$", "$2")
    number = F.regexp_extract("_path", r"_([0-9]{1,9})(\.[^./]*)?$", 1).try_cast("bigint")
    used = names.select(F.col("_path").alias("_new"), F.lit(1).cast("bigint").alias("_n")).union(names.select(plain, number)).filter("_n IS NOT NULL").groupBy("_new").agg(F.max("_n").alias("_used"))
    rows = rows.join(used, "_new", "left").withColumn("_k", F.col("_rank") + F.coalesce("_used", F.lit(0)))
    numbered = F.when(F.col("_k") > 1, F.regexp_replace("_new", r"^(.*?)(\.[^./]*)?$", F.concat(F.lit("$1_"), F.col("_k").cast("string"), F.lit("$2")))).otherwise(F.col("_new"))
    return rows.withColumn("path", F.when(F.col("_rank") == 0, F.col("_path")).otherwise(numbered)).drop("_path", "_taken", "_rank", "_new", "_used", "_k")


def checked_submissions(submissions: DataFrame, templates: DataFrame) -> DataFrame:
    """``submissions`` (template_id, input_text) with ``status`` and ``reason``: 422 for a bad request, 404 for an unknown template.

    The text is kept as it came; ``template_id`` may be text.
    """
    number = F.col("template_id").try_cast("bigint")
    known = templates.select(F.col("id").alias("_id"), F.lit(True).alias("_known")).distinct()
    rows = submissions.join(known, number == F.col("_id"), "left")
    return checked(rows, ("template_id_not_a_number", 422, number.isNull()), ("template_id_not_positive", 422, number < 1), ("blank_text", 422, is_blank(F.col("input_text"))), ("unknown_template", 404, F.col("_known").isNull())).drop("_id", "_known")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key has no row in ``parent``."""
    return child.join(parent.select(F.col(parent_key).alias("_key")), F.col(child_key) == F.col("_key"), "left_anti")
