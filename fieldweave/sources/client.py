"""What clients keep as JSON text, and transcripts as text files; both are read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.field_types import DEFAULT, normalize_type


def _items(json: Column) -> Column:
    """The objects of a JSON array as variants; null if the text is no JSON array."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _string(item: Column, key: str) -> Column:
    value = F.try_variant_get(item, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def field_rows(json: Column) -> Column:
    """Array of (name, type): what is no object is left out, a name that is no string is empty, an unknown type is the default; one blank row if there is no array."""
    blank = F.array(F.struct(F.lit("").alias("name"), F.lit(DEFAULT).alias("type")))
    rows = F.transform(_items(json), lambda x: F.struct(F.coalesce(_string(x, "name"), F.lit("")).alias("name"), normalize_type(_string(x, "type")).alias("type")))
    return F.coalesce(rows, blank)


def template_rows(json: Column) -> Column:
    """Array of (id, name, pdf_path), with empty strings for what is missing; empty if there is no array."""
    text = lambda x, key: F.coalesce(_string(x, key), F.lit("")).alias(key)
    rows = F.transform(_items(json), lambda x: F.struct(F.try_variant_get(x, "$.id", "bigint").alias("id"), text(x, "name"), text(x, "pdf_path")))
    return F.coalesce(rows, F.array().cast("array<struct<id:bigint,name:string,pdf_path:string>>"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, input_text): each text file below ``path`` is one transcript, whole."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("input_text"))
