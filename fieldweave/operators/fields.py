"""Ordered field lists of templates: ingest, validation, expansion.

A template's fields are an array of (pos, name, type), never a map: answers fill widgets by position, so order carries meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.field_types import DEFAULT, label_of, normalize_type
from fieldweave.functions.text import is_blank, py_strip


def fields_from_json(json: Column) -> Column:
    """``{"name": "type", ...}`` as an ordered array; a type that is no string becomes ``string``; null if the JSON is no object.

    Of a repeated key, the first place counts.
    """
    keys = F.array_distinct(F.json_object_keys(json))
    kinds = F.from_json(json, "map<string,variant>")

    def entry(name: Column, pos: Column) -> Column:
        kind = F.element_at(kinds, name)
        text = F.when(F.schema_of_variant(kind) == "STRING", kind.cast("string"))
        return F.struct(pos.cast("int").alias("pos"), name.alias("name"), F.coalesce(text, F.lit(DEFAULT)).alias("type"))

    return F.transform(keys, entry)


def fields_from_rows(rows: DataFrame, key: str, pos: str = "pos", name: str = "name", type_col: str = "type") -> DataFrame:
    """(key, fields) from one row for each field."""
    entry = F.struct(F.col(pos).cast("int").alias("pos"), py_strip(F.col(name)).alias("name"), normalize_type(F.col(type_col)).alias("type"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("fields"))


def in_js_key_order(fields: Column) -> Column:
    """The order in which a JavaScript object lists the same keys: whole numbers first, by value, then the rest as inserted."""
    numeric = lambda f: f["name"].rlike("^(0|[1-9][0-9]{0,8})$")
    numbers = F.array_sort(F.transform(F.filter(fields, numeric), lambda f: F.struct(f["name"].cast("bigint").alias("by"), f.alias("f"))))
    ordered = F.concat(F.transform(numbers, lambda x: x["f"]), F.filter(fields, lambda f: ~numeric(f)))
    return F.transform(ordered, lambda f, i: F.struct(i.cast("int").alias("pos"), f["name"].alias("name"), f["type"].alias("type")))


def explode_fields(templates: DataFrame, *keep: str, fields: str = "fields") -> DataFrame:
    """One row for each field, with its ordinal; templates without fields give none."""
    return templates.select(*keep, F.posexplode(fields).alias("pos", "_f")).select(*keep, "pos", F.col("_f.name").alias("field"), F.col("_f.type").alias("type"))


def field_problems(rows: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(key, problem) for each field list that can't be saved: a blank name, or names that differ in case at most.

    Counted by (key, lower-cased name), so one large list never meets in a single row.
    """
    by = rows.select(key, F.lower(py_strip(F.coalesce(F.col(name), F.lit("")))).alias("_n")).groupBy(key, "_n").agg(F.count("*").alias("_m"))
    marked = by.select(key, F.when(F.col("_n") == "", "blank_name").when(F.col("_m") > 1, "duplicate_name").alias("problem"))
    return marked.filter("problem IS NOT NULL").distinct()


def duplicate_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """(name, n) of names that occur more than once if case and outer white space are ignored."""
    return rows.groupBy(F.lower(py_strip(F.col(name))).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def all_rows_blank(rows: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(key, blank): whether every field row of the key is still blank."""
    return rows.groupBy(key).agg(F.bool_and(is_blank(F.col(name))).alias("blank"))


def display_rows(templates: DataFrame, *keep: str, fields: str = "fields") -> DataFrame:
    """(pos, field, label) of each field as it is shown; a template without fields has one row that says so."""
    rows = templates.select(*keep, F.posexplode_outer(fields).alias("pos", "_f"))
    none = F.col("_f").isNull()
    return rows.select(*keep, F.coalesce("pos", F.lit(0)).alias("pos"), F.when(none, "No fields.").otherwise(F.col("_f.name")).alias("field"), F.when(~none, label_of(F.col("_f.type"))).alias("label"))


def moved(fields: Column, source: Column, target: Column) -> Column:
    """The fields after one is dragged from place ``source`` to ``target`` (both from 0), numbered anew; places outside change nothing."""
    inside = (source >= 0) & (target >= 0) & (source < F.size(fields)) & (target < F.size(fields))
    rest = F.filter(fields, lambda f, i: i != source)
    after = F.concat(F.slice(rest, F.lit(1), target), F.slice(fields, source + 1, F.lit(1)), F.slice(rest, target + 1, F.size(fields)))
    return F.when(inside, F.transform(after, lambda f, i: F.struct(i.cast("int").alias("pos"), f["name"].alias("name"), f["type"].alias("type")))).otherwise(fields)


def with_progress(templates: DataFrame, *keep: str, fields: str = "fields") -> DataFrame:
    """``explode_fields`` with ``step`` (from 1) and ``total``, for showing how far a submission is."""
    rows = templates.withColumn("total", F.size(fields))
    return explode_fields(rows, *keep, "total", fields=fields).withColumn("step", F.col("pos") + 1)
