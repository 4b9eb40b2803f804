"""Request bodies typed on read: JSON text against the fields that a request has, with rejects that name the field.

A body is parsed once, as a variant, so one of the wrong type is seen as such and not as a missing one.  Whole numbers may come as numbers without a
fraction, as text or as booleans, as the service's own models take them; text and objects are taken as such only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.text import is_blank

#: The fields of the requests and their types.
FILL = {"template_id": "int", "input_text": "text"}
CREATE_TEMPLATE = {"name": "string", "pdf_path": "string", "fields": "dict"}
MAKE_FILLABLE = {"pdf_path": "string"}


def _int(value: Column, kind: Column) -> Column:
    text = F.btrim(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,18}(\.0*)?$"), F.regexp_replace(text, r"\..*$", "").try_cast("bigint"))
    fraction = F.try_variant_get(value, "$", "double")
    whole = F.when(fraction == F.floor(fraction), F.try_variant_get(value, "$", "bigint"))
    return F.when(kind == "STRING", number).when(kind == "BOOLEAN", value.cast("boolean").cast("bigint")).when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), whole)


def _typed(value: Column, kind: Column, type_: str) -> Column:
    if type_ == "int":
        return _int(value, kind)
    if type_ == "dict":
        return F.when(kind.startswith("OBJECT"), F.to_json(value))
    return F.when(kind == "STRING", value.cast("string"))


def typed_bodies(rows: DataFrame, fields: Mapping[str, str], body: str = "body") -> DataFrame:
    """``rows`` with each of ``fields`` typed (null in rejects), ``status`` (200 or 422), ``problem_field`` and ``problem``.

    Types are ``int``, ``string``, ``text`` (not blank) and ``dict`` (as JSON text, in the order of its keys).  The first problem in the order of ``fields`` counts;
    a body that is no JSON object is a problem of ``body``.
    """
    parsed = F.try_parse_json(F.col(body))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    values = {name: F.try_variant_get(parsed, f"$['{name}']", "variant") for name in fields}
    kinds = {name: F.schema_of_variant(value) for name, value in values.items()}
    typed = {name: _typed(values[name], kinds[name], type_) for name, type_ in fields.items()}
    where, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, type_ in reversed(fields.items()):
        checks = [(values[name].isNull(), "missing"), (typed[name].isNull(), f"not_{'string' if type_ == 'text' else type_}")]
        if type_ == "text":
            checks.append((is_blank(typed[name]), "blank"))
        for failed, problem in reversed(checks):
            where, what = F.when(failed, name).otherwise(where), F.when(failed, problem).otherwise(what)
    where, what = F.when(~is_object, body).otherwise(where), F.when(parsed.isNull(), "not_json").when(~is_object, "not_object").otherwise(what)
    judged = rows.withColumns({"problem_field": where, "problem": what})
    ok = F.col("problem").isNull()
    return judged.withColumns({"status": F.when(ok, 200).otherwise(422), **{name: F.when(ok, column) for name, column in typed.items()}})


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(body) from files of one JSON body in each line; lines that are no JSON are kept."""
    return spark.read.text(path).select(F.col("value").alias("body"))
