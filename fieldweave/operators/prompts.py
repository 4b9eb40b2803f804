"""Prompts: a template with ``{field}``, ``{type}`` and ``{text}``, filled by one ``concat``.

The template is cut into segments on the driver, so what is filled in is never searched again: a field named ``{text}`` stays as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import explode_fields

PROMPT = """Read the transcript below and fill in one form field.
Answer with the value alone. If the field's name is plural and there are several values, put ";" between them.
If the transcript doesn't say, answer -1.

Field: {field}
Kind of value: {type}

Transcript: {text}
"""

_PLACE = re.compile(r"\{(field|type|text)\}|\{\{|\}\}")


def build_prompt(field: Column, type_: Column, text: Column, template: str = PROMPT) -> Column:
    """Null values are written as ``None``; ``{{`` and ``}}`` stand for single braces."""
    values = {"field": field, "type": type_, "text": text}
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(values[m[1]], F.lit("None")) if m[1] else F.lit(m[0][0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def with_template(submissions: DataFrame, templates: DataFrame, *columns: str) -> DataFrame:
    """``submissions`` with these columns of their template; which side is small is left to the optimizer's own size check."""
    return submissions.join(templates.select(F.col("id").alias("template_id"), *columns), "template_id")


def prompts_for(submissions: DataFrame, templates: DataFrame, template: str = PROMPT) -> DataFrame:
    """(submission_id, template_id, pos, field, type, input_text, prompt): every field of a submission's template against its whole text.

    Joined by template id before the fields are expanded.
    """
    subs = submissions.select(F.col("id").alias("submission_id"), "template_id", "input_text")
    rows = explode_fields(with_template(subs, templates, "fields"), "submission_id", "template_id", "input_text")
    return rows.withColumn("prompt", build_prompt(F.col("field"), F.col("type"), F.col("input_text"), template))
