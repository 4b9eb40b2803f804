"""Field types: labels only, never enforced on answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field types and their labels.
LABELS = {
    "string": "Text",
    "long_text": "Long Text",
    "number": "Number",
    "date": "Date",
    "time": "Time",
    "email": "Email",
    "phone": "Phone",
    "signature": "Signature",
    "checkbox": "Checkbox",
    "list": "List",
}
#: Field types of a PDF's form fields.
BY_FORM_CODE = {"/Tx": "string", "/Btn": "checkbox", "/Ch": "list", "/Sig": "signature"}
DEFAULT = "string"


def looked_up(key: Column, values: Mapping[str, str], default: str) -> Column:
    """A code table as one CASE expression; null or unknown keys get the default."""
    out: Column | None = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return F.lit(default) if out is None else out.otherwise(default)


def from_form_code(code: Column) -> Column:
    return looked_up(code, BY_FORM_CODE, DEFAULT)


def normalize_type(name: Column) -> Column:
    return looked_up(name, {k: k for k in LABELS}, DEFAULT)


def label_of(name: Column) -> Column:
    return looked_up(name, LABELS, LABELS[DEFAULT])
