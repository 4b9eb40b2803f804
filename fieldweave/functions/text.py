"""String expressions with the semantics of the form-filling dataflow; built-in functions only.

Every function takes and returns ``Column`` and is null for a null input unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that Python's ``str.strip`` takes for white space.
PY_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

#: The same as a class of a regular expression.
WS_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WS) + "]"


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_WS))


def py_lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(PY_WS))


def py_rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(PY_WS))


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only; never null itself."""
    return F.coalesce(py_strip(text), F.lit("")) == ""


def humanize(name: Column) -> Column:
    """A field name as words: underscores and camel case become spaces, runs of white space one space."""
    spaced = F.regexp_replace(name, "_+", " ")
    spaced = F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2")
    return py_strip(F.regexp_replace(spaced, WS_CLASS + "+", " "))


def clean_response(raw: Column) -> Column:
    """Outer white space goes first, then every double quote; what the quotes held stays as it is."""
    return F.replace(py_strip(raw), F.lit('"'), F.lit(""))


#: Fixed value: what an extractor answers if a text has no value for a field.
NOT_FOUND = "-1"
SEPARATOR = ";"


def is_plural(cleaned: Column) -> Column:
    return F.contains(cleaned, F.lit(SEPARATOR))


def split_plural(cleaned: Column) -> Column:
    """Parts between separators, white space at their left removed; empty parts stay."""
    return F.transform(F.split(cleaned, SEPARATOR, -1), py_lstrip)


def normalize_response(raw: Column) -> Column:
    """Struct (``is_plural``, ``values``): several parts if there is a separator, null for "not found", else one value."""
    cleaned = clean_response(raw)
    many = F.coalesce(is_plural(cleaned), F.lit(False))
    values = F.when(many, split_plural(cleaned)).when(cleaned != NOT_FOUND, F.array(cleaned))
    return F.struct(many.alias("is_plural"), values.alias("values"))


def py_repr(text: Column) -> Column:
    """Python's ``repr`` of a string without control or other unprintable characters: double quotes only if it has a single quote and no double one."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for character, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(character), F.lit(written))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def stringify(values: Column, plural: Column, compat: bool = False) -> Column:
    """What is written into a widget.

    By default parts are joined with ``; `` and null is empty; ``compat`` writes null as ``None`` and several parts as a Python list.
    """
    if not compat:
        return F.when(values.isNull(), "").otherwise(F.array_join(values, "; "))
    listed = F.concat(F.lit("["), F.array_join(F.transform(values, py_repr), ", "), F.lit("]"))
    return F.when(values.isNull(), "None").when(plural, listed).otherwise(F.array_join(values, ""))


def without_suffix(path: Column) -> Column:
    """The path without its last four characters, whatever they are."""
    return F.left(path, F.greatest(F.char_length(path) - 4, F.lit(0)))


def output_path(path: Column, at: Column) -> Column:
    return F.concat(without_suffix(path), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_filled.pdf"))


def template_path(path: Column) -> Column:
    return F.concat(without_suffix(path), F.lit("_template.pdf"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def is_pdf(path: Column) -> Column:
    return F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False))


def renamed_on_collision(path: Column, at: Column) -> Column:
    """``stem_<UTC time>.suffix`` in the same folder."""
    name = basename(path)
    folder = F.left(path, F.char_length(path) - F.char_length(name))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.concat(folder, stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.substr(name, F.char_length(stem) + 1))


def relative_to(path: Column, root: str) -> Column:
    """The part below ``root`` with forward slashes; null if the path lies elsewhere."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    head = root.rstrip("/") + "/"
    return F.when(clean.startswith(head), F.substr(clean, F.lit(len(head) + 1)))


def normalize_directory(path: Column) -> Column:
    """Trimmed, with forward slashes and none at the end."""
    return F.regexp_replace(F.replace(py_strip(path), F.lit("\\"), F.lit("/")), "/+$", "")


def comma_list(text: Column) -> Column:
    """Stripped parts between commas; empty ones go; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), py_strip), lambda x: x != "")


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB by powers of 1024: no decimals for bytes or from ten units on, else one."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)
    whole = F.floor(value + 0.5).cast("bigint").cast("string")
    tenths = F.floor(value * 10 + 0.5).cast("bigint")
    one = F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(F.when((unit == 0) | (value >= 10), whole).otherwise(one), F.lit(" "), name)


def preview_url(path: Column, base: str) -> Column:
    """A web address stays; anything else becomes a query of the preview endpoint."""
    encoded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    return F.when(path.rlike("(?i)^https?://"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/templates/preview?path="), encoded))


def parsed_response(body: Column) -> Column:
    """A response's body as a variant: an empty one is ``{}``, one that is no JSON is ``{"raw": body}``."""
    raw = F.to_json(F.struct(body.alias("raw")))
    return F.parse_json(F.when(F.coalesce(body, F.lit("")) == "", "{}").when(F.try_parse_json(body).isNull(), raw).otherwise(body))


def error_message(body: Column, default: str = "Request failed.") -> Column:
    """The first of ``error``, the first detail's ``msg``, ``detail`` and the raw body; a body that is no JSON is itself the message."""
    value = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    is_json = F.try_parse_json(body).isNotNull()
    plain = F.when(~F.coalesce(F.get_json_object(body, "$.detail"), F.lit("")).rlike(r"^[\[{]"), value("$.detail"))
    return F.coalesce(F.when(is_json, F.coalesce(value("$.error"), value("$.detail[0].msg"), plain, value("$.raw"))), F.when(~F.coalesce(is_json, F.lit(False)), F.nullif(body, F.lit(""))), F.lit(default))
