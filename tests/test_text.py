"""String expressions against values worked out by hand and against Python's own string methods."""

from __future__ import annotations

import sys

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldweave.functions import text

WHITE = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def values(spark, strings, make):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(strings)], "k int, s string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("s"))).collect()]


def test_white_space_is_all_of_it():
    assert sorted(text.PY_WS) == sorted(WHITE)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from([*WHITE, "a", '"', ";", "-", "1"]), max_size=8), min_size=20, max_size=40))
def test_strip_like_python(spark, strings):
    assert values(spark, strings, text.py_strip) == [s.strip() for s in strings]
    assert values(spark, strings, text.py_lstrip) == [s.lstrip() for s in strings]
    assert values(spark, strings, text.py_rstrip) == [s.rstrip() for s in strings]
    assert values(spark, strings, text.clean_response) == [s.strip().replace('"', "") for s in strings]


def test_normalize_response(spark):
    cases = {
        "  Jane  ": ["Jane"], '"Jane"': ["Jane"], '" Jane "': [" Jane "], "-1": None, '"-1"': None, " -1 ": None, '" -1 "': [" -1 "], "": [""],
        "Mark Smith; Jane Doe": ["Mark Smith", "Jane Doe"], "a ; b": ["a ", "b"], "a;": ["a", ""], ";": ["", ""], "-1; -1": ["-1", "-1"], " x　": ["x"], "\u001cx\u0085": ["x"],
    }
    got = values(spark, list(cases), text.normalize_response)
    assert [r["values"] for r in got] == list(cases.values())
    assert [r["is_plural"] for r in got] == [";" in c for c in cases]
    assert values(spark, [None], text.normalize_response)[0]["values"] is None


def test_humanize(spark):
    cases = {"JobTitle": "Job Title", "first__name": "first name", "PDFName": "PDFName", "a1B": "a1B", "_Lead_": "Lead", "a  b": "a b", "aBcD": "a Bc D"}
    assert values(spark, list(cases), text.humanize) == list(cases.values())


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(list("ab'\"\\\n\t é")), max_size=6), min_size=20, max_size=30))
def test_repr_like_python(spark, strings):
    assert values(spark, strings, text.py_repr) == [repr(s) for s in strings]


def test_stringify(spark):
    rows = spark.createDataFrame([(0, False, ["A"]), (1, False, None), (2, True, ["x", "y"])], "k int, p boolean, v array<string>").orderBy("k")
    assert [r[0] for r in rows.select(text.stringify(F.col("v"), F.col("p"), compat=True)).collect()] == ["A", "None", "['x', 'y']"]
    assert [r[0] for r in rows.select(text.stringify(F.col("v"), F.col("p"))).collect()] == ["A", "", "x; y"]


def test_paths(spark):
    at = F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")
    assert values(spark, ["dir/form.pdf"], lambda s: text.output_path(s, at)) == ["dir/form_20250102_030405_filled.pdf"]
    assert values(spark, ["dir/form.pdf"], text.template_path) == ["dir/form_template.pdf"]
    assert values(spark, ["a/b.c/x.y.pdf", "a/.pdf"], lambda s: text.renamed_on_collision(s, at)) == ["a/b.c/x.y_20250102_030405.pdf", "a/.pdf_20250102_030405"]
    assert values(spark, ["/r/a/b.pdf", "/q/b.pdf"], lambda s: text.relative_to(s, "/r")) == ["a/b.pdf", None]
    assert values(spark, ["a/b.PDF", "pdf", None], text.is_pdf) == [True, False, False]
    assert values(spark, ["  a\\b//  ", "/"], text.normalize_directory) == ["a/b", ""]


def test_small_helpers(spark):
    assert values(spark, [" a, ,b ", None, ""], text.comma_list) == [["a", "b"], [], []]
    sizes = spark.createDataFrame([(0, 512), (1, 1536), (2, 10240), (3, 5 * 1024**3)], "k int, n bigint").orderBy("k")
    assert [r[0] for r in sizes.select(text.format_bytes(F.col("n"))).collect()] == ["512 B", "1.5 KB", "10 KB", "5.0 GB"]
    assert values(spark, ["https://x/y", "in/a b.pdf"], lambda s: text.preview_url(s, "http://h")) == ["https://x/y", "http://h/templates/preview?path=in%2Fa%20b.pdf"]
    bodies = ['{"error":"e","detail":"d"}', '{"detail":[{"msg":"m"}]}', '{"detail":"d"}', '{"raw":"r"}', "oops", "{}", "", None]
    assert values(spark, bodies, text.error_message) == ["e", "m", "d", "r", "oops", "Request failed.", "Request failed.", "Request failed."]
