"""Catalog inserts, PDF reading and writing, client caches and other form operators, on cases worked out by hand."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from fieldweave import schemas
from fieldweave.functions import field_types, text
from fieldweave.operators import extract, fields, prompts, requests, widgets
from fieldweave.plans import pipeline
from fieldweave.sources import catalog, client, pdf

from .test_forms import PDF


def test_inserts_lose_no_row(spark, tmp_path):
    """40,000 submissions under Spark's own settings: ids 1 to 40,000, in order of time."""
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    store.create()
    rows = spark.range(40_000).select(F.lit(2).cast("bigint").alias("template_id"), F.concat(F.lit("text " * 20), F.col("id").cast("string")).alias("input_text"), F.col("id").cast("string").alias("output_pdf_path"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    for advisory in ("64MB", "100KB"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        try:
            store.add_submissions(rows.repartition(7))
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    got = store.submissions().select("id", F.col("output_pdf_path").cast("bigint").alias("k"))
    assert got.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (80_000, 80_000, 1, 80_000)
    assert got.filter("id <> k + 1 AND id <> k + 40001").isEmpty()


def test_upsert_in_place_or_in_front(spark, tmp_path):
    current = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 1), (3, "c", 0, 2)], "id bigint, name string, version int, pos bigint")
    changes = spark.createDataFrame([(2, "B", 1), (8, "new", 2), (9, "newer", 3)], "id bigint, name string, version int")
    got = catalog.upserted_in_place(current, changes, "id", "version", str(tmp_path / "s")).orderBy("pos").collect()
    assert [r["name"] for r in got] == ["newer", "new", "a", "B", "c"]


def test_template_answers(spark):
    rows = spark.createDataFrame([(1, None, None, "a.pdf"), (2, "n", [(0, "f", "date")], None)], f"id bigint, name string, fields {schemas.FIELDS}, pdf_path string")
    counts = spark.createDataFrame([("a.pdf", 5)], "pdf_path string, n_widgets bigint")
    got = {r["id"]: (r["name"], len(r["fields"]), r["pdf_path"], r["field_count"]) for r in catalog.response_of(rows, counts).collect()}
    assert got == {1: ("", 0, "a.pdf", 5), 2: ("n", 1, "", None)}


def test_label_of_long_texts():
    assert field_types.LABELS["long_text"] == "Long Text"


PARENTS = (
    b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
    b"3 0 obj << /Type /Page /Parent 2 0 R /Annots [4 0 R] >> endobj\n"
)


def packed(*objects):
    head = b" ".join(b"%d %d" % (n, sum(len(x) + 1 for _, x in objects[:k])) for k, (n, _) in enumerate(objects)) + b"\n"
    data = zlib.compress(head + b"\n".join(x for _, x in objects))
    return b"9 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n%%%%EOF" % (len(objects), len(head), len(data), data)


def test_object_streams_and_inheritance():
    content = PARENTS + packed((4, b"<< /Subtype /Widget /Parent 5 0 R /Rect [1 2 3 4] >>"), (5, b"<< /T (Town) /Parent 6 0 R >>"), (6, b"<< /FT /Ch >>"))
    (own,) = pdf.annotations_of(content)
    assert (own["t"], own["ft"], own["rect"]) == (None, None, [1, 2, 3, 4])
    (whole,) = pdf.annotations_of(content, inherit=True)
    assert (whole["t"], whole["ft"]) == ("Town", "/Ch")


def test_fail_fast(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    assert not pdf.read_pdfs(spark, str(tmp_path)).first()["readable"]
    with pytest.raises(Exception, match="no readable page"):
        pdf.read_pdfs(spark, str(tmp_path), fail_fast=True).collect()


def test_filled_copies(spark, tmp_path):
    plain = PDF.replace(b"/T (JobTitle)", b"/T (JobTitle) /V (old) /AP << /N 7 0 R >>").replace(b"%%EOF", b"xref\n0 1\n0000000000 65535 f \ntrailer << /Root 1 0 R /Size 6 >>\nstartxref\n10\n%%EOF")
    (tmp_path / "a.pdf").write_bytes(plain)
    files = spark.createDataFrame([("a.pdf", bytearray(plain)), ("b.pdf", bytearray(PDF))], "pdf_path string, content binary")
    filled = spark.createDataFrame([(1, "a.pdf", 0, 0, "Chef (é)"), (1, "a.pdf", 0, 1, None), (2, "b.pdf", 0, 0, "x")], "submission_id bigint, pdf_path string, page int, annot_ix int, value string")
    done = {r["submission_id"]: r for r in pdf.filled_pdfs(files, filled).collect()}
    content = bytes(done[1]["content"])
    assert done[2]["content"] is None and "cross-reference" in done[2]["error"] and done[1]["error"] is None
    assert content.startswith(plain) and b"/Prev 10" in content
    body = pdf._objects(content)[4]
    assert pdf._text(body, b"V") == "Chef (é)" and b"/AP" not in body and b"(old)" not in body
    at = int(content.rsplit(b"startxref", 1)[1].split()[0])
    assert content[at:].startswith(b"xref") and content[int(content[at:].split()[3]) :].startswith(b"4 0 obj")
    assert [a["t"] for a in pdf.annotations_of(content)] == ["JobTitle", "A"]
    out = spark.createDataFrame([(f"file:{tmp_path}/out/x.pdf", bytearray(content))], "output_path string, content binary")
    pdf.write_files(out)
    pdf.write_files(out)
    assert (tmp_path / "out" / "x.pdf").read_bytes() == content and len(list((tmp_path / "out").iterdir())) == 1


def test_every_upload_has_a_path_of_its_own(spark):
    names = [(0, "a.pdf"), (1, "a.pdf"), (2, "a.pdf"), (3, "b.pdf"), (4, "b.pdf"), (5, "c.pdf"), (6, "b_20250102_030405.pdf"), (7, "no.suffix/d"), (8, "no.suffix/d")]
    uploads = spark.createDataFrame(names, "k int, name string").selectExpr("*", "'in' AS target", "200 AS status")
    there = spark.createDataFrame([("in/b.pdf",), ("in/b_20250102_030405_4.pdf",)], "path string")
    got = {r["k"]: r["path"] for r in requests.upload_targets(uploads, there, F.lit("2025-01-02 03:04:05").cast("timestamp_ntz"), ["k"]).collect()}
    stamp = "20250102_030405"
    assert got == {
        0: "in/a.pdf", 1: f"in/a_{stamp}.pdf", 2: f"in/a_{stamp}_2.pdf", 3: f"in/b_{stamp}_5.pdf", 4: f"in/b_{stamp}_6.pdf", 5: "in/c.pdf", 6: f"in/b_{stamp}.pdf", 7: "in/no.suffix/d", 8: f"in/no.suffix/d_{stamp}",
    }
    assert len(set(got.values())) == len(got)


def test_required_parts_of_a_template(spark):
    one = [(0, "f", "date")]
    rows = spark.createDataFrame([("n", "f", "d", one), (" ", "f", "d", one), ("n", None, "d", one), ("n", "f", "", one), ("n", "f", "d", None), ("n", "f", "d", [])], f"name string, filename string, directory string, fields {schemas.FIELDS}")
    assert [r["reason"] for r in requests.checked_templates(rows).collect()] == [None, "name_required", "file_required", "directory_required", "fields_required", "fields_required"]


def test_template_ids_from_one_on(spark):
    subs = spark.createDataFrame([("0", "a"), ("-3", "a"), ("1", "a")], "template_id string, input_text string")
    got = {r["template_id"]: r["reason"] for r in requests.checked_submissions(subs, spark.createDataFrame([(1,)], "id bigint")).collect()}
    assert got == {"0": "template_id_not_positive", "-3": "template_id_not_positive", "1": None}


def test_caches_are_read_tolerantly(spark):
    rows = spark.createDataFrame([(0, '[{"name": "a", "type": "date"}, 5, {"name": 7}, {"type": "odd", "id": 4}]'), (1, '{"a": 1}'), (2, "["), (3, None), (4, "[]")], "k int, j string").orderBy("k")
    got = [[tuple(x) for x in r[0]] for r in rows.select(client.field_rows(F.col("j"))).collect()]
    blank = [("", "string")]
    assert got == [[("a", "date"), ("", "string"), ("", "string")], blank, blank, blank, []]
    got = [[tuple(x) for x in r[0]] for r in rows.select(client.template_rows(F.col("j"))).collect()]
    assert got == [[(None, "a", ""), (None, "", ""), (4, "", "")], [], [], [], []]


def test_transcripts_are_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    assert sorted((r["path"].rsplit("/", 1)[1], r["input_text"]) for r in client.read_transcripts(spark, str(tmp_path)).collect() if r["input_text"]) == [("a.txt", "one\ntwo\n")]


def test_fields_shown_moved_and_counted(spark):
    rows = spark.createDataFrame([(1, [(k, n, t) for k, (n, t) in enumerate([("a", "date"), ("b", "odd"), ("c", "list")])]), (2, []), (3, None)], f"k int, fields {schemas.FIELDS}")
    assert sorted((r["k"], r["pos"], r["field"], r["label"] or "") for r in fields.display_rows(rows, "k").collect()) == [(1, 0, "a", "Date"), (1, 1, "b", "Text"), (1, 2, "c", "List"), (2, 0, "No fields.", ""), (3, 0, "No fields.", "")]
    move = lambda i, j: "".join(f["name"] for f in rows.filter("k = 1").select(fields.moved(F.col("fields"), F.lit(i), F.lit(j))).first()[0])
    assert [move(*x) for x in ((0, 2), (2, 0), (1, 1), (0, 1), (0, 3), (-1, 0))] == ["bca", "cab", "abc", "bac", "abc", "abc"]
    assert [(r["field"], r["step"], r["total"]) for r in fields.with_progress(rows, "k").collect()] == [("a", 1, 3), ("b", 2, 3), ("c", 3, 3)]


def test_submissions_whose_pdf_cannot_be_filled_are_rejected(spark):
    one = [(0, "Email", "email")]
    templates = spark.createDataFrame([(k, "T", one, f"{k}.pdf", None) for k in (1, 2, 3, 4)], schemas.TEMPLATE)
    subs = spark.createDataFrame([(10 + k, k, "a@b.co") for k in (1, 2, 3, 4)] + [(20, 9, "x")], "id bigint, template_id bigint, input_text string")
    ordered = widgets.ordered_widgets(spark.createDataFrame([("1.pdf", 0, 0, "/Widget", "Email", None, "/Tx", [1.0, 2.0])], schemas.WIDGET))
    pdfs = spark.createDataFrame([("1.pdf", True), ("2.pdf", False), ("3.pdf", True)], "pdf_path string, readable boolean")
    done, rejected = pipeline.fill_forms(subs, templates, ordered, pdfs=pdfs)
    assert [(r["submission_id"], r["value"]) for r in done.collect()] == [(11, "a@b.co")]
    assert {(r["id"], r["status"], r["reason"]) for r in rejected.collect()} == {
        (12, 500, "template_pdf_not_readable"), (13, 500, "template_pdf_without_widgets"), (14, 500, "template_pdf_missing"), (20, 404, "unknown_template"),
    }


def test_fan_out_has_no_bound(spark):
    subs = spark.createDataFrame([(1,), (2,)], "id bigint")
    got = pipeline.fan_out(subs, spark.range(12_345))
    assert got.agg(F.count("*"), F.count_distinct("id", "template_id")).first()[:] == (24_690, 24_690) and got.columns == ["id", "template_id"]
    assert pipeline.fan_out(subs, spark.range(0)).isEmpty()


def test_earlier_extractions_stay_as_they_were(spark, tmp_path):
    row = lambda k, t: spark.createDataFrame([(k, "f", "string", t, t)], "submission_id bigint, field string, type string, input_text string, prompt string")

    def ask(prompt):
        raise OSError(prompt)

    first = extract.extract_cached(row(1, "a"), ask, str(tmp_path / "cache"), "v")
    extract.extract_cached(row(2, "b"), ask, str(tmp_path / "cache"), "v").collect()
    assert first.first()["error"] == "OSError: a"


def test_parsed_responses(spark):
    rows = spark.createDataFrame([(0, '{"a": 1}'), (1, ""), (2, None), (3, 'no "json"')], "k int, b string").orderBy("k")
    assert [r[0] for r in rows.select(F.to_json(text.parsed_response(F.col("b")))).collect()] == ['{"a":1}', "{}", "{}", '{"raw":"no \\"json\\""}']


def test_template_columns_beside_submissions(spark):
    subs = spark.createDataFrame([(5, 1), (6, 2)], "sid int, template_id bigint")
    got = prompts.with_template(subs, spark.createDataFrame([(1, "x", 3)], "id bigint, name string, other int"), "name").collect()
    assert [r.asDict() for r in got] == [{"template_id": 1, "sid": 5, "name": "x"}]
