"""Whole fills as jobs and streams that are run again, and bodies typed on read."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldweave import schemas
from fieldweave.operators import bodies, widgets
from fieldweave.plans import fill_job
from fieldweave.sources import pdf
from fieldweave.streaming import fills, transcripts


@pytest.fixture
def forms(spark):
    rows = [("f.pdf", 0, 0, "Email", None, "/Tx", [1.0, 9.0, 3.0, 4.0]), ("f.pdf", 0, 1, "Phone", None, "/Tx", [1.0, 5.0, 3.0, 4.0])]
    own = spark.createDataFrame(rows, "pdf_path string, page int, annot_ix int, t string, tu string, ft string, rect array<double>")
    templates = spark.createDataFrame([(1, "T", [(0, "Email", "email"), (1, "Phone", "phone")], "f.pdf", None), (2, "T", [(0, "Email", "email")], "none.pdf", None)], schemas.TEMPLATE)
    content = pdf.form_pdfs(own).unionAll(spark.createDataFrame([("bad.pdf", bytearray(b"x"))], "pdf_path string, content binary"))
    return templates, widgets.ordered_widgets(own.withColumn("subtype", F.lit("/Widget"))), content


SUBS = [(k, 1, f"mail {k}@b.co, call 555 12 34 5{k}") for k in range(6)] + [(10, 2, "x"), (11, 1, "  "), (12, 9, "x")]


def state(spark, out: str) -> tuple[list, list, list]:
    done = sorted(tuple(r) for r in fill_job.filled_submissions(spark, out).select("id", "template_id", "input_text", "output_pdf_path").collect())
    refused = sorted(tuple(r) for r in fill_job.rejects(spark, out).select("id", "status", "reason").collect())
    values = pdf.read_values(spark.read.format("binaryFile").load(f"{out}/pdfs").select(F.col("path").alias("pdf_path"), "content"))
    return done, refused, sorted((r["pdf_path"].rsplit("/", 1)[1], r["annot_ix"], r["value"]) for r in values.collect())


def expected(out: str) -> tuple[list, list, list]:
    good = SUBS[:6]
    return (
        [(k, 1, t, f"{out}/pdfs/{k}_filled.pdf") for k, _, t in good],
        [(10, 500, "template_pdf_missing"), (11, 422, "blank_text"), (12, 404, "unknown_template")],
        sorted(x for k, _, _ in good for x in ((f"{k}_filled.pdf", 0, f"{k}@b.co"), (f"{k}_filled.pdf", 1, f"555 12 34 5{k}"))),
    )


def test_a_job_that_is_run_again_changes_nothing(spark, tmp_path, forms):
    subs = spark.createDataFrame(SUBS, "id bigint, template_id bigint, input_text string")
    out = str(tmp_path / "out")
    for _ in range(2):
        fill_job.fill_job(subs, *forms, out, batch_id=0)
        assert state(spark, out) == expected(out)
    assert not (tmp_path / "out/_work/batch_id=0").exists() and len(list((tmp_path / "out/pdfs").iterdir())) <= 2 * 6  # and their checksums, if any


def test_a_stream_that_is_cut_short_anywhere_gives_each_submission_once(spark, tmp_path, forms, monkeypatch):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "template_id", "input_text"), s))) for s in SUBS[n::3]))
    stream = transcripts.read_submissions(spark, str(source), max_files=1)
    run = lambda: fills.fill_stream(stream, *forms, out, checkpoint).awaitTermination()
    own, calls = fill_job.write_files, []

    def lost_after_the_files(*args, **kwargs):
        own(*args, **kwargs)
        calls.append(1)
        if len(calls) == 2:
            raise OSError("driver lost between two writes")

    monkeypatch.setattr(fill_job, "write_files", lost_after_the_files)
    with pytest.raises(Exception, match="driver lost"):
        run()
    assert len(list((tmp_path / "out/submissions").glob("batch_id=*"))) == 1
    run()
    assert state(spark, out) == expected(out) and len(calls) == 4
    run()
    assert state(spark, out) == expected(out) and len(calls) == 4


BODIES = [
    ('{"template_id": 5, "input_text": "a"}', (200, None, None, 5, "a")),
    ('{"template_id": "7", "input_text": " a "}', (200, None, None, 7, " a ")),
    ('{"template_id": 7.0, "input_text": "a", "x": 1}', (200, None, None, 7, "a")),
    ('{"template_id": true, "input_text": "a"}', (200, None, None, 1, "a")),
    ('{"template_id": 7.5, "input_text": "a"}', (422, "template_id", "not_int", None, None)),
    ('{"template_id": [7], "input_text": "a"}', (422, "template_id", "not_int", None, None)),
    ('{"template_id": null, "input_text": "a"}', (422, "template_id", "not_int", None, None)),
    ("{}", (422, "template_id", "missing", None, None)),
    ('{"template_id": 5}', (422, "input_text", "missing", None, None)),
    ('{"template_id": 5, "input_text": 5}', (422, "input_text", "not_string", None, None)),
    ('{"template_id": 5, "input_text": "\\n "}', (422, "input_text", "blank", None, None)),
    ("[1]", (422, "body", "not_object", None, None)),
    ('{"template_id": 5', (422, "body", "not_json", None, None)),
    ("", (422, "body", "not_json", None, None)),
    (None, (422, "body", "not_json", None, None)),
]


def test_bodies_are_typed_on_read(spark):
    rows = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(BODIES)], "k int, body string")
    got = bodies.typed_bodies(rows, bodies.FILL).orderBy("k").select("status", "problem_field", "problem", "template_id", "input_text").collect()
    assert [tuple(r) for r in got] == [want for _, want in BODIES]


def test_other_requests(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"name": "n", "pdf_path": "a.pdf", "fields": {"b": "string", "a": 1}}\n{"name": "", "pdf_path": "a.pdf", "fields": []}\nno\n')
    got = bodies.typed_bodies(bodies.read_bodies(spark, str(tmp_path)), bodies.CREATE_TEMPLATE).select("status", "problem_field", "problem", "name", "fields").collect()
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {(200, None, None, "n"), (422, "fields", "not_dict", None), (422, "body", "not_json", None)}
    assert json.loads(next(r["fields"] for r in got if r["status"] == 200)) == {"b": "string", "a": 1}
    assert [r["status"] for r in bodies.typed_bodies(spark.createDataFrame([('{"pdf_path": "a"}',)], "body string"), bodies.MAKE_FILLABLE).collect()] == [200]
