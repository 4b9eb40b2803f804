"""The PDF reader and writer on files made by hand: page trees, strings, revisions, cross-reference streams, damage."""

from __future__ import annotations

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldweave.operators import widgets
from fieldweave.sources import files, pdf
from fieldweave.sources.pdf_objects import Document, Name, Reader, Ref, new_file, text_of, unpredicted, written


def widget(name: str, rect=(1, 2, 3, 4), **more) -> dict:
    return {"Subtype": Name("Widget"), "FT": Name("Tx"), "T": name.encode("latin-1"), "Rect": list(rect), **more}


def nested(packed: bool = False) -> bytes:
    """Page 1 is object 4 and stands before page 0, object 3, in no other order than the tree's: 5 holds 4, then the root holds 3."""
    return new_file(
        {
            1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)},
            3: {"Type": Name("Page"), "Annots": [Ref(6, 0)]},
            5: {"Type": Name("Pages"), "Kids": [Ref(4, 0)], "Count": 1},
            2: {"Type": Name("Pages"), "Kids": [Ref(5, 0), Ref(3, 0), Ref(5, 0)], "Count": 2},
            4: {"Type": Name("Page"), "Annots": [Ref(7, 0)]},
            6: widget("second page"),
            7: widget("first page"),
        },
        packed,
    )


def names(content: bytes) -> list[tuple[int, str | None]]:
    return [(a["page"], a["t"]) for a in pdf.annotations_of(content)]


@pytest.mark.parametrize("packed", [False, True])
def test_pages_come_in_the_order_of_the_tree(packed):
    assert names(nested(packed)) == [(0, "first page"), (1, "second page")]
    assert not Document(nested(packed)).rebuilt


def test_strings():
    body = rb"<< /T (Tel (home)) /TU (\050a\)\n\
b\7c\r) /A (x\\) /B <feff00E9> /C (one%two) /D#20E /#46 >>"
    read = Reader(body).read()
    assert text_of(read["T"]) == "Tel (home)" and read["TU"] == b"(a)\nb\x07c\r" and read["A"] == b"x\\" and text_of(read["B"]) == "é" and read["C"] == b"one%two" and read["D E"] == "F"
    assert text_of(b"\x80\x18\xa0") == "•˘€" and text_of(b"\xef\xbb\xbf\xc3\xa9") == "é" and text_of(Name("x")) == "/x" and text_of(None) is None


def test_inline_annotations_and_lists_of_their_own():
    inline = {"Subtype": Name("Widget"), "T": b"in (line)", "Border": [0, 0, [1, 2]], "Rect": [1, 2, 3, 4]}
    content = new_file(
        {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Kids": [Ref(3, 0), Ref(4, 0)]}, 3: {"Type": Name("Page"), "Annots": [inline, Ref(6, 0), None]}, 4: {"Type": Name("Page"), "Annots": Ref(5, 0)}, 5: [inline, Ref(6, 0)], 6: widget("x")}
    )
    assert names(content) == [(0, "in (line)"), (0, "x"), (0, None), (1, "in (line)"), (1, "x")]
    done = pdf.filled_content(content, {(0, 0): "a", (1, 0): "b", (1, 1): "c"})
    assert [(v["page"], v["annot_ix"], v["value"]) for v in pdf.values_of(done)] == [(0, 0, "a"), (0, 1, "c"), (1, 0, "b"), (1, 1, "c")]
    assert names(done) == names(content)


def test_later_revisions_replace_and_delete():
    first = nested()
    again = pdf.filled_content(first, {(1, 0): "one"})
    assert again.startswith(first) and [v["value"] for v in pdf.values_of(again)] == ["one"]
    assert [v["value"] for v in pdf.values_of(pdf.filled_content(again, {(1, 0): "two"}))] == ["two"]
    at = len(again)
    start = Document(again).start
    deleted = again + b"xref\n6 1\n0000000000 00001 f \ntrailer\n<< /Size 8 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (start, at)
    assert names(deleted) == [(0, "first page"), (1, None)] and pdf.values_of(deleted) == []


@pytest.mark.parametrize("packed", [False, True])
def test_filled_copies_have_the_section_that_the_file_has(packed):
    content = nested(packed)
    done = pdf.filled_content(content, {(0, 0): "Ünï (x)", (1, 0): ""})
    document = Document(done)
    assert not document.rebuilt and document.by_stream == packed
    assert done[document.start :].startswith(b"xref") != packed
    assert [v["value"] for v in pdf.values_of(done)] == ["Ünï (x)", ""] and names(done) == names(content)


def test_a_hybrid_file():
    """Objects in a stream that only the table's ``/XRefStm`` leads to."""
    body = written(widget("hidden"))
    stream = zlib.compress(b"9 0 " + body)
    out = b"%PDF-1.5\n"
    places = {}
    for n, value in ((1, {"Type": Name("Catalog"), "Pages": Ref(2, 0)}), (2, {"Kids": [Ref(3, 0)]}), (3, {"Type": Name("Page"), "Annots": [Ref(9, 0)]})):
        places[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, written(value))
    places[8] = len(out)
    out += b"8 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >> stream\r\n%s\nendstream endobj\n" % (len(stream), stream)
    section = len(out)
    out += b"7 0 obj << /Type /XRef /W [1 2 1] /Index [9 1] /Size 10 /Length 4 >> stream\n\x02\x00\x08\x00\nendstream endobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in places.items()) + b"trailer << /Size 10 /Root 1 0 R /XRefStm %d >>\nstartxref\n%d\n%%%%EOF" % (section, at)
    assert names(out) == [(0, "hidden")] and not Document(out).rebuilt
    assert [v["value"] for v in pdf.values_of(pdf.filled_content(out, {(0, 0): "seen"}))] == ["seen"]


def test_damage():
    content = nested()
    assert names(content.replace(b"startxref\n", b"startxref\n9")) == names(content) and Document(content[:-40]).rebuilt
    for bad in (b"", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", nested(True)[:-900], b"%PDF-1.4 1 0 obj " + b"[" * 5000):
        with pytest.raises(ValueError):
            pdf.annotations_of(bad)
    looped = new_file({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Kids": [Ref(2, 0), Ref(3, 0)]}, 3: {"Type": Name("Page"), "Annots": [Ref(4, 0)]}, 4: Ref(4, 0)})
    with pytest.raises(ValueError, match="circle"):
        pdf.annotations_of(looped)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.annotations_of(content.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << >>"))


def test_predicted_rows():
    assert unpredicted(bytes([1, 5, 1, 1, 2, 1, 1, 1, 4, 1, 0, 2, 3, 2, 2, 2]), 15, 3) == bytes([5, 6, 7, 6, 7, 8, 7, 7, 10, 5, 8, 11])
    assert unpredicted(bytes([1, 2, 3, 4]), 2, 2) == bytes([1, 3, 3, 7])


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=20) | st.text(st.characters(min_codepoint=1, max_codepoint=255), max_size=8).map(Name) | st.builds(Ref, st.integers(0, 99), st.integers(0, 9)),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=1, max_size=5), inner, max_size=4),
    max_leaves=12,
)


@settings(deadline=None, max_examples=150)
@given(values)
def test_written_objects_are_read_as_they_were(value):
    assert Reader(written(value) + b" ").read() == value


@settings(deadline=None, max_examples=150)
@given(st.binary(max_size=200), st.integers(0, 600))
def test_no_bytes_raise_anything_else(noise, at):
    content = nested(at % 2 == 0)
    try:
        pdf.annotations_of(content[:at] + noise + content[at + len(noise) :])
    except ValueError:
        pass


def test_fill_goes_into_the_right_widgets(spark):
    """The page order that the tree says decides which answer a widget gets."""
    rows = spark.createDataFrame([("a.pdf", bytearray(nested(True)))], "pdf_path string, content binary")
    ordered = widgets.ordered_widgets(spark.createDataFrame([("a.pdf", *(a[k] for k in ("page", "annot_ix", "subtype", "t", "tu", "ft", "rect"))) for a in pdf.annotations_of(nested(True))], "pdf_path string, page int, annot_ix int, subtype string, t string, tu string, ft string, rect array<double>"))
    filled = ordered.select(F.lit(1).cast("bigint").alias("submission_id"), "pdf_path", "page", "annot_ix", F.concat(F.lit("answer "), F.col("pos").cast("string")).alias("value"))
    (done,) = pdf.filled_pdfs(rows, filled).collect()
    document = Document(bytes(done["content"]))
    assert [(text_of(a["T"]), text_of(a["V"])) for _, _, a, _, _ in document.annotations()] == [("first page", "answer 0"), ("second page", "answer 1")]


def test_forms_made_of_widgets_are_read_as_such(spark):
    rows = [("a.pdf", 0, 0, "T (", None, "/Tx", [1.0, 2.5, 3.0, 4.0]), ("a.pdf", 2, 0, "日本", "tip", "/Ch", [0.0, -1.0, 1.0, 1.0])]
    made = pdf.form_pdfs(spark.createDataFrame(rows, "pdf_path string, page int, annot_ix int, t string, tu string, ft string, rect array<double>"), packed=True)
    assert [(a["page"], a["t"], a["tu"], a["ft"], a["rect"]) for a in pdf.annotations_of(bytes(made.first()["content"]))] == [(r[1], r[3], r[4], r[5], r[6]) for r in rows]


def left(folder) -> list[str]:
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_files_are_there_as_a_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit(f"file://{tmp_path}/out/"), (F.col("id") % 4).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("output_path"), F.when(F.col("id") != 3, F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8")).alias("content"))
    broken = rows.withColumn("content", F.when(F.col("output_path").endswith("/37"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(broken, aside=str(tmp_path / "out"))
    assert left(tmp_path) == []
    files.write_files(rows)
    assert len(left(tmp_path)) == 40 and (tmp_path / "out/1/13").read_bytes() == b"x" * 13 and (tmp_path / "out/3/3").read_bytes() == b""
    files.write_files(rows.withColumn("content", F.encode(F.lit("new"), "utf-8")), replace=False)
    assert (tmp_path / "out/1/13").read_bytes() == b"x" * 13
    files.write_files(rows.withColumn("content", F.encode(F.lit("new"), "utf-8")))
    assert (tmp_path / "out/1/13").read_bytes() == b"new" and len(left(tmp_path)) == 40
    files.write_files(rows.filter("1 = 0"))


def test_a_repeated_task_leaves_one_file(tmp_path):
    """Two attempts of one task write aside; only what the successful one says is moved."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "a")], "content": pa.array([b"whole"], pa.binary())})
    writer = files.WholeFileWriter(str(tmp_path), True)

    def cut_short():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(cut_short())
    message = writer.write(iter([batch]))
    assert not (tmp_path / "a").exists()
    writer.commit([message, None])
    assert left(tmp_path) == ["a"] and (tmp_path / "a").read_bytes() == b"whole"


def test_a_task_that_outlives_its_job_leaves_no_file(tmp_path):
    """Spark aborts a job while other tasks of it still run: one may begin after that, or be between two files."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "a")], "content": pa.array([b"whole"], pa.binary())})
    late, slow = files.WholeFileWriter(str(tmp_path), True), files.WholeFileWriter(str(tmp_path), True)
    late.abort([])
    with pytest.raises(OSError):
        late.write(iter([batch]))

    def aborted_meanwhile():
        yield batch
        slow.abort([])
        yield batch

    with pytest.raises(OSError):
        slow.write(aborted_meanwhile())
    assert list(tmp_path.rglob("*")) == []


def test_annotations_as_a_table_function(spark):
    name = pdf.register_annotations(spark)
    rows = spark.createDataFrame([("a.pdf", bytearray(nested(True))), ("bad.pdf", bytearray(b"x")), ("none.pdf", None)], "pdf_path string, content binary")
    got = spark.sql(f"SELECT f.pdf_path, a.page, a.t, a.rect FROM {{rows}} f, LATERAL {name}(f.content) a", rows=rows).collect()
    assert sorted((r["pdf_path"], r["page"], r["t"], r["rect"]) for r in got) == [("a.pdf", 0, "first page", [1, 2, 3, 4]), ("a.pdf", 1, "second page", [1, 2, 3, 4])]
