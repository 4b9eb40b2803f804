"""Form widgets of PDF files, and filled copies of them.

Files are read with Spark's ``binaryFile`` source and parsed in Arrow batches by ``pdf_objects``.  A field's own ``/T`` and ``/FT`` count, or with
``inherit`` those of its parents where it has none.  What can't be read gives a row that is not readable, with an empty list of annotations, and
stops no other file, or with ``fail_fast`` an error.

``filled_pdfs`` writes values by an incremental update: the file stays as it is, and the widgets' objects follow anew with ``/V`` set and without
``/AP``, so that viewers draw them again, with a cross-reference table or stream as the file has; files without either, and encrypted ones, give a row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.schemas import WIDGET

from .files import write_files  # noqa: F401  the sink of filled copies
from .pdf_objects import Document, Name, Reader, Ref, new_file, parsing, text_of, written

_ANNOTATION = "array<struct<page:int,annot_ix:int,subtype:string,t:string,tu:string,ft:string,rect:array<double>>>"


def _text(body: bytes, key: bytes) -> str | None:
    """A text of the dictionary that ``body`` holds."""
    return text_of(Reader(body).read().get(key.decode()))


def _objects(content: bytes) -> dict[int, bytes]:
    """All objects of a file as they would be written, but for streams."""
    document = Document(content)
    values = {n: document.get(Ref(n, 0)) for n in document.entries}
    return {n: written(v) for n, v in values.items() if v is not None and not isinstance(v, tuple)}


def _inherited(document: Document, annotation: dict, key: str) -> object:
    """The value of the field itself or of the nearest parent that has one."""
    field, seen = annotation, 0
    while (value := document.get(field.get(key))) is None and seen < 100:
        field, seen = document.get(field.get("Parent")), seen + 1
        if not isinstance(field, dict):
            return None
    return value


def _numbers(document: Document, value: object) -> list[float] | None:
    items = document.get(value)
    numbers = [document.get(x) for x in items] if isinstance(items, list) else []
    return [float(x) for x in numbers] if numbers and all(isinstance(x, (int, float)) for x in numbers) else None


@parsing()
def annotations_of(content: bytes, inherit: bool = False) -> list[dict]:
    """Annotations of all pages in page order; raises ValueError if there is no page to be read."""
    document, out = Document(content), []
    for page, k, a, _, _ in document.annotations():
        own = lambda key: document.get(a.get(key))  # noqa: B023, E731
        t, ft = (_inherited(document, a, "T"), _inherited(document, a, "FT")) if inherit else (own("T"), own("FT"))
        name = lambda v: f"/{v}" if isinstance(v, Name) else None
        out.append({"page": page, "annot_ix": k, "subtype": name(own("Subtype")), "t": text_of(t), "tu": text_of(own("TU")), "ft": name(ft), "rect": _numbers(document, a.get("Rect"))})
    return out


@parsing()
def values_of(content: bytes) -> list[dict]:
    """(page, annot_ix, value) of all annotations that have a value."""
    document = Document(content)
    found = [(page, k, text_of(document.get(a.get("V")))) for page, k, a, _, _ in document.annotations()]
    return [{"page": page, "annot_ix": k, "value": value} for page, k, value in found if value is not None]


def read_values(files: DataFrame) -> DataFrame:
    """(pdf_path, page, annot_ix, value) of ``files`` (pdf_path, content); a file that can't be read is an error."""
    kind = pa.list_(pa.struct([("page", pa.int32()), ("annot_ix", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values_of(c) for c in batch.column(1).to_pylist()], kind)], ["pdf_path", "found"])

    found = files.select("pdf_path", "content").mapInArrow(run, "pdf_path string, found array<struct<page:int,annot_ix:int,value:string>>")
    return found.select("pdf_path", F.explode("found").alias("v")).select("pdf_path", "v.*")


@parsing()
def filled_content(content: bytes, values: dict[tuple[int, int], str]) -> bytes:
    """The file with the values of its widgets, which are known by page and place; raises ValueError where it can't be updated."""
    document, changed = Document(content), {}
    if document.start is None or "Size" not in document.trailer:
        raise ValueError("no cross-reference table or stream")
    for page, k, annotation, owner, value in document.annotations():
        if (page, k) in values:
            if owner is None or not annotation:
                raise ValueError(f"annotation {k} of page {page} is no object that can be written anew")
            annotation.pop("AP", None)
            annotation["V"] = b"\xfe\xff" + values[page, k].encode("utf-16-be", "surrogatepass")
            changed[owner.number] = value
    return document.updated(changed)


def read_pdfs(spark: SparkSession, path: str, fail_fast: bool = False, inherit: bool = False) -> DataFrame:
    """(pdf_path, readable, annotations) of all ``.pdf`` files below ``path``, whatever the suffix's case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("pdf_path"), "content")
    files = files.filter(F.lower("pdf_path").endswith(".pdf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("page", pa.int32()), ("annot_ix", pa.int32()), ("subtype", pa.string()), ("t", pa.string()), ("tu", pa.string()), ("ft", pa.string()), ("rect", pa.list_(pa.float64()))]))
        for batch in batches:
            found: list[list[dict] | None] = []
            for content in batch.column(1).to_pylist():
                try:
                    found.append(annotations_of(content or b"", inherit))
                except ValueError:
                    if fail_fast:
                        raise
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f is not None for f in found]), pa.array([f or [] for f in found], kind)], ["pdf_path", "readable", "annotations"])

    return files.mapInArrow(run, f"pdf_path string, readable boolean, annotations {_ANNOTATION}")


class PdfAnnotations:
    """Table function of a file's bytes: a row for each annotation, one at a time, so no array of all is made; none for a file that can't be read."""

    def eval(self, content: bytes):
        try:
            found = annotations_of(bytes(content or b""))
        except ValueError:
            return
        for a in found:
            yield a["page"], a["annot_ix"], a["subtype"], a["t"], a["tu"], a["ft"], a["rect"]


def register_annotations(spark: SparkSession, name: str = "pdf_annotations") -> str:
    """For SQL: ``SELECT f.pdf_path, a.* FROM files f, LATERAL pdf_annotations(f.content) a``."""
    kinds = ", ".join(part for part in WIDGET.split(", ") if not part.startswith("pdf_path"))
    spark.udtf.register(name, F.udtf(PdfAnnotations, returnType=kinds, useArrow=True))
    return name


def widgets_of(pdfs: DataFrame) -> DataFrame:
    """One row for each annotation of ``read_pdfs``, as in ``schemas.WIDGET``."""
    names = [part.split()[0] for part in WIDGET.split(", ")]
    return pdfs.select("pdf_path", F.explode("annotations").alias("a")).select("pdf_path", "a.*").select(*names)


def filled_pdfs(files: DataFrame, filled: DataFrame) -> DataFrame:
    """(submission_id, pdf_path, content, error) of the filled copies.

    ``files``: (pdf_path, content); ``filled``: (submission_id, pdf_path, page, annot_ix, value), as many for a submission as its form has widgets.
    """
    own = filled.filter("value IS NOT NULL").groupBy("submission_id", "pdf_path").agg(F.collect_list(F.struct("page", "annot_ix", "value")).alias("values"))
    rows = own.join(files.select("pdf_path", "content"), "pdf_path").select("submission_id", "pdf_path", "content", "values")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple[bytes | None, str | None]] = []
            for content, values in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                try:
                    done.append((filled_content(content, {(v["page"], v["annot_ix"]): v["value"] for v in values}), None))
                except ValueError as e:
                    done.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], ["submission_id", "pdf_path", "content", "error"])

    return rows.mapInArrow(run, f"submission_id {types['submission_id']}, pdf_path string, content binary, error string")


def new_form(fields: list[dict], packed: bool = False) -> bytes:
    """A form with these widgets (page, t, tu, ft, rect), in this order; ``packed``: with an object stream and a cross-reference stream."""
    pages = max((f["page"] for f in fields), default=0) + 1
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3 + p, 0) for p in range(pages)], "Count": pages}}
    text = lambda value: b"\xfe\xff" + value.encode("utf-16-be", "surrogatepass")
    own: list[list[Ref]] = [[] for _ in range(pages)]
    for k, f in enumerate(fields):
        widget = {"Type": Name("Annot"), "Subtype": Name("Widget"), "T": text(f["t"]), "FT": Name(f["ft"].lstrip("/")), "Rect": [float(x) for x in f["rect"]]}
        objects[3 + pages + k] = widget | ({"TU": text(f["tu"])} if f.get("tu") else {})
        own[f["page"]].append(Ref(3 + pages + k, 0))
    for p in range(pages):
        objects[3 + p] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Annots": own[p]}
    return new_file(objects, packed)


def form_pdfs(widgets: DataFrame, packed: bool = False) -> DataFrame:
    """(pdf_path, content): a form for each ``pdf_path`` of ``widgets`` (pdf_path, page, annot_ix, t, tu, ft, rect), whose widgets are as many as one form has."""
    entry = F.struct("page", "annot_ix", "t", "tu", "ft", "rect")
    forms = widgets.groupBy("pdf_path").agg(F.array_sort(F.collect_list(entry)).alias("fields"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([new_form(f, packed) for f in batch.column(1).to_pylist()], pa.binary())], ["pdf_path", "content"])

    return forms.mapInArrow(run, "pdf_path string, content binary")
