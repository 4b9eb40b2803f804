"""Template and submission tables as Parquet folders below one path.

Both are append-only.  Ids follow the largest id; one writer at a time is assumed, as file tables have no lock.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.schemas import FIELDS, SUBMISSION, TEMPLATE

#: The template that an empty catalog starts with.
SEED_ID, SEED_NAME, SEED_PDF = 2, "Manual Test Template", "src/inputs/file_template_manual.pdf"
SEED_FIELDS = ("Employee's name", "Employee's job title", "Employee's department supervisor", "Employee's phone number", "Employee's email", "Signature", "Date")


def with_ids(rows: DataFrame, after: int, order: list[str], staging: str, name: str = "id") -> DataFrame:
    """``rows`` with ``name`` from ``after`` + 1, in this order.

    Rows are sorted by range and written once to ``staging``, a new folder that all executors share; a row's number is its place in its file
    and the rows in the files before, one count for each file.  So no task gets all rows, and every reading sees the same numbers.
    """
    spark = rows.sparkSession
    rows.orderBy(*order).write.parquet(staging)
    written = spark.read.schema(rows.schema).parquet(staging).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = written.groupBy("_file").count()
    before = counts.select(F.col("_file").alias("_of"), F.coalesce(F.sum("count").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row for each file, of which there are at most as many as shuffle partitions
    return written.join(F.broadcast(before), F.col("_file") == F.col("_of")).withColumn(name, F.col("_at") + F.col("_before") + F.lit(after + 1)).drop("_file", "_at", "_of", "_before")


def by_id(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The row of this key, or none."""
    return rows.filter(F.col(key) == value).limit(1)


def with_defaults(templates: DataFrame) -> DataFrame:
    """Template rows with what a listing shows for missing values: empty strings, no fields."""
    empty = F.array().cast(FIELDS)
    return templates.withColumns({"name": F.coalesce("name", F.lit("")), "pdf_path": F.coalesce("pdf_path", F.lit("")), "fields": F.coalesce("fields", empty)})


def response_of(templates: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, name, pdf_path, fields, field_count) as a created template is answered; ``counts``: (pdf_path, n_widgets), null where the PDF can't be read."""
    joined = with_defaults(templates).join(counts.select("pdf_path", "n_widgets"), "pdf_path", "left")
    return joined.select("id", "name", "pdf_path", "fields", F.col("n_widgets").cast("int").alias("field_count"))


def newest_first(rows: DataFrame, at: str, key: str, n: int | None = None) -> DataFrame:
    """By falling time, then falling id; with ``n`` a top-n that every task cuts first."""
    out = rows.orderBy(F.col(at).desc(), F.col(key).desc())
    return out if n is None else out.limit(n)


def seed_if_empty(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """``seed`` if ``existing`` has no row, else nothing; only one row of it is looked for."""
    probe = existing.limit(1).agg(F.count("*").alias("_rows"))
    return seed.join(probe, F.col("_rows") == 0).drop("_rows")


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key over both tables, by ``version``; at equal versions the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", "_new")


def upserted_in_place(current: DataFrame, changes: DataFrame, key: str, version: str, staging: str, pos: str = "pos", first: str | None = None) -> DataFrame:
    """A list's rows after changes: a key that is there keeps its ``pos``, new ones go before all others, the last to come first.

    A new key comes with its lowest version, or that in column ``first`` of ``changes``: later changes leave it where it is, so changes may be applied in
    any number of steps.  ``current`` has ``pos``; positions say the order and may be negative.
    """
    seen = changes.groupBy(F.col(key).alias("_key")).agg(F.min(first or version).alias("_came"))
    latest = upserted(current.drop(pos), changes.select(*[c for c in current.columns if c != pos]), key, version)
    had = current.select(F.col(key).alias("_key"), pos)
    same = F.col(key).eqNullSafe(F.col("_key"))
    kept = latest.join(had, same)
    fresh = latest.join(had, same, "left_anti").join(seen, same)
    new = with_ids(fresh.drop("_key"), 0, ["_came", key], staging, pos)
    front = current.agg(F.min(pos)).first()[0] or 0
    return kept.select(*current.columns).unionByName(new.withColumn(pos, F.lit(front) - F.col(pos)).select(*current.columns))


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def create(self, now: Column | None = None) -> None:
        """Create both tables if they are not there, and seed an empty template table."""
        for name, schema in (("templates", TEMPLATE), ("submissions", SUBMISSION)):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
        fields = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), F.lit("string").alias("type")) for k, n in enumerate(SEED_FIELDS)])
        at = F.current_timestamp() if now is None else now
        seed = self.spark.range(1).select(F.lit(SEED_ID).cast("bigint").alias("id"), F.lit(SEED_NAME).alias("name"), fields.alias("fields"), F.lit(SEED_PDF).alias("pdf_path"), at.alias("created_at"))
        rows = seed_if_empty(self.templates(), seed)
        if not rows.isEmpty():
            rows.write.mode("append").parquet(f"{self.path}/templates")

    def templates(self) -> DataFrame:
        return self._read("templates", TEMPLATE)

    def submissions(self) -> DataFrame:
        return self._read("submissions", SUBMISSION)

    def _append(self, name: str, schema: str, rows: DataFrame, order: list[str]) -> None:
        table = self._read(name, schema)
        last = table.agg(F.max("id")).first()[0] or 0
        columns = table.columns
        staging = f"{self.path}/_staging-{uuid4().hex}"
        with_ids(rows, last, order, staging).select(*columns).write.mode("append").parquet(f"{self.path}/{name}")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def add_templates(self, rows: DataFrame) -> None:
        """``rows`` (name, fields, pdf_path, created_at)."""
        self._append("templates", TEMPLATE, rows, ["created_at", "name", "pdf_path"])

    def add_submissions(self, rows: DataFrame) -> None:
        """``rows`` (template_id, input_text, output_pdf_path, created_at)."""
        self._append("submissions", SUBMISSION, rows, ["created_at", "template_id"])

    def list_templates(self, n: int | None = None) -> DataFrame:
        """Newest first; ``field_count`` is null in a listing."""
        return newest_first(self.templates(), "created_at", "id", n).withColumn("field_count", F.lit(None).cast("int"))

    def template(self, template_id: int) -> DataFrame:
        """The template of this id, or no row."""
        return by_id(self.templates(), "id", template_id)
