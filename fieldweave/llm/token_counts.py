"""Delta-maintained rollups of token counts by source, language and tokenizer version.

A change is a signed document: +1 for an insert, -1 for a delete, and a revision is the old text at -1 with the new one at +1.  A
batch of changes is counted once and summed by key; only these sums are stored, as one partition of the ledger
(``batch_id=...``).  Totals are the sums over all committed batches, so they are additive and no text is read again.

Batches are immutable and commits idempotent: a batch is written aside and renamed into place, so it is there as a whole or not at all;
committing its id again (after a lost driver, say) changes nothing and counts nothing anew.  ``compact`` writes the sums of all batches with
the ids of those that they stand for as one more batch, which is renamed into place in the same way; from then on the ones that it names are not read, whether
or not their folders are deleted yet, and their ids can't be committed again.  One writer is assumed, and a file system that renames a folder at once.

Defined results: null or empty texts count as documents without tokens; null sources and languages are keys of their own; repeated
rows count as often as they come; keys whose documents fall to none stay with zeros; other columns are not read; an empty
batch is committed as such.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from urllib.parse import quote, unquote
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe
from .textblocks import blocks

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
_LEDGER = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_chars bigint, batch string, members array<string>"
#: The version name whose tokens are words ``[^\x20\x09-\x0D]+``; it needs no vocabulary.
WORDS = "words"


def count_tokens(docs: DataFrame, versions: Mapping[str, str | None], source_col: str = "source", lang_col: str = "lang", text_col: str = "text", sign_col: str | None = None) -> DataFrame:
    """(source, lang, tokenizer_version, sign, n_tokens, n_chars) for each document and version; ``versions`` maps names to vocabulary files."""
    names = sorted(versions)
    sign = F.col(sign_col).cast("int") if sign_col else F.lit(1)
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), sign.alias("sign"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("bigint").alias("n_chars"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for name in names:
                tokens = np.zeros(n, np.int64)
                if versions[name] is None:
                    for block in blocks(batch.column(4)):
                        tokens[block.first : block.first + block.n_docs] = block.n_words()
                else:
                    for first, _, bounds in Bpe.of(versions[name], True).ids(text.as_py() for text in batch.column(4)):
                        tokens[first : first + len(bounds) - 1] = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * n, pa.string()), batch.column(2), pa.array(tokens), batch.column(3)], ["source", "lang", "tokenizer_version", "sign", "n_tokens", "n_chars"])

    return rows.mapInArrow(run, "source string, lang string, tokenizer_version string, sign int, n_tokens bigint, n_chars bigint")


def deltas(counted: DataFrame) -> DataFrame:
    """Signed sums by key."""
    return counted.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"))


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: DataFrame | None = None, old: str = "old_text", new: str = "text") -> DataFrame:
    """Signed documents (source, lang, text, sign); ``revised`` has both texts."""
    parts = []
    for df, sign, text in ((inserted, 1, new), (deleted, -1, new), (revised, -1, old), (revised, 1, new)):
        if df is not None:
            parts.append(df.select("source", "lang", F.col(text).alias("text"), F.lit(sign).alias("sign")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Ledger:
    """Committed batches below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch_id: str) -> str:
        return f"{self.path}/batch_id={quote(batch_id, safe='')}"

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def folders(self) -> list[str]:
        """Folders of complete batches: one for each batch since the last compaction, from one listing."""
        fs, _ = self._fs()
        marks = fs.globStatus(self._path(f"{self.path}/batch_id=*/_SUCCESS")) or []
        return sorted(m.getPath().getParent().toString() for m in marks)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _rows(self) -> DataFrame:
        """Rows of the batches that no other one stands for."""
        folders = self.folders()
        rows = self.spark.read.schema(_LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], _LEDGER)
        return rows.join(rows.select(F.explode("members").alias("batch")).distinct(), "batch", "left_anti")

    def compacted(self, batch_id: str) -> bool:
        """Whether a compaction has this id, or stands for the batch of this id."""
        return not self._rows().filter(F.col("members").isNotNull() & ((F.col("batch") == batch_id) | F.array_contains("members", batch_id))).isEmpty()

    def committed(self, batch_id: str) -> bool:
        """Whether a batch of this id is there as such."""
        fs, _ = self._fs()
        return fs.exists(self._path(f"{self._folder(batch_id)}/_SUCCESS"))

    def _publish(self, batch_id: str, rows: DataFrame) -> None:
        fs, _ = self._fs()
        aside, to = self._path(f"{self.path}/_aside-{uuid4().hex}"), self._path(self._folder(batch_id))
        rows.withColumn("batch", F.lit(batch_id)).select(*[c.split()[0] for c in _LEDGER.split(", ")]).repartition(1).write.parquet(aside.toString())  # a row for each key, moved to one file once they are summed up
        if fs.exists(to):
            fs.delete(to, True)  # what a writer of other habits left without its mark
        if not fs.rename(aside, to):
            raise OSError(f"{aside} can't be renamed to {to}")

    def commit(self, batch_id: str, sums: DataFrame) -> bool:
        """Store a batch's sums; if it has been committed before, nothing is computed or changed.  False if it has been compacted."""
        if self.compacted(batch_id):
            return False
        if self.committed(batch_id):
            return True
        self._publish(batch_id, sums.select(*KEYS, *SUMS).withColumn("members", F.lit(None).cast("array<string>")))
        return True

    def totals(self) -> DataFrame:
        rows = self._rows().filter("n_docs IS NOT NULL")
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def compact(self, batch_id: str) -> None:
        """One batch of this new id in place of all; their ids, and those that they stood for, are kept in it."""
        if self.committed(batch_id) or self.compacted(batch_id):
            raise ValueError(f"batch {batch_id} is there already")
        folders = self.folders()
        names = self.spark.createDataFrame([(unquote(f.rsplit("/batch_id=", 1)[1]),) for f in folders], "m string")
        members = names.union(self._rows().select(F.explode("members").alias("m"))).agg(F.array_sort(F.collect_set("m")).alias("members"))
        none = [F.lit(None).cast("string").alias(k) for k in KEYS] + [F.lit(None).cast("bigint").alias(s) for s in SUMS]
        self._publish(batch_id, self.totals().withColumn("members", F.lit(None).cast("array<string>")).unionByName(members.select(*none, "members")))
        fs, _ = self._fs()
        for f in folders:
            fs.delete(self._path(f), True)
