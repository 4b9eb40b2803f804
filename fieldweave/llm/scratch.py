"""Written intermediate tables in the folder that all executors share.

Spark recomputes a lost executor's part of a lazy plan, which is costly where several jobs read one intermediate result
and wrong where a count taken from it must keep holding.  Such results are written once to ``spark.checkpoint.dir`` (read
from the session; a local folder of our own only where it is unset and the master is local, as in tests) and read back, so every later
job sees the same rows whichever executors are lost.

While a table is written, Arrow batches to Python are cut at ``BATCH_BYTES`` unless the caller says otherwise (Spark's own bound of 64 MB,
or 10,000 rows however long, is held at both ends for every task), and the shuffle files behind it are deleted once it is there: nothing reads them again.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
#: Ids or keys that may go to every task: some 25 MB of them as rows of a hash table.
BROADCAST_IDS = 1 << 18
BATCH_BYTES = 4 << 20
#: No bound in bytes: Spark then does not measure the batch anew after each row, which costs over a microsecond a row.
UNCHECKED = (1 << 31) - 1
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; only where none is set and all runs in one process, a local one."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/fieldweave-shared"
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


@contextmanager
def _while_writing(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> Iterator[None]:
    held = _WHILE_WRITING | {_BATCH_KEY: str(batch_bytes)}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Scratch:
    """A folder of its own below the shared one.  ``write`` returns the table read back; ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fieldweave/{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy", batch_bytes: int = BATCH_BYTES, plain: str | None = None) -> DataFrame:
        """``batch_bytes``: ``UNCHECKED`` where many short rows go to Python in groups that are bounded themselves.

        ``plain``: a column whose values hardly repeat, for which Parquet needs to try no dictionary.
        """
        with _while_writing(self.spark, batch_bytes):
            writer = df.write.mode("overwrite").option("compression", compression)
            (writer.option(f"parquet.enable.dictionary#{plain}", "false") if plain else writer).parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def semi_join(self, rows: DataFrame, ids: DataFrame, on: Column, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
        """``rows`` joined with the written table ``ids``: it goes to every task if it has at most ``most`` rows, which are counted; else both are shuffled."""
        return rows.join(F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash"), on, how)

    def equi_join(self, rows: DataFrame, table: DataFrame, on: list[str] | Column, how: str = "inner", most: int = BROADCAST_IDS) -> DataFrame:
        """``rows`` joined with the written ``table``, which goes to every task if it has at most ``most`` rows, which are counted; else the optimizer deals both."""
        return rows.join(F.broadcast(table) if table.count() <= most else table, on, how)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        """Delete every other table; nothing that is still lazy may read one."""
        self.drop(*(self.names - set(names)))
