import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from fieldweave.sources import catalog
from fieldweave.streaming import upserts

CHANGES = "id bigint, name string, version int, _row string"
CURRENT = [(1, "a", 5, "x", 0), (2, "b", 5, "x", 1), (None, "no id", 5, "x", 2), (3, "c", 5, "x", 7)]


def one_by_one(rows):
    """The list after all changes by rising version, one at a time: a known id is replaced where it is, a new one goes to the front."""
    out = [list(r[:4]) for r in CURRENT]
    for k, name, version, extra in sorted(rows, key=lambda r: (r[2], r[1])):
        at = [i for i, r in enumerate(out) if r[0] == k]
        if not at:
            out.insert(0, [k, name, version, extra])
        elif version >= out[at[0]][2]:
            out[at[0]] = [k, name, version, extra]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_equals_one_upsert(spark, tmp_path, seed):
    rnd = random.Random(seed)
    # versions are distinct but for repeated rows; ids 1 to 3 are in the list, a third of the changes are of one new id
    rows = [(rnd.choice([1, 2, 3, None, 10, 11, 12, 13, 99, 99, 99, 99]), f"n{v}", v, None if v % 7 else "e") for v in rnd.sample(range(60), 40)]
    rows += rows[:5]
    rnd.shuffle(rows)
    current = spark.createDataFrame(CURRENT, CHANGES + ", pos bigint")
    want = one_by_one(rows)

    def listed(out):
        return [[r["id"], r["name"], r["version"], r["_row"]] for r in out.orderBy("pos").collect()]

    schema = spark.createDataFrame([], CHANGES).schema
    whole = spark.createDataFrame(rows, CHANGES)
    assert listed(catalog.upserted_in_place(current, whole, "id", "version", str(tmp_path / "whole"))) == want

    inbox, log, mark = (str(tmp_path / x) for x in ("inbox", "log", "mark"))
    for k in range(3):  # three runs of the stream with files of their own, two files a batch
        for part in range(3):
            spark.createDataFrame(rows[3 * k + part :: 9], CHANGES).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        upserts.upsert_stream(stream, "id", "version", log, mark).awaitTermination()
    assert spark.read.option("basePath", log).parquet(log).select("batch_id").distinct().count() > 3
    assert listed(upserts.upserted_list(current, log, schema, "id", "version", str(tmp_path / "placed"))) == want


def test_a_batch_that_runs_again_is_replaced(spark, tmp_path, monkeypatch):
    inbox, log, mark = (str(tmp_path / x) for x in ("inbox", "log", "mark"))
    rows = [(10, "new", 1, None), (10, "newer", 2, None), (2, "B", 9, None)]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(inbox)
    schema = spark.createDataFrame([], CHANGES).schema
    run = lambda: upserts.upsert_stream(spark.readStream.schema(schema).parquet(inbox), "id", "version", log, mark).awaitTermination()
    real = DataFrameWriter.parquet

    def cut_short(self, path, *args, **kwargs):
        real(self, path, *args, **kwargs)
        raise OSError("lost after writing")

    monkeypatch.setattr(DataFrameWriter, "parquet", cut_short)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    run()
    got = upserts.logged_changes(spark, log, schema, "id", "version").orderBy("id").collect()
    assert [(r["id"], r["name"], r["version"], r["_first"]) for r in got] == [(2, "B", 9, 9), (10, "newer", 2, 1)]
    assert spark.read.parquet(log).count() == 2


def test_no_changes_leave_the_list(spark, tmp_path):
    current = spark.createDataFrame(CURRENT, CHANGES + ", pos bigint")
    none = spark.createDataFrame([], CHANGES)
    out = catalog.upserted_in_place(current, none, "id", "version", str(tmp_path / "s"))
    assert out.orderBy("pos").agg(F.collect_list("name")).first()[0] == ["a", "b", "no id", "c"]
    first = catalog.upserted_in_place(current.filter("false"), current.drop("pos"), "id", "version", str(tmp_path / "t"))
    assert first.count() == 4 and first.filter("pos >= 0").isEmpty()
