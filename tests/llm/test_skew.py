import pytest
from pyspark.sql import functions as F

from fieldweave.llm import skew
from fieldweave.llm.scratch import Scratch


@pytest.fixture(params=[4, 4096])
def heavy(request, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", request.param)
    return request.param


def test_counted_join_equals_a_plain_join(spark, heavy):
    # a third of all rows have key 0, a key of 6 and null have no count
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 == 1, None).otherwise(F.col("id") % 7).alias("v"))
    counts = Scratch(spark).write(rows.filter("v < 6").groupBy("v").agg(F.count("*").alias("m")), "counts")
    want = sorted(map(tuple, rows.join(counts, "v").select("v", "id", "m").collect()))
    assert sorted(map(tuple, skew.join_counted(rows, counts, "v", "m").select("v", "id", "m").collect())) == want and len(want) > 2000
    assert skew.join_counted(rows, counts.limit(0), "v", "m").count() == 0


def test_spread_join_equals_a_plain_join(spark, heavy):
    pairs = [(0, k) for k in range(1, 400)] + [(k, 500) for k in range(1, 300)] + [(k, k + 1) for k in range(600, 900)]
    written = Scratch(spark).write(spark.createDataFrame(pairs, "a bigint, b bigint"), "pairs")
    keyed = spark.range(1000).select("id", F.array("id", F.col("id") * 2).alias("s"))
    got = skew.join_spread(written, keyed, ["b", "a"], {"a": "sa", "b": "sb"}, "id", "s")
    assert got.columns[-2:] == ["sb", "sa"] and sorted((r["a"], r["b"], r["sa"], r["sb"]) for r in got.collect()) == sorted((a, b, [a, 2 * a], [b, 2 * b]) for a, b in pairs)
    assert skew.join_spread(written.limit(0), keyed, ["b", "a"], {"a": "sa", "b": "sb"}, "id", "s").count() == 0


def test_the_pairs_of_a_leader_are_dealt_to_many_tasks(spark):
    written = Scratch(spark).write(spark.range(1, 20001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b")), "leader")
    keyed = spark.range(20001).select("id", F.array("id").alias("s"))
    got = skew.join_spread(written, keyed, ["b", "a"], {"a": "sa", "b": "sb"}, "id", "s")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20000 and max(sizes) < 3000
