import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import sharding

from .docs import ODD, empty, frame


def brute_differencing(sizes, k):
    """Karmarkar-Karp with explicit sets."""
    parts = [([(s, [i])] + [(0, []) for _ in range(k - 1)], i) for i, s in enumerate(sizes)]
    serial = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0][0] - p[0][-1][0]), p[1]))
        (a, _), (b, _) = parts.pop(0), parts.pop(0)
        both = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))]
        both.sort(key=lambda p: -p[0])
        parts.append((both, serial))
        serial += 1
    return [x for x, _ in parts[0][0]]


@pytest.mark.parametrize("k", [2, 3, 8])
def test_differencing_equals_brute_force(k):
    sizes = np.random.default_rng(k).integers(1, 5000, 200)
    tuples = np.zeros((200, k), np.int64)
    tuples[:, 0] = sizes
    slots = sharding.difference(tuples)[:, 0]
    sums = [int(sizes[slots == s].sum()) for s in range(k)]
    assert sums == brute_differencing(sizes.tolist(), k)


@pytest.mark.parametrize("bucket_groups,fan", [(10_000, 2000), (3, 2)])
def test_documents(spark, bucket_groups, fan):
    rows = sharding.shard_documents(frame(spark), 3, bucket_groups=bucket_groups, fan=fan).collect()
    texts = dict(ODD)
    assert len(rows) == len(ODD)
    shards, slots = {}, {}
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        shards.setdefault(text, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("bucket_groups,fan,most", [(10_000, 2000, 0.001), (250, 2, 0.01), (40, 4, 0.02)])
def test_balance_over_levels(spark, bucket_groups, fan, most):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs, 8, bucket_groups=bucket_groups, fan=fan).collect()
    sums = {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) < most * sum(sums.values())


def test_empty(spark):
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_write(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(docs, sharding.shard_documents(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()

def test_equal_rows_are_spread(spark):
    """A third of all rows with one text, and all of them without an id: no run gets more than its share, and their group stays whole."""
    docs = spark.range(90_000).repartition(6).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    from fieldweave.llm.scratch import Scratch

    seen = []

    class Watched(Scratch):
        def write(self, df, name, *args):
            out = super().write(df, name, *args)
            if name == "to_number":
                runs = out.withColumn("run", F.pmod(F.xxhash64("place"), F.lit(16))).groupBy("run").count()
                seen.append(runs.agg(F.max("count")).first()[0])
            return out

    own, sharding.Scratch = sharding.Scratch, Watched
    try:
        got = sharding.shard_documents(docs, n_shards=8)
        rows = got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.sum("size").alias("bytes")).collect()
    finally:
        sharding.Scratch = own
    assert seen and seen[0] < 2 * 90_000 / 16
    assert sum(r["n"] for r in rows) == 90_000 and all(r["last"] == r["n"] - 1 == r["slots"] - 1 for r in rows)
    assert got.filter("size = 1").select("shard").distinct().count() == 1
