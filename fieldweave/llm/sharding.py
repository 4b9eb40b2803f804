"""Sharding of indivisible groups by multiway Karmarkar-Karp differencing.

Documents of equal text form a group, which stays in one shard.  A partial partition is a tuple of ``n_shards`` sums; the two with
the largest spread are combined oppositely ordered (largest with smallest) until one is left.  Groups are dealt by hash to
buckets of about ``bucket_groups``, differenced in one task each; the buckets' partial partitions are then differenced in the
same way, ``fan`` at a time, level by level, until one is left.  No task ever holds more than a bucket's groups or ``fan``
partial partitions.  A hot group is one row there, as sizes are summed by group first; its documents get their shard from a table of the
``HOT_GROUPS`` largest groups at most, which every task has, and rows are numbered by runs of the written table's rows, so equal rows are spread like others.

Defined results: a null text counts as empty and groups with empty texts; repeated rows and null ids are rows like others; ties are
broken by group key, so a retry gives the same shards.  Columns other than the id and the text are not read.  An empty table
gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BUCKET_GROUPS = 10_000
FAN = 2_000
#: Groups of more than this part of all rows are hot, of which there can't be more.
HOT_GROUPS = 100_000
HOT_ROWS = 1_000


def difference(tuples: np.ndarray) -> np.ndarray:
    """For partial partitions (rows of sums), the slot of the result that each row's slots go to, as an array of the same shape."""
    n, k = tuples.shape
    to = np.zeros((n, k), np.int64)
    if not n:
        return to
    # each live partial partition: sums by falling size, and for each slot the (row, slot) pairs merged into it
    heap, merged = [], {}
    for r in range(n):
        order = sorted(range(k), key=lambda s: (-int(tuples[r, s]), s))
        sums = [int(tuples[r, s]) for s in order]
        merged[r] = (sums, [[r * k + s] for s in order])
        heap.append((sums[-1] - sums[0], r))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ma), (sb, mb) = merged.pop(a), merged.pop(b)
        sums, members = [], []
        for x, y, p, q in zip(sa, reversed(sb), ma, reversed(mb)):
            sums.append(x + y)
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            members.append(p)
        order = sorted(range(k), key=lambda s: -sums[s])
        merged[serial] = ([sums[s] for s in order], [members[s] for s in order])
        sums = merged[serial][0]
        heapq.heappush(heap, (sums[-1] - sums[0], serial))
        serial += 1
    ((_, members),) = merged.values()
    flat = to.reshape(-1)
    for slot, pairs in enumerate(members):
        flat[pairs] = slot
    return to


def _bucket_slots(n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group_bytes", "descending"), ("group_key", "ascending")])
        sizes = table.column("group_bytes").to_numpy()
        tuples = np.zeros((len(sizes), n_shards), np.int64)
        tuples[:, 0] = sizes
        slots = difference(tuples)[:, 0]
        return table.select(["group_key", "group_bytes", "bucket"]).append_column("slot_in", pa.array(slots, pa.int32()))

    return run


def _level_slots(n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("slot_in", "ascending")])
        node, slot, size = (table.column(c).to_numpy() for c in ("node", "slot_in", "bytes"))
        nodes, back = np.unique(node, return_inverse=True)
        tuples = np.zeros((len(nodes), n_shards), np.int64)
        tuples[back, slot] = size
        return table.append_column("slot_out", pa.array(difference(tuples)[back, slot], pa.int32()))

    return run


def assign_groups(groups: DataFrame, scratch: Scratch, n_shards: int, bucket_groups: int = BUCKET_GROUPS, fan: int = FAN) -> DataFrame:
    """``groups`` (group_key, group_bytes) to (group_key, shard)."""
    groups = scratch.write(groups, "groups")
    n_buckets = max(1, -(-groups.count() // bucket_groups))
    key_type = groups.schema["group_key"].dataType.simpleString()
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(n_buckets)))
    placed = scratch.write(dealt.groupBy("bucket").applyInArrow(_bucket_slots(n_shards), f"group_key {key_type}, group_bytes bigint, bucket bigint, slot_in int"), "placed")
    # a level's map: (bucket, slot_in) -> (node of the level, slot there)
    route = placed.groupBy("bucket", "slot_in").agg(F.sum("group_bytes").alias("bytes")).withColumns({"node": F.col("bucket"), "slot": F.col("slot_in")})
    route, n_nodes, level = scratch.write(route, "route0"), n_buckets, 0
    while n_nodes > 1:
        sums = route.groupBy("node", F.col("slot").alias("slot_in")).agg(F.sum("bytes").alias("bytes")).withColumn("parent", F.floor(F.col("node") / fan).cast("bigint"))
        step = sums.groupBy("parent").applyInArrow(_level_slots(n_shards), "node bigint, slot_in int, bytes bigint, parent bigint, slot_out int")
        step = step.select(F.col("node").alias("n"), F.col("slot_in").alias("s"), "parent", "slot_out")
        route = route.join(step, (F.col("node") == F.col("n")) & (F.col("slot") == F.col("s"))).select("bucket", "slot_in", "bytes", F.col("parent").alias("node"), F.col("slot_out").alias("slot"))
        n_nodes, level = -(-n_nodes // fan), level + 1
        route = scratch.write(route, f"route{level}")
    return placed.join(route.select("bucket", "slot_in", F.col("slot").alias("shard")), ["bucket", "slot_in"]).select("group_key", F.col("shard").cast("int").alias("shard"))


def numbered(rows: DataFrame, scratch: Scratch, shard: str = "shard", order: tuple[str, ...] = ("doc_id", "group_key"), run_rows: int = 20_000) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard: written rows are dealt by place to runs, numbered in each run and shard, and moved on by the counts of the runs before."""
    rows = scratch.write(rows.withColumn("place", F.monotonically_increasing_id()), "to_number")
    n_runs = max(16, -(-rows.count() // run_rows))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("place"), F.lit(n_runs)))
    counts = rows.groupBy(shard, "run").count()
    from pyspark.sql import Window

    # one row for each shard and run: rows / run_rows of them for each shard
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy(shard).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).select(shard, "run", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(shard, "run").orderBy(*order, "place")) - 1
    return rows.withColumn("inside", inside).join(before, [shard, "run"]).withColumn("slot", F.col("inside") + F.col("before")).drop("run", "inside", "before", "place")


def with_shards(rows: DataFrame, counts: DataFrame, shards: DataFrame, scratch: Scratch, hot_groups: int = HOT_GROUPS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with their group's ``shard``; ``counts`` (group_key, n): a group of many rows is looked up where its rows are, the others are joined by key."""
    least = max(hot_rows, -(-(counts.agg(F.sum("n")).first()[0] or 0) // hot_groups))
    hot = scratch.write(shards.join(counts.filter(F.col("n") > least).select("group_key"), "group_key", "left_semi"), "hot")
    if hot.isEmpty():
        return rows.join(shards, "group_key")
    there = F.broadcast(hot)  # at most ``hot_groups`` rows, as each has more than that part of all
    return rows.join(there, "group_key").unionByName(rows.join(there, "group_key", "left_anti").join(shards, "group_key"))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket_groups: int = BUCKET_GROUPS, fan: int = FAN) -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``group_key``, ``shard`` and ``slot``."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.write(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group_key")), "rows")
    sums = scratch.write(rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("n")), "sums")
    shards = scratch.write(assign_groups(sums.select("group_key", "group_bytes"), scratch, n_shards, bucket_groups, fan), "shards")
    return numbered(with_shards(rows, sums.select("group_key", "n"), shards, scratch), scratch, order=(id_col, "group_key"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write whole documents to ``path``/shard=N, ordered by slot within each file; ids must be unique here."""
    out = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    spread = out.withColumn("_part", F.floor(F.col("slot") / rows_per_file))
    spread.repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part").write.mode("overwrite").partitionBy("shard").parquet(path)
