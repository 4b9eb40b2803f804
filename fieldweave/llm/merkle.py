"""Merkle manifest of a dataset: one tree for each source, and a tree over the sources' roots.

A leaf is H (SHA-256 of the concatenated inputs, as lower-case hex) of a row's columns; every ``FAN`` consecutive nodes become the H of
their own, level by level, until one remains.  What a level keeps is one row for each parent with its preimage, the concatenated hashes of its
children, from which the parent's hash and every child's siblings can be had.  A leaf's proof is made from its ancestors' preimages: its own
64-character slot is cut out of each, which leaves the siblings before and after it, and another hash is put there to fold upwards.

Nodes need their place among those of their tree.  Rows are sorted by range and written once; a row's place is its place in its
sorted part and the rows of its tree in the parts before, so a source with a third of all rows is spread like any other.  Parents are joined
with their own parents from the top, so paths are made for a sixteenth of the leaves and then joined with these; texts are never shuffled.

Defined results: null columns count as ``-`` and a null source is a tree of its own, which comes first; rows without an id come before others; rows
of one id are ordered by their leaves, so repeated rows have equal leaves at places of their own; a source with one row has its
leaf as subroot; columns other than the five are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

FAN = 16
DIGEST = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def placed(rows: DataFrame, scratch: Scratch, name: str, order: Sequence[str], tree: str = "tree") -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 in each ``tree`` (never null) by ``order``, and ``n_tree``, the tree's number of rows."""
    by = [tree, *order]
    marked = rows.repartitionByRange(*by, F.monotonically_increasing_id()).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    marked = scratch.write(marked, name).withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = marked.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row for each tree and sorted part that holds some of it
    parts = Window.partitionBy(tree).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.write(runs.select(tree, "_part", "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("n_tree")), f"{name}-runs")
    return scratch.equi_join(marked, runs, [tree, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def levels(nodes: DataFrame, scratch: Scratch, name: str, fan: int = FAN) -> list[DataFrame]:
    """Parents of ``nodes`` (tree, pos, n_tree, hash), level by level: (tree, pos, n_tree, preimage, hash) in the order of their children.

    A tree has parents as long as it has several nodes; the last level has one node of the highest trees.
    """
    out: list[DataFrame] = []
    while not (several := nodes.filter("n_tree > 1")).isEmpty():
        children = several.groupBy("tree", F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("n_tree") / fan).alias("n_tree"))
        preimage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "hash"))), lambda x: x["hash"]), "")
        parents = children.agg(preimage.alias("preimage"))
        nodes = scratch.write(parents.withColumn("hash", F.sha2("preimage", 256)), f"{name}{len(out)}")
        out.append(nodes)
    return out


def step(preimage: Column, pos: Column, fan: int = FAN) -> Column:
    """What stands before and after the slot of the child at ``pos``."""
    at = (F.pmod(pos, F.lit(fan)) * DIGEST).cast("int")
    return F.struct(F.substring(preimage, F.lit(1), at).alias("before"), F.substring(preimage, at + DIGEST + 1, F.lit(fan * DIGEST)).alias("after"))


def under_parents(nodes: DataFrame, parents: DataFrame, tops: DataFrame, fan: int = FAN) -> DataFrame:
    """``nodes`` (tree, pos, ...) with ``path``, the steps from each one up: through its parent in ``parents`` (tree, pos, preimage, path), or for a root what ``tops`` (tree, path) has."""
    up = parents.select("tree", F.col("pos").alias("_up"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"))
    rows = nodes.withColumn("_up", F.floor(F.col("pos") / fan)).withColumn("_lone", F.col("n_tree") == 1)
    inner = rows.filter("NOT _lone").join(up, ["tree", "_up"]).withColumn("path", F.concat(F.array(step(F.col("_preimage"), F.col("pos"), fan)), F.col("_path")))
    lone = rows.filter("_lone").join(tops.select("tree", "path"), "tree")
    return inner.select(*nodes.columns, "path").unionByName(lone.select(*nodes.columns, "path"))


def paths(nodes: DataFrame, above: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str, fan: int = FAN) -> DataFrame:
    """``nodes`` with the ``path`` from each to what ``tops`` lead to; ``above`` is what ``levels`` made of them."""
    empty = nodes.sparkSession.createDataFrame([], f"tree string, pos bigint, n_tree bigint, preimage string, hash string, path {_PATH}")
    parents = empty
    for k in range(len(above) - 1, -1, -1):
        parents = scratch.write(under_parents(above[k], parents, tops, fan), f"{name}-paths{k}")
    return under_parents(nodes, parents, tops, fan)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to if put into its own place all the way up."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def siblings(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def roots_of(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree's root."""
    return reduce(DataFrame.unionAll, [x.filter("n_tree = 1").select("tree", "hash") for x in [nodes, *above]])


def tampered(doc_id: Column, every: int = 5) -> Column:
    """Whether the CRC-32 of the id as text is divisible by ``every``; rows without an id are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def manifest(docs: DataFrame, changed: Column | None = None, altered: Column | None = None, fan: int = FAN) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``, ``path`` and ``claimed``.

    ``claimed`` is the leaf of the row as it is found later: where ``changed`` holds, with ``altered`` in place of its text, else ``leaf`` itself.
    """
    scratch = Scratch(docs.sparkSession)
    doc_id, source, lang, n_chars, text = (F.col(c) for c in COLUMNS)
    leaf = leaf_of(doc_id, source, lang, n_chars, text)
    claimed = F.lit(None).cast("string") if changed is None or altered is None else F.when(changed, leaf_of(doc_id, source, lang, n_chars, altered))
    rows = docs.select(doc_id, source, F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("tree"), leaf.alias("hash"), claimed.alias("claimed"))
    nodes = placed(rows, scratch, "leaves", ["doc_id", "hash"])
    above = levels(nodes.select("tree", "pos", "n_tree", "hash"), scratch, "level", fan)
    subroots = roots_of(nodes, above).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    subroots = scratch.write(placed(subroots, scratch, "subroots", ["of"]), "subroots-placed")
    over = levels(subroots.select("tree", "pos", "n_tree", "hash"), scratch, "top", fan)
    root = roots_of(subroots, over).select("tree", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    sources = paths(subroots, over, root, scratch, "top", fan).join(root.select("tree", "root"), "tree")
    sources = scratch.write(sources.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "sources")
    known = paths(nodes, above, sources, scratch, "level", fan)
    done = scratch.equi_join(known, sources.select("tree", "subroot", "root"), ["tree"])
    return done.select("doc_id", "source", F.col("hash").alias("leaf"), "subroot", "root", "path", F.coalesce("claimed", "hash").alias("claimed"))


def verified(found: DataFrame) -> DataFrame:
    """``manifest`` with the proofs' digest, the root that each claimed leaf folds to, and whether it is the right one."""
    folded = fold(F.col("claimed"), F.col("path"))
    return found.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root")).drop("path")
