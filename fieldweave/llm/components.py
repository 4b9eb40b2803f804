"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges`` (a, b) to (node, root): every node that has an edge, and one label for each component.

    Each round points a node at the smallest of itself and its neighbours, follows the pointer once more, and renames the
    edges' ends; edges inside one label go.  Labels of a component stay joined by the renamed edges, so the rounds end with one label
    for each.  Ids should be hashes, for which the number of rounds is logarithmic.  Every table is written: none is collected.
    """
    rest = scratch.write(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges0")
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    labels = scratch.write(nodes.withColumn("root", F.col("node")), f"{name}-labels0")
    k = 0
    while not rest.isEmpty():
        k += 1
        both = rest.select("a", "b").union(rest.select(F.col("b"), F.col("a")))
        low = scratch.write(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("p")), f"{name}-low{k}")
        far = scratch.write(low.join(low.select(F.col("n").alias("p"), F.col("p").alias("q")), "p", "left").select("n", F.least("p", F.coalesce("q", "p")).alias("to")), f"{name}-far{k}")
        labels = scratch.write(labels.join(far, labels["root"] == far["n"], "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-labels{k}")
        one = rest.join(far, rest["a"] == far["n"]).select(F.col("to").alias("a"), "b")
        two = one.join(far, one["b"] == far["n"]).select("a", F.col("to").alias("b"))
        rest = scratch.write(two.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges{k}")
        scratch.drop(f"{name}-edges{k - 1}", f"{name}-labels{k - 1}", f"{name}-low{k}", f"{name}-far{k}")
    return labels
