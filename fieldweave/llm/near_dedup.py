"""MinHash near-duplicate detection from bottom-k sketches of one hash function.

1. ``features`` reads whole texts once: the set of word shingles as 64-bit hashes gives its size, a 128-bit digest of the set and the
   ``k`` smallest hashes.  Documents of equal sets are one class from here on.
2. Inverted lists of retained values.  Of a linked pair, at least ``need`` retained values are shared (exactly for small sets,
   else five standard deviations below what the threshold implies: a miss in millions).  So with the values of each sketch
   ordered by rising frequency, the first ``size - need + 1`` of both must meet; only these are listed, and values that occur once,
   which come first, take places without making rows.  A passage that many documents share is frequent and so seldom listed.
3. Lists of up to ``short`` classes give pairs; the sketch of the union estimates the similarity and drops what is five
   standard deviations below the threshold.
4. Classes in longer lists are listed anew by their full sets, which is exact: again by rising frequency among them.  Lists of
   values that are frequent even there are only needed for pairs that share nothing rare, so whose frequent shares alone reach
   the overlap needed.  Such a list is not expanded: in each round its classes are compared with a few leaders, those
   already in one component being skipped, the leaders leave the list and their number grows sixteenfold.  It ends when no list holds two
   components that have not been compared, so no link between components is lost.  Each class carries its first ``HEAD`` frequent values:
   two classes whose heads meet are compared in the list of the first value that they share, and not again in every other.
   Joins by value keep the few that hold much of all rows off the shuffle (``skew``), and a leader's pairs are dealt to several tasks.
5. Exact Jaccard on full sets confirms every link; components are contracted, and every document gets the smallest id of its own.

Defined results: texts without words have an empty set and link with nothing; fewer words than a shingle make one shingle;
null text counts as empty.  A null id never wins over another; where all ids of a component are null, it stays null.  Repeated rows are
documents like others.  ``kept`` is ``doc_id <=> component_id``.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import skew
from .components import connected_components
from .scratch import Scratch
from .textblocks import U64, Block, blocks, mix64

SKETCH = 64
SHORT = 32
HEAD = 16
GROWTH = 16
SALTS = 16
DEVIATIONS = 5
_SALT_A, _SALT_B, _SALT_FEW = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


def shingle_sets(block: Block, size: int, fold: bool) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    words = block.word_hashes(fold)
    windows, bounds = block.windows(words, size)
    counts = block.n_words()
    for d in range(block.n_docs):
        if counts[d] >= size:
            yield np.unique(windows[bounds[d] : bounds[d + 1]])
        elif counts[d]:
            mixed = _SALT_FEW + U64(counts[d])
            for w in words[block.word_bounds[d] : block.word_bounds[d + 1]]:
                mixed = mix64(np.array([mixed ^ w]))[0]
            yield np.array([mixed])
        else:
            yield np.zeros(0, U64)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _digest(values: np.ndarray) -> bytes:
    return mix64(values ^ _SALT_A).sum(dtype=U64).tobytes() + mix64(values ^ _SALT_B).sum(dtype=U64).tobytes()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def features(docs: DataFrame, size: int, fold: bool, k: int | None = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, cid, retained): set size, 16-byte digest, and the ``k`` smallest hashes, or the whole set where ``k`` is None."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                n, cid, kept = [], [], []
                for values in shingle_sets(block, size, fold):
                    n.append(len(values))
                    cid.append(_digest(values))
                    kept.append(values[:k])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n_docs), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), _lists(kept)], [id_col, "n", "cid", "retained"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n bigint, cid binary, retained array<bigint>")


def shares_needed(percent: int, k: int) -> int:
    """Retained values that a linked pair shares among the union's ``k`` smallest, but for ``DEVIATIONS`` standard deviations."""
    t = percent / 100
    return max(1, math.floor(t * k - DEVIATIONS * math.sqrt(k * t * (1 - t))))


def _listed(rows: DataFrame, length: Column, needed: Column, scratch: Scratch, name: str) -> DataFrame:
    """(v, df, cid, n, ...) to the rows of each class's prefix.  ``rows`` has (cid, n, values); values that occur once make no rows."""
    values = rows.select("cid", F.explode("values").alias("v"))
    often = scratch.write(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), name)
    shared = skew.join_counted(values, often, "v", "df").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    return rows.select("cid", "n", length.alias("len"), needed.alias("need")).join(shared, "cid").withColumn(
        "prefix", F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("len") - F.col("need") + 1 - (F.col("len") - F.size("shared"))).cast("int"))
    )


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of the classes that meet in a list of ``rows`` (v, cid, n)."""
    x = rows.select("v", F.col("cid").alias("a"), F.col("n").alias("na"))
    y = rows.select("v", F.col("cid").alias("b"), F.col("n").alias("nb"))
    return x.join(y, (x["v"] == y["v"]) & (x["a"] < y["b"]) & _sizes_fit("na", "nb", percent)).select("a", "b").distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule the threshold out."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("retained").alias(f"r{c}"))
    union = F.slice(F.array_sort(F.array_union("ra", "rb")), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect("ra", "rb")))
    least = F.when(F.size(union) >= k, F.lit(shares_needed(percent, k))).otherwise(F.ceil(F.size(union) * percent / 100))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(both >= least).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs whose exact Jaccard similarity reaches the threshold."""
    met = skew.join_spread(pairs, sets, ["b", "a"], {"a": "sa", "b": "sb"}, "cid", "retained")
    met = met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("total"))
    return met.filter(100 * F.col("i") >= percent * (F.col("total") - F.col("i"))).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch, size: int, fold: bool, id_col: str, text_col: str) -> DataFrame:
    """Whole sets of the wanted classes (cid, rep): texts are fetched by the class's smallest id, then known by their digest."""
    rep = scratch.write(wanted.select(F.col("rep")).distinct(), "reps")
    texts = scratch.semi_join(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rep, F.col("_id").eqNullSafe(F.col("rep")))
    sets = features(texts, size, fold, None, "_id", "_text").select("cid", "n", "retained")
    sets = scratch.write(sets.join(wanted.select("cid").distinct(), "cid", "left_semi"), "sets")
    if sets.count() != sets.select("cid").distinct().count():  # ids that repeat or are null
        sets = scratch.write(sets.groupBy("cid").agg(F.first("n").alias("n"), F.first("retained").alias("retained")), "sets-once")
    return sets


def _open_lists(hot: DataFrame, labels: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """``hot`` with each class's ``root``, without lists whose classes are all in one component; those never open again."""
    rows = hot.withColumn("root", F.col("cid")) if labels is None else hot.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rows = scratch.write(rows, f"{name}-rooted")
    still = rows.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo < hi")
    still = scratch.write(still.select("v", "m"), f"{name}-still")
    opened = scratch.write(skew.join_counted(rows, still, "v", "m").drop("m"), name)
    scratch.drop(f"{name}-rooted", f"{name}-still")
    return opened


def _compare_with_leaders(rows: DataFrame, leaders: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows of leaders) of one round; pairs within a component, or that frequent shares can't make linked, are skipped."""
    first = Window.partitionBy("v").orderBy(F.desc(F.col("h") / F.col("n")), "cid")
    lead = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= leaders)
    lead = lead.select(F.col("v").alias("w"), F.col("cid").alias("lead"), F.col("n").alias("nl"), F.col("h").alias("hl"), F.col("head").alias("headl"), F.col("root").alias("rl"))
    elsewhere = F.coalesce(F.try_element_at(F.array_intersect("head", "headl"), F.lit(1)) != F.col("v"), F.lit(False))
    # a long list's classes are dealt to SALTS tasks, each with all of its leaders
    spread = lead.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    met = dealt.join(spread, (F.col("v") == F.col("w")) & (F.col("dealt") == F.col("salt")) & (F.col("root") != F.col("rl")) & _sizes_fit("n", "nl", percent) & F.expr(f"least(h, hl) * {100 + percent} >= {percent} * (n + nl)") & ~elsewhere)
    return met.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct(), lead.select(F.col("w").alias("v"), F.col("lead").alias("cid"))


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    fold: bool = True,
    k: int = SKETCH,
    short: int = SHORT,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``.  Links have 100 * intersection >= percent * union."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(features(docs, size, fold, k, id_col, text_col), "features")
    classes = scratch.write(
        rows.filter("n > 0").groupBy("cid").agg(F.min(id_col).alias("rep"), F.first("n").alias("n"), F.first("retained").alias("retained")), "classes"
    )
    need = F.when(100 * F.col("n") <= percent * k, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(F.lit(shares_needed(percent, k)), F.size("retained")))
    listed = _listed(classes.select("cid", "n", F.col("retained"), F.col("retained").alias("values")), F.size("retained"), need, scratch, "often")
    listed = scratch.write(listed.select("cid", "n", F.explode("prefix").alias("p")).select(F.col("p.v").alias("v"), "cid", "n"), "listed")
    lengths = scratch.write(listed.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1"), "lengths")
    lists = scratch.write(skew.join_counted(listed, lengths, "v", "m"), "lists")
    scratch.drop("often", "listed", "lengths")
    pairs = scratch.write(_estimated(_pairs(lists.filter(F.col("m") <= short), percent), classes, percent, k), "pairs")
    crowded = scratch.write(lists.filter(F.col("m") > short).select("cid").distinct(), "crowded")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(crowded).distinct()
    wanted = scratch.write(classes.join(wanted, "cid", "left_semi").select("cid", "rep"), "wanted")
    sets = _full_sets(docs, wanted, scratch, size, fold, id_col, text_col)
    hot = None
    if not crowded.isEmpty():
        full = sets.join(crowded, "cid", "left_semi").select("cid", "n", F.col("retained").alias("values"))
        exact = _listed(full, F.col("n"), F.ceil(F.col("n") * percent / 100), scratch, "often-exact")
        frequent = lambda s: s["df"] > short
        exact = exact.withColumn("h", F.size(F.filter("shared", frequent))).withColumn("head", F.transform(F.slice(F.filter("prefix", frequent), 1, HEAD), lambda s: s["v"]))
        exact = scratch.write(exact.select("cid", "n", "h", "head", F.explode("prefix").alias("p")).select(F.col("p.v").alias("v"), F.col("p.df").alias("df"), "cid", "n", "h", "head"), "exact")
        hot = exact.filter(F.col("df") > short).select("v", "cid", "n", "h", "head")
        hot = _open_lists(hot, None, scratch, "open0")
        more, lead = _compare_with_leaders(hot, 1, percent)
        hot = scratch.write(hot.join(lead, ["v", "cid"], "left_anti").drop("root"), "hot0")
        pairs = scratch.write(pairs.union(_pairs(exact.filter(F.col("df") <= short), percent)).union(more).distinct(), "pairs-all")
    links = scratch.write(confirmed(pairs, sets, percent), "links")
    labels = connected_components(links, scratch, "first")
    leaders, k_round = 1, 0
    while hot is not None:
        leaders, k_round = leaders * GROWTH, k_round + 1
        hot = _open_lists(hot, labels, scratch, f"open{k_round}")
        more, lead = _compare_with_leaders(hot, leaders, percent)
        lead = scratch.write(lead, f"lead{k_round}")
        if lead.isEmpty():
            break
        more = scratch.write(more, f"more{k_round}")
        new = scratch.write(confirmed(more, sets, percent), f"links{k_round}")
        hot = scratch.write(hot.join(lead, ["v", "cid"], "left_anti").drop("root"), f"hot{k_round}")
        scratch.drop(f"open{k_round}", f"lead{k_round}", f"more{k_round}", f"hot{k_round - 1}")
        if not new.isEmpty():
            links = links.union(new)
            labels = connected_components(links, scratch, f"round{k_round}")
    low = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("low"))
    reached = labels.join(low, "root").select(F.col("node").alias("cid"), "low")
    smallest = classes.select("cid", "rep").join(reached, "cid", "left").select("cid", F.coalesce("low", "rep").alias("component_id"))
    smallest = scratch.write(smallest, "smallest")
    scratch.keep_only("features", "smallest")
    own = rows.filter("n = 0").select(id_col, "n", F.col(id_col).alias("component_id"))
    rest = rows.filter("n > 0").select(id_col, "n", "cid").join(smallest, "cid").select(id_col, "n", "component_id")
    return own.unionAll(rest).select(id_col, F.col("n").alias("n_shingles"), "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def keep_documents(docs: DataFrame, size: int = 5, percent: int = 80, fold: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the smallest id.

    Rows without an id stay.  Where rows share an id, each is judged by its own text; rows that repeat a kept id and text stay once.
    """
    scratch = Scratch(docs.sparkSession)
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_key(text_col).alias("key"))  # in order of ids, none last
    found = near_duplicates(docs.select(place.alias("_place"), F.col(text_col).alias("_text")), size, percent, fold, id_col="_place", text_col="_text", scratch=scratch)
    known = found.filter("NOT _place.none").groupBy("_place").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")).filter("NOT kept OR rows > 1")
    known = scratch.write(known.select(F.col("_place.id").alias("_id"), F.col("_place.key").alias("_key"), "kept"), "known")
    scratch.keep_only("known")
    on = (F.col(id_col) == F.col("_id")) & (text_key(text_col) == F.col("_key"))
    once = scratch.semi_join(docs, known.filter("kept"), on).dropDuplicates([id_col, text_col])
    return scratch.semi_join(docs, known, on, "left_anti").unionByName(once)
