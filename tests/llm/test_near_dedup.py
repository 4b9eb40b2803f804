import random
import re

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import near_dedup
from fieldweave.llm.components import connected_components
from fieldweave.llm.scratch import Scratch

from .docs import ODD, empty, frame


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, size, percent):
    """[(id, n, component)] by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = min([x for x in (low.get(r), k) if x is not None], default=None)
    return sorted(((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=5):
    """Crowds of near copies around bases, some of which share a long passage, and unrelated texts with a common passage."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, k = [], 100
    for base in range(3):
        words = [f"b{base}x{rnd.randrange(400)}" for _ in range(150)] + passage * (base > 0)
        for _ in range(60):
            rows.append((k, edited(rnd, words, rnd.choice([0, 1, 2, 3, 4, 5, 6, 8, 12]))))
            k += 1
    for _ in range(80):
        rows.append((k, " ".join([f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(3, 60))] + passage)))
        k += 1
    for n in range(40):
        rows.append((k, " ".join(passage[: 30 + n % 30]) + (f" tail{n}" if n % 2 else "")))
        k += 1
    for _ in range(60):
        words = [f"s{rnd.randrange(10**5)}" for _ in range(rnd.randrange(1, 300))]
        rows += [(k, " ".join(words)), (k + 1, edited(rnd, words, 1 + len(words) // 60)), (k + 2, " ".join(words).upper())]
        k += 3
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,short", [(3, 85, 32), (3, 85, 4), (5, 80, 8)])
def test_components_equal_brute_force(spark, size, percent, short):
    rows = corpus() + ODD
    df = frame(spark, rows)
    assert got(near_dedup.near_duplicates(df, size, percent, short=short)) == brute(rows, size, percent)


def test_kept_once_for_each_component(spark):
    rows = corpus(6)
    out = near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()
    kept = {r["component_id"] for r in out if r["kept"]}
    assert len(kept) == sum(r["kept"] for r in out) and kept == {r["component_id"] for r in out}


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(near_dedup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).collect() == []


def test_long_path_is_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").select(F.unhex(F.sha2(F.col("a").cast("string"), 256)).alias("a"), F.unhex(F.sha2(F.col("b").cast("string"), 256)).alias("b"))
    out = connected_components(df, Scratch(spark), "path")
    assert sorted(r["count"] for r in out.groupBy("root").count().collect()) == [2, 301]


def test_rows_are_judged_by_their_own_text(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    keep = lambda rows: sorted(map(tuple, near_dedup.keep_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert keep([(1, text), (None, text), (2, other)]) == [(1, text), (2, other), (None, text)]
    assert keep([(None, text), (None, text), (7, text)]) == [(7, text), (None, text), (None, text)]
    assert keep([(1, text), (5, other), (5, text)]) == [(1, text), (5, other)]
    assert keep([(1, text), (1, text), (3, None), (3, None), (4, "")]) == [(1, text), (3, None), (4, "")]


def test_ids_are_joined_alike_beyond_the_broadcast_bound(spark):
    docs = spark.createDataFrame([(k, "a") for k in range(50)], "doc_id bigint, text string")
    scratch = Scratch(spark)
    ids = scratch.write(spark.range(10).withColumnRenamed("id", "_id"), "ids")
    got = [sorted(r["doc_id"] for r in scratch.semi_join(docs, ids, F.col("doc_id") == F.col("_id"), how, most).collect()) for how in ("left_semi", "left_anti") for most in (0, 100)]
    assert got == [list(range(10))] * 2 + [list(range(10, 50))] * 2
