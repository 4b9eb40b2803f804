"""Collocations against counting every window in Python, with small bounds so that every way of growing a prefix is taken."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import phrases, queries

from .docs import empty, frame


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows: list[tuple[str | None, str | None]], min_count: int, top: int) -> list[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {k: v for k, v in f.items() if v >= min_count and len(k[1]) > 1}
    out = []
    for lang in n:
        own = []
        for (x, ws), a in found.items():
            if x != lang or any(len(o) > len(ws) and b * 100 >= a * 80 and any(o[i : i + len(ws)] == ws for i in range(len(o))) for (y, o), b in found.items() if y == lang):
                continue
            score, _, l, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            own.append((-score, -a, " ".join(ws).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts() -> list[tuple[str | None, str | None]]:
    rnd = random.Random(5)
    vocabulary = ["the", "of", "New", "york", "a", "été", "b|c", "x" * 300, "日本", "w1", "w2"]
    rows: list[tuple[str | None, str | None]] = []
    for k in range(150):
        words = rnd.choices(vocabulary, weights=[9, 6, 4, 4, 3, 2, 2, 1, 1, 1, 1], k=rnd.randint(0, 60))
        joined = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", " - "]) for w in words)
        rows.append((["en", "fr", None, "und", ""][k % 5], joined + (" New York City hall." if k % 3 else " the the the the the")))
    return [*rows, ("en", None), ("en", ""), ("en", " . , "), *[("en", "a common passage that all of the documents share word for word")] * 40, ("de", "lone words")]


@pytest.mark.parametrize(("most", "bits", "min_count", "top"), [(phrases.MOST, 20, 5, 1000), (10, 6, 5, 1000), (1, 20, 3, 7), (3, 3, 30, 1000)])
def test_equals_counting_every_window(spark, most, bits, min_count, top):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)  # with small ``top``, bounds decide what is scored at all
    got = phrases.collocations(docs, min_count, top, most=most, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, min_count, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20 - 15 * (min_count == 30)


def test_no_task_gets_more_than_its_bound(spark):
    from fieldweave.llm.scratch import Scratch

    rnd = random.Random(3)
    rows = [tuple(rnd.choice((1, 1, 2, 3, 4, 5)) if k < 2 or rnd.random() < 0.9 else 0 for k in range(4)) for _ in range(3000)]
    rows = [(*r, 0, 1) for r in {(a, b, c, d if c else 0) for a, b, c, d in rows}]
    projected = spark.createDataFrame(rows, "w1 bigint, w2 bigint, w3 bigint, w4 bigint, g bigint, n bigint")
    depth = phrases.with_depth(projected, Scratch(spark), most=4)
    keys = [F.when(F.col("depth") >= d, F.col(w)) for d, w in enumerate(phrases.W, 1)]
    assert depth.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 4
    assert depth.count() == len(rows) and depth.agg(F.max("depth")).first()[0] > 2


def test_growing_one_prefix():
    columns = [np.array(c, np.uint64) for c in ([7] * 5, [1, 1, 1, 2, 2], [3, 3, 0, 3, 0], [4, 0, 0, 4, 0])]
    found = phrases.grow(columns, np.array([2, 1, 1, 1, 1]), 1, 2)
    assert dict(zip(*found)) == {(7, 1): 4, (7, 1, 3): 3, (7, 1, 3, 4): 2, (7, 2): 2}
    assert phrases.grow([c[2:3] for c in columns], np.array([9]), 3, 2) == ([], [])


def test_counts_beyond_64_bits_when_multiplied(spark):
    big = 5_000_000_000_000
    found = spark.createDataFrame([(1, 2, 0, 0, 0, big - 1)], "w1 bigint, w2 bigint, w3 bigint, w4 bigint, g bigint, a bigint")
    words = spark.createDataFrame([(1, big), (2, big + 1)], "id bigint, n bigint")
    assert phrases.scored(found, found, words).first()["score"] == 2_000_000 * (big - 1) // (2 * big + 1)


def test_two_words_of_one_number_are_numbered_anew(spark, monkeypatch):
    from fieldweave.llm.scratch import Scratch

    rows = phrases._texts(spark.createDataFrame([("en", "a b a")], "lang string, text string"), "lang", "text")
    own = phrases.word_counts
    monkeypatch.setattr(phrases, "word_counts", lambda t, seed: own(t, seed).withColumn("id", F.lit(1).cast("bigint")) if seed < 2 else own(t, seed))
    assert phrases.vocabulary(rows, Scratch(spark), 3)[1] == 2 and phrases.vocabulary(rows, Scratch(spark), 4)[1] == 0


def test_odd_rows_and_empty_tables(spark):
    assert [r["phrase"] for r in phrases.collocations(frame(spark), min_count=30).collect()]
    assert phrases.collocations(empty(spark)).collect() == []


def test_query_equals_brute_force_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, queries.op12_phrase_mining(spark, "/root/testdata/sf0.001").collect())) == brute(rows, 30, 2000)
