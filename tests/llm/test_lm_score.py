import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter

from fieldweave.llm import lm_score
from fieldweave.llm.queries import QUERIES

from .docs import ODD, empty, frame


def brute(texts, order, alpha, min_count):
    docs = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    counts, total = Counter(), sum(map(len, docs))
    for w in docs:
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        score = back = 0
        for i in range(len(w)):
            n, factor = min(order, i + 1), 0
            longest = n
            while n > 1 and counts[tuple(w[i - n + 1 : i + 1])] < min_count:
                n, factor = n - 1, factor + 1
            c = counts[tuple(w[i - n + 1 : i + 1])]
            score += factor * math.log(alpha) + math.log(c) - math.log(counts[tuple(w[i - n + 1 : i])] if n > 1 else total)
            back += n < longest
        out.append((len(w), back, round(score, 6)))
    return out


@pytest.mark.parametrize("order,min_count,chunk_bytes", [(1, 1, 1 << 20), (2, 2, 1 << 20), (2, 2, 2000), (3, 1, 5000), (3, 2, 300)])
def test_scores_equal_brute_force(spark, order, min_count, chunk_bytes):
    got = sorted((r["n_words"], r["n_backoff"], round(r["log_score"], 6)) for r in lm_score.lm_scores(frame(spark), order, 0.4, min_count, chunk_bytes=chunk_bytes).collect())
    want = sorted(brute([t for _, t in ODD], order, 0.4, min_count))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 3, 0.4, 2)))
    for r in lm_score.lm_scores(docs, 3, chunk_bytes=50_000).collect():
        n, back, score = want[r["doc_id"]]
        assert (r["n_words"], r["n_backoff"]) == (n, back) and abs(r["log_score"] - score) < 1e-4 * max(1, abs(score))
        assert (r["per_word"] is None) == (n == 0)


def test_query_scores_with_trigrams(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 3, 0.4, 2)))
    got = {r["doc_id"]: r for r in QUERIES["op8_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all((r["n_words"], r["n_backoff"]) == want[k][:2] for k, r in got.items())
    assert all(abs(r["log_score"] - want[k][2]) < 1e-4 * max(1, abs(want[k][2])) for k, r in got.items())


def test_empty(spark):
    assert lm_score.lm_scores(empty(spark)).collect() == []


def test_counts_reach_python_without_measuring_each_row(spark, monkeypatch):
    """With a bound in bytes Spark measures the batch after every one of a chunk's many short rows."""
    bounds, write = {}, DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        bounds[path.rsplit("/", 1)[1]] = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    lm_score.lm_scores(frame(spark), passes=2)
    assert {bounds["summed0"], bounds["summed1"]} == {str((1 << 31) - 1)} and int(bounds["totals0"]) == 4 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_lookup_finds_each_hash_and_no_other(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), np.arange(n, dtype=np.uint64), ~np.arange(n, dtype=np.uint64)]))
    rng.shuffle(keys)
    held, asked = keys[::2], np.append(keys, np.array([0, 1 << 63, (1 << 64) - 1], np.uint64))
    want = {k: i + 1 for i, k in enumerate(held.tolist())}
    assert lm_score.lookup(held, np.arange(1, len(held) + 1))(asked).tolist() == [want.get(k, 0) for k in asked.tolist()]


def test_texts_alike_come_together_and_make_fewer_rows(spark, monkeypatch):
    """Fifty variants each of eight texts, mixed, in about eight chunks: a chunk of all eight would repeat the rows of each."""
    rng, rows, counts = np.random.default_rng(5), [], lm_score.corpus_counts
    bases = [[f"w{k:05d}" for k in rng.integers(0, 100_000, 200)] for _ in range(8)]
    texts = []
    for k in range(400):
        words = list(bases[k % 8])
        words[rng.integers(200)] = f"own{k}"
        texts.append(" ".join(words))
    monkeypatch.setattr(lm_score, "corpus_counts", lambda grams, min_count: rows.append(grams.count()) or counts(grams, min_count))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_backoff"], r["log_score"]) for r in lm_score.lm_scores(docs, chunk_bytes=70_000).collect()}
    want = brute(texts, 3, 0.4, 2)
    assert len(got) == 400 and all(got[k][:2] == w[:2] and abs(got[k][2] - w[2]) < 1e-4 * abs(w[2]) for k, w in enumerate(want))
    assert sum(rows) < 20_000  # some 5,000 distinct n-grams of the bases, 2,400 of single variants; over 38,000 if dealt evenly


def test_chunks_of_copies_are_bounded_and_hold_each_row_once(spark, tmp_path):
    texts = ["the same text " * 20] * 300 + ["", None, "a " * 5000] + [f"word{k} " * 50 for k in range(50)]
    table = spark.createDataFrame(list(enumerate(t or "" for t in texts)), "id long, text string").repartition(3)
    lm_score.with_likeness(table).write.parquet(str(tmp_path / "t"))
    rows = lm_score.in_chunks(spark.read.parquet(str(tmp_path / "t")), 8000, 4).collect()
    assert sorted((i, n) for r in rows for i, n in zip(r["ids"], r["n_words"], strict=True)) == [(i, len((t or "").split())) for i, t in enumerate(texts)]
    own = Counter()
    for r in rows:
        assert sum(len(texts[i] or "") for i in r["ids"]) < 8000 + 10_000 and len(r["words"]) == 4 * sum(r["n_words"])
        assert len(r["own"]) == 8 * len({w for i in r["ids"] for w in (texts[i] or "").split()})
        own[r["chunk"] % 4] += len(r["ids"])
    assert len({r["chunk"] for r in rows}) == len(rows) and len(own) == 4 and max(own.values()) < 200


def test_hashes_are_written_without_a_dictionary(spark):
    from fieldweave.llm.scratch import Scratch

    scratch = Scratch(spark)
    scratch.write(spark.range(1000).selectExpr("id % 7 AS gram", "id % 7 AS total").coalesce(1), "t", "zstd", plain="gram")
    file = pq.ParquetFile(next(Path(scratch.root.removeprefix("file://"), "t").glob("*.parquet")))
    gram, total = (file.metadata.row_group(0).column(k) for k in range(2))
    assert not gram.has_dictionary_page and total.has_dictionary_page
    scratch.keep_only()
