import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldweave.llm import quality_model as q
from fieldweave.llm.textblocks import blocks

from .docs import ODD, empty, frame

SF = "/root/testdata/sf0.01"


def test_contexts_equal_brute_force():
    texts = ["a b c a", None, "x", "b b B c!! AB12 ab34 ..", ""]
    (block,) = blocks(pa.array(texts))
    total = np.zeros(q.BUCKETS * q.DIM, np.int64)
    q.add_contexts(block, total, q._index_entries())
    want, index = np.zeros((q.BUCKETS, q.DIM)), q.index_vectors()
    for rows in q.units(block):
        for d in range(block.n_docs):
            own = rows[block.word_bounds[d] : block.word_bounds[d + 1]]
            for i, r in enumerate(own):
                for j in (i - 1, i + 1):
                    if 0 <= j < len(own):
                        want[r] += index[own[j]]
    assert (total.reshape(want.shape) == want).all()


def test_pooling_equals_brute_force():
    texts = ["a b c a", None, "x", "b b B c!! AB12 ab34 ..", ""]
    (block,) = blocks(pa.array(texts))
    vectors = np.random.default_rng(1).normal(size=(q.BUCKETS, q.DIM)).astype(np.float32)
    got = q.pooled(block, vectors)
    words, shapes = q.units(block)
    for d in range(block.n_docs):
        a, b = block.word_bounds[d : d + 2]
        want = np.zeros(q.N_FEATURES)
        if b > a:
            own = vectors[words[a:b]]
            want[: q.DIM], want[q.DIM : 2 * q.DIM] = own.mean(0), vectors[shapes[a:b]].mean(0)
            if b - a > 1:
                want[2 * q.DIM :] = (own[1:] * own[:-1]).mean(0)
        assert np.allclose(got[d], want, atol=1e-5)


def test_words_fold_and_shapes_are_shared():
    (block,) = blocks(pa.array(["Word wORD w0rd! ab12 cdef3456 AB"]))
    words, shapes = q.units(block)
    assert words[0] == words[1] and len(set(words.tolist())) == 5
    assert shapes[3] == shapes[4] != shapes[5]


def test_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = q.Network(hidden=16, epochs=200, rate=1e-2).fit(x, y, np.arange(400) % 5 == 0)
    assert ((net.scores(x) > 0.5) == y).mean() > 0.93


def test_temperature_calibrates():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 4))
    y = (rnd.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = q.Network().fit(x, y, np.arange(3000) % 3 == 0)
    p = net.scores(x[::3])
    for lo in (0.1, 0.4, 0.7):
        band = (p >= lo) & (p < lo + 0.2)
        assert abs(p[band].mean() - y[::3][band].mean()) < 0.1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = q.classify_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_held_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(q.fold_of(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in q.classify_quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(3, None), (None, 1)], [(3, 1), (5, 0), (6, 1), (9, 0), (10, 0), (11, 1), (12, 1), (13, 0), (99, 1), (3, 1)]])
def test_odd_labels_and_texts(spark, rows):
    out = q.classify_quality(frame(spark), spark.createDataFrame(rows, "doc_id bigint, quality int")).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)


def test_empty(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert q.classify_quality(empty(spark), labels).collect() == []


def test_sums_meet_in_levels_of_bounded_groups(spark):
    """250 small tasks: groups of at most ``fan`` blocks, and the same vectors as from one task."""
    docs = spark.createDataFrame([(k, f"the word {k % 7} and a{k % 13} there") for k in range(1000)], "doc_id bigint, text string").coalesce(1)
    one = q.context_vectors(docs)
    assert (q.context_vectors(docs.repartition(250), fan=6) == one).all()
    assert (q.context_vectors(docs.repartition(30), fan=3) == one).all()


def test_long_texts_in_steps(monkeypatch):
    texts = ["a b c a " * 9, None, "x", "b b B c!! AB12 ab34 .. " * 5, "", "end " * 11]
    (block,) = blocks(pa.array(texts))
    vectors = np.random.default_rng(1).normal(size=(q.BUCKETS, q.DIM)).astype(np.float32)
    want, total = q.pooled(block, vectors), np.zeros(q.BUCKETS * q.DIM, np.int64)
    q.add_contexts(block, total, q._index_entries())
    for step in (1, 2, 5, 7, 36):
        monkeypatch.setattr(q, "STEP_WORDS", step)
        again = np.zeros(q.BUCKETS * q.DIM, np.int64)
        q.add_contexts(block, again, q._index_entries())
        assert np.allclose(q.pooled(block, vectors), want, atol=1e-5) and (again == total).all()


def test_hashes_do_not_depend_on_the_block_size(monkeypatch):
    from fieldweave.llm import textblocks

    texts = ["alpha beta " * 50, "g" * 300, "x y z"]
    (block,) = blocks(pa.array(texts))
    want = block.word_hashes()
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 64)
    monkeypatch.setattr(textblocks._Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(textblocks._Powers, "down", np.ones(1, np.uint64))
    assert (block.word_hashes() == want).all() and len(textblocks._Powers.up) <= 65
