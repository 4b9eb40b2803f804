import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from fieldweave.llm import packing

from .docs import ODD, empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_best_fit(lengths, caps, weights, rule):
    bins, out = [], []
    for t in lengths:
        need = (t, 1, t * t)
        best, at = None, None
        for k, left in enumerate(bins):
            if all(a >= b for a, b in zip(left, need)):
                if rule == "norm":
                    s = sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, need, caps))
                else:
                    s = -sum(w * a * b / c**2 for w, a, b, c in zip(weights, left, need, caps))
                if best is None or s < best - 1e-12:
                    best, at = s, k
        if at is None:
            bins.append(list(caps))
            at = len(bins) - 1
            best = None
        bins[at] = [a - b for a, b in zip(bins[at], need)]
        out.append((tuple(bins[at]), best))
    return out, len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 3, 10_000), (100, 50, 4_000)])
def test_best_fit_equals_brute_force(rule, caps):
    rnd = np.random.default_rng(3)
    lengths = np.sort(rnd.integers(1, 60, 300))[::-1]
    weights = (1.0, 0.01, 0.02)
    sequence, offset, n = packing.vector_best_fit(lengths, caps, weights, rule)
    want, n_want = brute_best_fit(lengths.tolist(), caps, weights, rule)
    assert n == n_want
    left = {}
    for t, s, o, (after, _) in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), want):
        a, b, c = left.get(s, caps)
        assert o == caps[0] - a
        left[s] = (a - t, b - 1, c - t * t)
        assert min(left[s]) >= 0
        assert left[s] == after


def test_documents_round_trip(spark):
    plain = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(frame(spark), PATH, max_tokens=64, end_id=0).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) <= 64
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for doc_id, text in ODD:
        if doc_id == 11:
            continue
        got = sorted(by_doc[doc_id])
        ids = [i for _, _, part in got for i in part]
        assert ids == plain.encode(text or "", add_special_tokens=False).ids + [0]
        assert [p for p, _, _ in got] == list(range(len(got))) and all(len(x) == 64 for _, _, x in got[1:])
    assert len(by_doc[11]) == 2 * len({p for p, _, _ in by_doc[11]})
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 64) + 2
    seq = packing.sequences(packing.pack_documents(frame(spark), PATH, max_tokens=64)).collect()
    assert sum(len(r["ids"]) for r in seq) == total and all(r["n_tokens"] == sum(r["lengths"]) == len(r["ids"]) for r in seq)


def test_document_capacity_binds(spark):
    rows = packing.pack_documents(frame(spark), PATH, max_tokens=2048, max_docs=2, with_ids=False).collect()
    per = {}
    for r in rows:
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + 1
    assert max(per.values()) == 2


def test_empty(spark):
    assert packing.pack_documents(empty(spark), PATH).collect() == []
