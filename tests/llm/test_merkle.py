"""The Merkle manifest against one built node by node, and what its proofs must catch."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def folded_up(hashes: list[str], fan: int) -> tuple[str, list[list[list[tuple[str, bool]]]]]:
    """(root, for each leaf and level the run's hashes with a mark at the own one)."""
    steps: list[list] = [[] for _ in hashes]
    own, level = list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, at in enumerate(own):
            run = range(at // fan * fan, min(at // fan * fan + fan, len(level)))
            steps[k].append([(level[i], i == at) for i in run])
            own[k] = at // fan
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], steps


def brute(rows: list[tuple], fan: int = 16) -> list[tuple]:
    leaves = [leaf_of(r) for r in rows]
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        own = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
        subroot, steps = folded_up([leaves[i] for i in own], fan)
        subs[s] = (subroot, dict(zip(own, steps)))
    root, over = folded_up([subs[s][0] for s in sources], fan)
    out = []
    for i, r in enumerate(rows):
        subroot, steps = subs[r[1]]
        path = steps[i] + over[sources.index(r[1])]
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4]
        now = leaf_of((*r[:4], text))
        for run in path:
            now = h(*[now if mine else x for x, mine in run])
        out.append((r[0], leaves[i], subroot, root, h(*[x for run in path for x, mine in run if not mine]), now, now == root))
    return out


def sort_key(row) -> tuple:
    return tuple(str(v) for v in row)


def run(spark, rows: list[tuple], fan: int = 16) -> list[tuple]:
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = merkle.verified(merkle.manifest(docs, merkle.tampered(F.col("doc_id")), F.translate("text", merkle.UPPER, merkle.LOWER), fan))
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=sort_key)


ROWS = [
    *[(k, "a", "en", k, f"Text Number {k}") for k in range(300)],
    *[(1000 + k, "ü", None, None, "" if k % 2 else None) for k in range(17)],
    (5, None, "de", 3, "É lone"),
    (6, "", "de", 3, "empty source"),
    (None, "a", "en", 1, "no id"),
    (7, "a", "en", 7, "Text Number 7"),
    (7, "a", "en", 7, "Text Number 7"),
    (8, "a", "en", 8, "another text of one id"),
]


@pytest.mark.parametrize("fan", [2, 16])
def test_manifest_equals_the_tree_built_node_by_node(spark, fan):
    assert run(spark, ROWS, fan) == sorted(brute(ROWS, fan), key=sort_key)


def test_many_sources_and_a_lone_row(spark):
    many = [(k, f"s{k % 40}", "en", 1, "Aa") for k in range(200)]
    assert run(spark, many) == sorted(brute(many), key=sort_key)
    lone = [(1, None, None, None, None)]
    (row,) = run(spark, lone)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h() and row[6]
    assert run(spark, []) == []


def test_tampering_is_caught_where_it_changes_a_text(spark):
    rows = [(k, "a", "en", 1, "Upper" if k % 2 else "lower") for k in range(100)]
    for doc_id, *_, ok in run(spark, rows):
        assert ok == (zlib.crc32(str(doc_id).encode()) % 5 != 0 or doc_id % 2 == 0)


def test_clashing_columns_and_other_types(spark):
    docs = spark.createDataFrame([(1, "a", "en", 2, "x")], SCHEMA).withColumns({c: F.lit(0) for c in ("tree", "pos", "path", "leaf", "hash", "_at", "n_tree")})
    assert merkle.manifest(docs).count() == 1


def test_query_equals_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    got = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=sort_key) == sorted(want, key=sort_key)
