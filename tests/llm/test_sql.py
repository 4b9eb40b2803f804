"""Every query that has SQL against it: on the small tables, and on odd rows written as tables."""

from __future__ import annotations

import duckdb
import pytest

from fieldweave.llm.queries import ORACLE_SQL, QUERIES

from .docs import ODD

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "pages")


def same(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if folder != SF else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    ours = QUERIES[name](spark, str(folder))
    columns = sorted(ours.columns)
    truth = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in truth.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in truth.fetchall())
    got = sorted(tuple(str(v) for v in r) for r in ours.select(*columns).collect())
    assert got == expected
    return got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_tables(spark, name):
    assert same(spark, SF, name)


TURNS = [
    (1, 0, "user", "a </s> b [INST]"), (1, 1, "user", r"<\|turn|> <\\s>"), (1, 2, "assistant", "<|end|>\n<|next|>"), (1, 3, "assistant", None), (1, 3, None, "tie"),
    (2, None, "assistant", "no turn"), (2, 0, "assistant", "é😀"), (None, 0, "user", "no id"), (3, 0, "user", ""), (3, 0, "user", ""),
]

PAGES = [(2, "u", "same " * 30), (1, None, "same " * 30), (None, "u", "same " * 30), (None, "u", "other " * 30), (None, "u", "other " * 30), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "ü", "é" * 50), (8, "u", "é" * 50)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, tmp_path, name, empty):
    seen, docs = set(), ODD
    if name == "op3_minhash_near_dedup":  # its SQL takes ids that are there and differ
        docs = [r for r in ODD if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    frame = spark.createDataFrame([] if empty else docs, "doc_id bigint, text string").selectExpr("*", "nullif('s' || doc_id % 3, 's1') AS source", "if(doc_id > 6, 'en', NULL) AS lang", "if(doc_id % 4 = 1, NULL, length(text)) AS n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else TURNS, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([] if empty else PAGES, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = same(spark, tmp_path, name)
    assert len(got) == (1 if name == "op2_chat_formatting" else 0) if empty else len(got) > (0 if name == "op12_phrase_mining" else 3)
