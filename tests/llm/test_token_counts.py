import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldweave.llm import token_counts as t

from .docs import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
VERSIONS = {"bpe": PATH, t.WORDS: None}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").withColumn("n_tokens", F.lit("clash")).withColumn("sign", F.lit("clash")).repartition(3)


ROWS = [(k, [None, "a", "b"][i % 3], ["en", None][i % 2], x) for i, (k, x) in enumerate(ODD)]


def brute(signed):
    plain, out = Tokenizer.from_file(PATH), {}
    for sign, (_, source, lang, text) in signed:
        text = text or ""
        for name, n in (("bpe", len(plain.encode(text, add_special_tokens=False).ids)), (t.WORDS, len(re.findall("[^\x20\x09-\x0d]+", text)))):
            own = out.setdefault((source, lang, name), [0, 0, 0])
            own[0] += sign
            own[1] += sign * n
            own[2] += sign * len(text)
    return {k: tuple(v) for k, v in out.items()}


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in ledger.totals().collect()}


def test_signed_batches_commit_once(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    assert totals(ledger) == {}
    first = t.deltas(t.count_tokens(table(spark, ROWS), VERSIONS))
    assert ledger.commit("load/1", first) and totals(ledger) == brute([(1, r) for r in ROWS])
    assert ledger.commit("load/1", first) and totals(ledger) == brute([(1, r) for r in ROWS])
    revised = spark.createDataFrame([("a", "en", "one two", "one two three"), (None, "en", None, "new text")], "source string, lang string, old_text string, text string")
    batch = t.changes(inserted=table(spark, ROWS[:2]), deleted=table(spark, ROWS[3:6]), revised=revised)
    sums = t.deltas(t.count_tokens(batch, VERSIONS, sign_col="sign"))
    want = brute([(1, r) for r in ROWS + ROWS[:2]] + [(-1, r) for r in ROWS[3:6]] + [(-1, (0, "a", "en", "one two")), (1, (0, "a", "en", "one two three")), (-1, (0, None, "en", None)), (1, (0, None, "en", "new text"))])
    for _ in range(2):
        ledger.commit("fix-2", sums)
        assert totals(ledger) == want
    ledger.compact("all-3")
    assert totals(ledger) == want and len(ledger.folders()) == 1
    assert not ledger.commit("load/1", first) and totals(ledger) == want


def test_unfinished_batch_is_not_read(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit("a", t.deltas(t.count_tokens(table(spark, ROWS), VERSIONS)))
    want = totals(ledger)
    ledger.commit("b", t.deltas(t.count_tokens(table(spark, ROWS), VERSIONS)))
    (tmp_path / "ledger" / "batch_id=b" / "_SUCCESS").unlink()
    assert totals(ledger) == want


def test_empty(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit("none", t.deltas(t.count_tokens(table(spark, []), VERSIONS)))
    assert totals(ledger) == {}


def test_compactions_lose_nothing(spark, tmp_path):
    """Under its own id, in a row, and if the driver is lost before the old folders are deleted."""
    ledger = t.Ledger(spark, str(tmp_path / "ledger"))
    sums = lambda rows: t.deltas(t.count_tokens(table(spark, rows), VERSIONS))
    ledger.commit("a", sums(ROWS))
    ledger.commit("b", sums(ROWS[:4]))
    want = brute([(1, r) for r in ROWS + ROWS[:4]])
    saved = {n: (tmp_path / "ledger" / f"batch_id={n}") for n in "ab"}
    copies = {n: [(f.name, f.read_bytes()) for f in p.iterdir()] for n, p in saved.items()}
    ledger.compact("c1")
    assert totals(ledger) == want
    assert not ledger.commit("c1", sums(ROWS[:1])) and totals(ledger) == want
    with pytest.raises(ValueError):
        ledger.compact("c1")
    for n, files in copies.items():  # folders that were to be deleted
        saved[n].mkdir()
        for name, content in files:
            (saved[n] / name).write_bytes(content)
    assert totals(ledger) == want and not ledger.commit("a", sums(ROWS))
    ledger.compact("c2")
    assert len(ledger.folders()) == 1 and totals(ledger) == want
    assert not any(ledger.commit(n, sums(ROWS)) for n in ("a", "b", "c1", "c2")) and totals(ledger) == want


def test_query_counts_every_document_once(spark):
    from fieldweave.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in QUERIES["op9_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    want = brute([(1, (r["doc_id"], r["source"], r["lang"], r["text"])) for r in docs])
    assert got == {(s, lang, "byte_bpe_50k" if v == "bpe" else v): n for (s, lang, v), n in want.items()}
