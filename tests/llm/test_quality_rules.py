import re
from collections import Counter

from fieldweave.llm import quality_rules as q

from .docs import ODD, empty, frame


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    ascii_letters = re.findall("[A-Za-z]", text)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "n_upper": sum(c.isupper() for c in ascii_letters),
        "n_letters": len(ascii_letters),
        "n_bangs": text.count("!"),
        "n_lines": len(lines) if text else 0,
    }


def test_measures_equal_brute_force(spark):
    texts = dict(ODD)
    rows = q.apply_policy(q.ledger(frame(spark))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        base = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["base_failed"] == base and (not base or not r["kept"])
        assert r["kept"] == (r["fail_mask"] == 0)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in q.measure(docs).collect():
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_ablation_counts(spark):
    rows = q.ledger(frame(spark))
    masks = [r["fail_mask"] for r in rows.collect()]
    for r in q.ablation(rows, "v1").collect():
        bit = 1 << q.RULES.index(r["rule"])
        assert r["bit"] == bit
        assert r["failed"] == sum(bool(m & bit) for m in masks) and r["failed_alone"] == sum(m == bit for m in masks)


def test_empty(spark):
    assert q.apply_policy(q.ledger(empty(spark))).collect() == []
