import corpus_pipeline

from .test_decontaminate import brute_plain
from .test_near_dedup import brute as brute_groups
from .test_quality_rules import brute as brute_measures

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rules, quality, groups, clean, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = rules(spark, docs, SF)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == columns
    for r in docs.collect():
        m = brute_measures(r["text"])
        fails = (
            m["n_words"] < 50
            or 100 * m["n_repeat_words"] > 50 * m["n_words"]
            or 100 * m["n_symbols"] > 20 * m["n_words"]
            or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
            or 100 * m["n_upper"] > 60 * m["n_letters"]
            or 100 * m["n_bangs"] > 30 * m["n_words"]
            or not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]
        )
        assert (r["doc_id"] in rows) == (not fails)
        assert fails or rows[r["doc_id"]] == r

    second = quality(spark, kept, SF)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    ids = {r["doc_id"] for r in second.collect()}
    assert second.columns == columns and ids <= set(rows)
    assert len((set(rows) & good) - ids) <= 0.05 * len(set(rows) & good)

    third = groups(spark, second, SF)
    texts = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert third.columns == columns
    assert sorted(r["doc_id"] for r in third.collect()) == sorted({c for _, _, c in brute_groups(texts, 5, 80)})

    fourth = clean(spark, third, SF)
    texts = [(r["doc_id"], r["text"]) for r in third.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {k for k, _ in brute_plain(texts, items, 5, 80)}
    assert fourth.columns == columns and {r["doc_id"] for r in fourth.collect()} == {k for k, _ in texts} - bad

    packed = pack(spark, fourth, SF).collect()
    assert {r["doc_id"] for r in packed} == {k for k, _ in texts} - bad
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
