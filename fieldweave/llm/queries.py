"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, lm_score, merkle, near_dedup, packing, phrases, quality_model, quality_rules, sharding, sql, token_counts, warc
from .scratch import Scratch

#: The vocabulary file that the queries use; operators take the path as a parameter.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path(), max_tokens=2048, end_id=0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: What both turns of the conversation that the contract adds say.
PROBE = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = rows.unionByName(probe)
    done = chat.format_conversations(rows)
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85, fold=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality"), threshold=0.3, folds=5, held_fold=0)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=5, percent=80, short=True)
    return found.select("doc_id", "item_id", "n_items", "kind", "matched", "windows", "consistency", "start", "end")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v1")
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.extract_pages(_table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.lm_scores(_table(spark, sf_dir, "documents"), order=3, alpha=0.4, min_count=2)
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("per_word", 4).alias("per_word"))


def _maintained(spark: SparkSession, sf_dir: str, versions: dict[str, str | None]) -> DataFrame:
    """Totals after a load, a late load, withdrawals, revisions and replays, by which all documents end up as they are in the table.

    The load has documents 4k to 4k + 2, 4k + 2 as drafts and 4k + 1 a second time under another source; the fix revises the
    drafts and deletes the second ones; 4k + 3, and rows without an id, come late.
    """
    docs, k = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(3))
    draft = F.concat(F.coalesce("text", F.lit("")), F.lit(" and so on"))
    twice = docs.filter(k == 1).withColumn("source", F.lit("withdrawn"))
    ledger = token_counts.Ledger(spark, Scratch(spark).path("token-ledger"))
    sums = lambda **parts: token_counts.deltas(token_counts.count_tokens(token_counts.changes(**parts), versions, sign_col="sign"))
    load = sums(inserted=docs.filter(k < 3).withColumn("text", F.when(k == 2, draft).otherwise(F.col("text"))).unionByName(twice))
    fix = sums(deleted=twice, revised=docs.filter(k == 2).withColumn("old_text", draft))
    late = sums(inserted=docs.filter(k == 3))
    for name, batch in (("load-1", load), ("fix-2", fix), ("load-1", load), ("late-3", late), ("fix-2", fix)):
        ledger.commit(name, batch)
    ledger.compact("day-4")
    ledger.commit("late-3", late)
    return ledger.totals().filter("n_docs <> 0")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maintained(spark, sf_dir, {"byte_bpe_50k": vocabulary_path(), token_counts.WORDS: None})


def op9_token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_token_counts`` for the version that counts words alone, which SQL can count too."""
    return _maintained(spark, sf_dir, {token_counts.WORDS: None})


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, and what the archives say when they are read back."""
    pages = _table(spark, sf_dir, "pages")
    back = warc.read_archives(*warc.archive_pages(pages))
    return warc.typed_ids(back, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), min_count=30, top=2000)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; of those that are tampered with, texts are lower-cased (A-Z only) before they are verified."""
    docs = _table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, merkle.tampered(F.col("doc_id")), F.translate("text", merkle.UPPER, merkle.LOWER))
    return merkle.verified(found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_counts": op9_token_counts,
    "op9_token_counts_words": op9_token_counts_words,
    "op10_sharding": op10_sharding,
    "op11_warc_archive": op11_warc_archive,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": sql.CHAT_FORMATTING, "op3_minhash_near_dedup": sql.NEAR_DEDUP, "op6_quality_rules": sql.QUALITY_RULES, "op8_lm_scoring": sql.LM_SCORING, "op9_token_counts_words": sql.WORD_COUNTS, "op11_warc_archive": sql.WARC_ARCHIVE, "op12_phrase_mining": sql.PHRASE_MINING, "op13_merkle_manifest": sql.MERKLE_MANIFEST}
