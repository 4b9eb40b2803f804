"""A ledger of quality rules: every rule is evaluated once per document, failures kept as bits beside the measurements.

``measure`` reads whole texts once (numpy over blocks of words); ``ledger`` adds ``fail_mask``, bit k for rule k; ``apply_policy`` keeps a
document if no bit of the policy's mask is set, and ``ablation`` gets what each rule alone rejects from bitwise aggregation over
the ledger, without reading a text again.  Policies are versioned lists of rule names.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at ``\\n``.  Defined results: a null or empty text has zeros everywhere and fails
``too_few_words``; ids may repeat or be null; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .textblocks import U64, Block, blocks, mix64

#: The symbols that ``n_symbols`` counts.
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs")


#: Each rule's failure in SQL; bit k of ``fail_mask`` is the k-th rule.  ``{p}`` stands for what the names of measurements begin with.
CONDITIONS = {
    "too_few_words": "{p}n_words < 50",
    "repeated_words": "100 * {p}n_repeat_words > 50 * {p}n_words",
    "symbols": "100 * {p}n_symbols > 20 * {p}n_words",
    "repeated_lines": "100 * {p}n_dup_lines > 50 * {p}n_lines",
    "shouting": "100 * {p}n_upper > 60 * {p}n_letters",
    "exclamations": "100 * {p}n_bangs > 30 * {p}n_words",
    "word_length": "{p}word_chars < 2 * {p}n_words OR {p}word_chars > 20 * {p}n_words",
}
RULES = tuple(CONDITIONS)
BASE = ("too_few_words", "repeated_words")

#: Versioned policies; a later version never changes an earlier one.
POLICIES: dict[str, tuple[str, ...]] = {"v1": RULES, "base": BASE}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _repeats(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document inside 3-word windows that its text has twice or more."""
    n = len(block.starts)
    windows, bounds = block.windows(block.word_hashes(), 3)
    doc = np.repeat(np.arange(block.n_docs), np.diff(bounds))
    _, back, count = np.unique(windows ^ mix64(doc.astype(U64)), return_inverse=True, return_counts=True)
    flagged = np.zeros(n + 2, bool)
    at = np.arange(len(windows)) + np.repeat(block.word_bounds[:-1] - bounds[:-1], np.diff(bounds))
    flagged[at] = count[back] > 1
    covered = flagged.copy()
    covered[1:] |= flagged[:-1]
    covered[2:] |= flagged[:-2]
    return covered[:n]


def _line_counts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each document, and lines with a word that equal an earlier one."""
    ends = np.flatnonzero(block.data == 10)
    # spans of lines: cut at document bounds and after each newline
    cuts = np.unique(np.concatenate((block.bounds[:-1], ends + 1)))
    cuts = cuts[cuts <= len(block.data)]
    nonempty = np.diff(block.bounds) > 0
    starts = cuts[cuts < len(block.data)] if len(block.data) else cuts[:0]
    stops = np.append(starts[1:], len(block.data))
    newline = (stops > starts) & (block.data[np.maximum(stops - 1, 0)] == 10) if len(starts) else np.zeros(0, bool)
    stops = stops - newline
    doc = np.searchsorted(block.bounds, starts, side="right") - 1
    has_word = np.searchsorted(block.starts, stops) > np.searchsorted(block.starts, starts)
    n_lines = np.bincount(doc, minlength=block.n_docs)
    # a text that ends in a newline has an empty last line
    tail = block.data[np.maximum(block.bounds[1:] - 1, 0)] == 10 if len(block.data) else np.zeros(block.n_docs, bool)
    n_lines = n_lines + (tail & nonempty)
    hashes = block.hash_spans(starts[has_word], stops[has_word])
    doc = doc[has_word]
    _, first = np.unique(hashes ^ mix64(doc.astype(U64)), return_index=True)
    return n_lines, np.bincount(doc, minlength=block.n_docs) - np.bincount(doc[first], minlength=block.n_docs)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "letter", "bang", "space", "follow")}
_IS["symbol"][list(SYMBOLS)] = True
_IS["upper"][65:91] = True
_IS["letter"][65:91] = _IS["letter"][97:123] = True
_IS["bang"][33] = True
_IS["space"][[32, 9, 10, 11, 12, 13]] = True
_IS["follow"][0x80:0xC0] = True


def block_measures(block: Block) -> list[np.ndarray]:
    """The columns of ``MEASURES``."""
    d = block.data
    n_lines, n_dup = _line_counts(block)
    covered = _repeats(block)
    return [
        block.n_words(),
        _sums(~(_IS["space"] | _IS["follow"])[d], block.bounds),
        _sums(_IS["symbol"][d], block.bounds),
        n_lines,
        n_dup,
        _sums(covered, block.word_bounds),
        _sums(_IS["upper"][d], block.bounds),
        _sums(_IS["letter"][d], block.bounds),
        _sums(_IS["bang"][d], block.bounds),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = batch.column(0).slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(m, pa.int64()) for m in block_measures(block))], [id_col, *MEASURES])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def _mask(prefix: str = "") -> Column:
    bits = [F.when(F.expr(cond.format(p=prefix)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, cond in enumerate(CONDITIONS.values())]
    return reduce(Column.bitwiseOR, bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_mask`` of every document."""
    return measure(docs, id_col, text_col).withColumn("fail_mask", _mask())


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy; a document that fails the base rules is never kept."""
    policy = mask_of(POLICIES[version])
    base = F.col("fail_mask").bitwiseAND(F.lit(mask_of(BASE))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("fail_mask").bitwiseAND(F.lit(policy)) == 0))


def keep_documents(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns; nothing is joined or shuffled."""
    names = ["_rule_" + m for m in MEASURES]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                own = batch.slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(m, pa.int64()) for m in block_measures(block))], [*own.schema.names, *names])

    measured = docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))
    policy = mask_of(POLICIES[version]) | mask_of(BASE)
    return measured.filter(_mask("_rule_").bitwiseAND(F.lit(policy)) == 0).select(*docs.columns)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """By rule of the policy: documents that fail it, documents that fail it alone (kept without it), and the OR and AND of the masks of those that fail it."""
    policy = mask_of(POLICIES[version])
    masked = rows.select(F.col("fail_mask").bitwiseAND(F.lit(policy)).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("bigint").alias("bit")) for r in POLICIES[version]])
    by = masked.select("m", "n", F.explode(rules).alias("r")).select("m", "n", "r.*")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return by.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
        F.expr("bit_or(CASE WHEN (m & bit) != 0 THEN m END)").alias("any_of"),
        F.expr("bit_and(CASE WHEN (m & bit) != 0 THEN m END)").alias("all_of"),
    )
