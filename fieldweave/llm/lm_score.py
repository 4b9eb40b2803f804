"""Stupid-backoff scores of all documents under the n-gram counts of the whole corpus.

``S(w | h) = c(h w) / c(h)`` if ``c(h w) >= min_count``, else ``alpha * S(w | h without its first word)``; for a single word,
``c(w) / N``.  Counts are over all documents, whole texts.  A document's score is the sum of ``ln S`` over its words.

The computation is relational:

1. documents are written once, sorted by the smallest hashes of their words, so that texts alike stand together, and cut into chunks of about
   ``chunk_bytes``; a chunk's texts are exploded to n-grams of all orders, one row (chunk, gram, n) for each distinct one, so a frequent
   n-gram is one row for each chunk, however often it occurs, and no key holds more than its share of one row in a chunk.  The more alike
   a chunk's texts, the fewer rows; counts and scores don't depend on how texts are dealt;
2. these rows are partitioned by the n-gram's 64-bit hash and summed there; a count is joined back to the rows of its n-gram in the
   same partitioning, by a window over it, so counts and join cost one shuffle.  Pairs and longer ones below ``min_count`` go here;
3. the rows that are left meet the words of their chunk, where each word's backoff is decided and summed by document.  A group is a
   chunk's rows, so its batches need no bound in bytes, which Spark would measure anew after every short row.

Steps 2 and 3 run in ``passes`` parts, by the n-gram's hash and by chunk, each written before the next: the shuffle files of one part
are on disk at a time, for which the chunks' words are read ``2 * passes`` times; texts are read twice.  All n-grams and all chunks are in one part or another.

All tables grow in proportion to the input: there is nothing for each pair of a chunk and a partition.

Defined results: null or empty texts have no words, ``log_score`` 0 and a null ``per_word``; ids may repeat or be null; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import UNCHECKED, Scratch
from .textblocks import U64, blocks, mix64, spans_of

CHUNK_BYTES = 4 << 20
PASSES = 4
#: Bytes of a short word.
SHORT = 3
#: Chunks in a file of theirs, about.
CHUNKS_A_FILE = 4
#: Texts hashed at a time: the arrays of eight bytes for each of theirs stay in a core's cache.
BLOCK_BYTES = 1 << 17
#: Words looked at together, for the same reason.
BLOCK_WORDS = 1 << 15


def ngram_hashes(words: np.ndarray, n_words: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to ``order``: the hash of the n-gram that ends at each word, and whether there is one (it starts in the same document).

    ``n_words`` are the documents' numbers of words.  The lowest bit says whether it is a single word.
    """
    place = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    out = [(words | U64(1), np.ones(len(words), bool))]
    mixed = words
    for n in range(2, order + 1):
        before = np.zeros(len(words), U64)
        before[1:] = mixed[:-1]
        mixed = mix64(before * U64(0x9FB21C651E98DF25) + words + U64(n))
        out.append((mixed & ~U64(1), place >= n - 1))
    return out


def with_likeness(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with the smallest hash of each text's short words and that of all its words.

    Texts of one language mostly share the first, as function words are short and few, and texts that share most words mostly share both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [[], []]
            for block in blocks(batch.column(1), BLOCK_BYTES):
                words, some = block.word_hashes(), block.n_words() > 0
                for found, h in zip(least, (np.where(block.ends - block.starts <= SHORT, words, ~U64(0)), mix64(words))):
                    found.append(np.zeros(block.n_docs, U64))
                    found[-1][some] = np.minimum.reduceat(h, block.word_bounds[:-1][some])
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x).view(np.int64)) for x in least)], ["id", "text", "alike", "alike_too"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, alike bigint, alike_too bigint")


def in_chunks(rows: DataFrame, chunk_bytes: int, files: int) -> DataFrame:
    """A row for each chunk of a written table of ``with_likeness``: (chunk, ids, n_words, words, own).

    ``own`` are the hashes of the chunk's distinct words, and ``words`` its texts, one after another, as places there, so texts are hashed once.
    A chunk's texts are neighbours by likeness in one of ``files`` ranges of it.  Many copies of a text have one likeness, so their places in
    the table deal them to several ranges.
    """
    by = ["alike", "alike_too", "place"]
    dealt = rows.withColumn("place", F.xxhash64("_metadata.file_name", "_metadata.row_index")).repartitionByRange(files, *by).sortWithinPartitions(*by)

    def row(chunk: int, ids: list[pa.Array], n_words: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        own, at = np.unique(np.concatenate(words), return_inverse=True)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(np.concatenate(n_words), pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), own))], ["chunk", "ids", "n_words", "words", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, chunk, held = TaskContext.get().partitionId(), 0, None, ([], [], [])
        for batch in batches:
            ends = before + np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            chunks = np.append(np.int64(before), ends)[:-1] // chunk_bytes * files + part
            before = int(ends[-1]) if len(ends) else before
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if chunks[a] != chunk:
                    if held[0]:
                        yield row(chunk, *held)
                    chunk, held = int(chunks[a]), ([], [], [])
                held[0].append(batch.column(0).slice(a, b - a))
                for block in blocks(batch.column(1).slice(a, b - a), BLOCK_BYTES):
                    held[1].append(block.n_words())
                    held[2].append(block.word_hashes())
        if held[0]:
            yield row(chunk, *held)

    return dealt.select("id", "text").mapInArrow(run, f"chunk int, ids array<{rows.schema['id'].dataType.simpleString()}>, n_words array<int>, words binary, own binary")


def chunk_hashes(n_words: np.ndarray, words: pa.Scalar, own: pa.Scalar, order: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(numbers of words, ``ngram_hashes``) of runs of a chunk's documents."""
    own, at = np.frombuffer(own.as_buffer(), U64), np.frombuffer(words.as_buffer(), np.int32)
    bounds = np.concatenate(([0], np.cumsum(n_words, dtype=np.int64)))
    for a, b in spans_of(bounds, BLOCK_WORDS):
        yield n_words[a:b], ngram_hashes(np.take(own, at[bounds[a] : bounds[b]]), n_words[a:b], order)


def gram_counts(chunked: DataFrame, order: int, passes: int = 1, own: int = 0) -> DataFrame:
    """(chunk, gram, n): the distinct n-grams of each chunk with their counts there.

    Only n-grams whose hash, without its lowest bit, is in the range ``own`` of ``passes`` equal ones.
    """
    low, width = U64((own << 63) // passes), U64(((own + 1) << 63) // passes - (own << 63) // passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk in enumerate(batch.column(0).to_pylist()):
                n_words = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                keys = [h[ok & ((h >> U64(1)) - low < width)] for _, hashes in chunk_hashes(n_words, batch.column(2)[k], batch.column(3)[k], order) for h, ok in hashes]
                grams, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(grams), chunk, np.int32)), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int32))})

    return chunked.select("chunk", "n_words", "words", "own").mapInArrow(run, "chunk int, gram bigint, n int")


def corpus_counts(grams: DataFrame, min_count: int) -> DataFrame:
    """(chunk, gram, total): each chunk's n-grams with their counts in the whole corpus, but for those that are never scored as such."""
    total = F.sum("n").over(Window.partitionBy("gram"))
    return grams.withColumn("total", total).filter((F.col("gram").bitwiseAND(F.lit(1)) == 1) | (F.col("total") >= min_count)).select("chunk", "gram", "total")


def lookup(keys: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from hashes to their values, 0 for others.  Hashes are spread evenly, so leading bits lead to the place, or a few before it."""
    by_key = np.argsort(keys)
    keys, values = np.append(keys[by_key], ~U64(0)), np.append(values[by_key], 0).astype(np.float64)
    bits = max(len(keys).bit_length(), 1)
    first = np.searchsorted(keys[:-1], np.arange(1 << bits, dtype=U64) << U64(64 - bits))

    def value_of(h: np.ndarray) -> np.ndarray:
        at = first[h >> U64(64 - bits)]
        below = np.flatnonzero(keys[at] < h)
        while len(below):
            at[below] += 1
            below = below[keys[at[below]] < h[below]]
        return np.where(keys[at] == h, values[at], 0.0)

    return value_of


def backoff(hashes: list[tuple[np.ndarray, np.ndarray]], count_of, min_count: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(ln S without the ``- ln N`` of single words, order used) of each word."""
    n = len(hashes[0][0])
    score, used = np.zeros(n), np.zeros(n, np.int64)
    counts: list[np.ndarray] = []
    for k, (h, ok) in enumerate(hashes):
        if k > 1:  # seen often enough only if both its parts of one word less are
            ok = ok & (counts[-1] > 0)
            ok[1:] &= counts[-1][:-1] > 0
        counts.append(np.zeros(n))
        counts[-1][ok] = count_of(h[ok])
    steps = np.zeros(n)
    for k in range(len(hashes) - 1, -1, -1):
        ok = hashes[k][1]
        take = (used == 0) & ok & ((counts[k] >= min_count) if k else True)
        at = np.flatnonzero(take)
        score[at] = np.log(counts[k][at]) + steps[at] * np.log(alpha)
        if k:
            score[at] -= np.log(counts[k - 1][at - 1])  # the history ends at the word before
            steps[ok & ~take & (used == 0)] += 1
        used[at] = k + 1
    return score, used


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, passes: int = PASSES) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_backoff`` (words scored below the longest order that their place allows), ``log_score`` and ``per_word``."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(with_likeness(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))), "texts", "zstd")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunked = scratch.write(in_chunks(rows, chunk_bytes, max(1, -(-n_bytes // (CHUNKS_A_FILE * chunk_bytes)))), "chunked", "zstd")
    scratch.keep_only("chunked")
    joined = [scratch.write(corpus_counts(gram_counts(chunked, order, passes, k), min_count), f"totals{k}", "zstd", plain="gram") for k in range(passes)]
    joined = reduce(DataFrame.unionAll, joined)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        count_of = lookup(totals.column("gram").to_numpy().view(U64), totals.column("total").to_numpy())
        ids, all_words, words, own = (chunk.column(name)[0] for name in ("ids", "n_words", "words", "own"))
        out = [[], [], [], []]
        for n_words, hashes in chunk_hashes(all_words.values.to_numpy(zero_copy_only=False), words, own, order):
            score, used = backoff(hashes, count_of, min_count, alpha)
            longest = np.sum([ok for _, ok in hashes], axis=0)
            n = len(n_words)
            doc = np.repeat(np.arange(n), n_words)
            out[0].append(n_words)
            out[1].append(np.bincount(doc[used == 1], minlength=n))
            out[2].append(np.bincount(doc[used < longest], minlength=n))
            out[3].append(np.bincount(doc, weights=score, minlength=n))
        n_words, n_single, n_backoff, partial = (np.concatenate(x) for x in out)
        return pa.table({"id": ids.values, "n_words": pa.array(n_words, pa.int64()), "n_single": pa.array(n_single, pa.int64()), "n_backoff": pa.array(n_backoff, pa.int64()), "partial": pa.array(partial, pa.float64())})

    schema, parts = f"id {id_type}, n_words bigint, n_single bigint, n_backoff bigint, partial double", []
    for k in range(passes):
        own = F.col("chunk") % passes == k
        scored = chunked.filter(own).groupBy("chunk").cogroup(joined.filter(own).groupBy("chunk")).applyInArrow(run, schema)
        parts.append(scratch.write(scored, f"summed{k}", batch_bytes=UNCHECKED))
    scratch.keep_only(*(f"summed{k}" for k in range(passes)))
    summed = reduce(DataFrame.unionAll, parts)
    n_words = summed.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("partial") - F.col("n_single") * F.lit(float(np.log(max(n_words, 1))))
    return summed.select(F.col("id").alias(id_col), "n_words", "n_backoff", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("per_word"))
