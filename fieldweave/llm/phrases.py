"""Collocations of two to four words by contiguous pattern growth.

Words are numbered by a 64-bit hash of the language and the word, so a phrase is up to four numbers and belongs to one language; the
vocabulary is checked for two words of one number, and all is numbered anew with another seed if there are such.

1. Words are counted.  A phrase can be frequent only if its words and pairs are, so a fixed-size bitmap of the frequent words' numbers, then one of the
   frequent pairs', says which occurrences are worth projecting.  A bitmap may let through more (two numbers in one place), never less, and doesn't grow with the data.
2. Every occurrence of a word that starts a frequent pair is projected: a pointer to what follows it, up to three words as far as pairs stay
   frequent, with the number of its like.  Equal projections are summed up, first in the task and then by Spark, so a passage that is everywhere is one row.
3. One task grows each frequent prefix: from the pointers of its projection it recursively extends to the right, depth first, as long as the
   sum is ``min_count`` or more.  A prefix is one word; where its projection has more than ``most`` rows, which are counted, Spark sums up its
   extensions instead, and each of these is a prefix of its own, of two, three or four words.  So no task holds more than ``most`` rows and their like.
4. What longer phrases contain goes by one aggregate.  Phrases with ``min_count`` occurrences grow faster in number than the texts do, so counts of parts are not joined to
   all of them: a phrase's prefix alone bounds its score from above.  Those of the best bounds are scored first; the ``top``-th of their scores is one that
   every phrase of the result must reach, so only phrases whose bound does are scored then.  The result is that of scoring all.

Defined results: null texts have no words and a null language is ``und``; repeated rows count as often as they come; ids and other columns are not read;
ties go by the phrase's bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import U64, Block, blocks, mix64

LONGEST = 4
W = tuple(f"w{k}" for k in range(1, LONGEST + 1))
_PHRASE = ", ".join(f"{w} bigint" for w in W)
BLOCK_BYTES = 4 << 20
#: Places of a bitmap, as a power of two: 8 MB of bits, whatever the input.
BITS = 26
#: Rows of a projection that one task grows.
MOST = 1 << 18
UNKNOWN = "und"
_CUTS = np.zeros(256, bool)
_CUTS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _CUTS.copy()
_BETWEEN[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Numbers of a block's words (never 0), and whether each one follows the word before it in the same piece."""

    def __init__(self, block: Block, langs: list[str], seed: int):
        self.block, self.langs = block, langs
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") for x in langs], U64)
        self.docs = block.word_docs()
        self.numbers = np.maximum(mix64(block.hash_spans(block.starts, block.ends, True, seed) ^ salt[self.docs]), U64(1))
        cuts = np.concatenate(([0], np.cumsum(_CUTS[block.data])))
        self.follows = np.zeros(len(self.docs), bool)
        self.follows[1:] = (self.docs[1:] == self.docs[:-1]) & (cuts[block.starts[1:]] == cuts[block.ends[:-1]])

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at these places, lower-cased."""
        starts, sizes = self.block.starts[at], (self.block.ends - self.block.starts)[at]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        data = _LOWER[self.block.data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)]]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())

    def pairs(self) -> np.ndarray:
        """A number for each pair of the word before and the word; 0 where they don't follow each other."""
        out = np.zeros(len(self.numbers), U64)
        out[1:] = mix64(self.numbers[:-1] * U64(0x9E3779B97F4A7C15) + self.numbers[1:])
        return np.where(self.follows, np.maximum(out, U64(1)), U64(0))


def words_of(batch: pa.RecordBatch, seed: int) -> Iterator[Words]:
    langs = batch.column(0).to_pylist()
    for block in blocks(batch.column(1), BLOCK_BYTES, _BETWEEN):
        yield Words(block, langs[block.first : block.first + block.n_docs], seed)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text"), F.xxhash64(lang).alias("g"))


def word_counts(texts: DataFrame, seed: int = 0) -> DataFrame:
    """(id, lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch, seed):
                ids, first, n = np.unique(words.numbers, return_index=True, return_counts=True)
                langs = pa.array(words.langs, pa.string()).take(pa.array(words.docs[first]))
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), langs, words.texts(first), pa.array(n)], ["id", "lang", "word", "n"])

    return texts.mapInArrow(run, "id bigint, lang string, word string, n bigint").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, scratch: Scratch, min_count: int, seeds: range = range(8)) -> tuple[DataFrame, int]:
    """``word_counts`` written, and a seed under which no two words share a number that is frequent."""
    for seed in seeds:
        words = scratch.write(word_counts(texts, seed), f"words{seed}", "zstd")
        same = words.groupBy("id").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
        if same.filter((F.col("words") > 1) & (F.col("n") >= min_count)).isEmpty():
            return words, seed
    raise ValueError(f"two words have one number under each of {len(seeds)} seeds")


def bitmap(numbers: Column, rows: DataFrame, bits: int = BITS) -> Broadcast:
    """Bits at the places of these numbers, sent to all tasks: always 2 ** ``bits`` of them."""
    chunk = min(16, bits)

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << chunk, bool)
        own[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    places = rows.select(F.shiftrightunsigned(numbers, 64 - bits).alias("place")).distinct()
    packed = places.select(F.shiftrightunsigned("place", chunk).alias("chunk"), F.col("place").bitwiseAND((1 << chunk) - 1).alias("bit")).groupBy("chunk").applyInArrow(pack, "chunk bigint, bits binary")
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in packed.collect():  # 2 ** (bits - 16) rows of 8 KiB at most
        at = r["chunk"] << chunk >> 3
        out[at : at + (1 << chunk >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


def marked(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether a bitmap has these numbers' places."""
    place = numbers >> U64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1).astype(bool)


def pair_counts(texts: DataFrame, seed: int, known: Broadcast) -> DataFrame:
    """(pair, n): pairs of frequent words by number; pairs of one number count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for words in words_of(batch, seed):
                frequent, pairs = marked(words.numbers, bits), words.pairs()
                pairs = pairs[1:][frequent[1:] & frequent[:-1] & (pairs[1:] != 0)]
                ids, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], ["pair", "n"])

    return texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number from 0 for each pair of values of two arrays of small numbers."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def projections(texts: DataFrame, seed: int, known: Broadcast) -> DataFrame:
    """(w1, w2, w3, w4, g, n): what starts with a frequent pair and goes on as long as pairs are frequent, 0 from there on; ``g``: the language's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            tongues = batch.column(2).to_numpy()
            for words in words_of(batch, seed):
                pairs = words.pairs()
                good = marked(pairs, bits) & (pairs != 0)
                at = np.flatnonzero(good[1:])  # pointers to the first words
                if not len(at):
                    continue
                columns, going = [words.numbers[at]], np.ones(len(at), bool)
                ids, goods = np.append(words.numbers, np.zeros(LONGEST, U64)), np.append(good, np.zeros(LONGEST, bool))
                for k in range(1, LONGEST):
                    going = going & goods[at + k]
                    columns.append(np.where(going, ids[at + k], U64(0)))
                codes = np.unique(np.concatenate(columns), return_inverse=True)[1].reshape(LONGEST, -1)
                _, first, n = np.unique(_dense(_dense(codes[0], codes[1]), _dense(codes[2], codes[3])), return_index=True, return_counts=True)
                g = tongues[words.block.first + words.docs[at[first]]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[first].view(np.int64)) for c in columns), pa.array(g), pa.array(n)], [*W, "g", "n"])

    return texts.mapInArrow(run, f"{_PHRASE}, g bigint, n bigint").groupBy(*W, "g").agg(F.sum("n").alias("n"))


def with_depth(projected: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """``projected`` with ``depth``: the number of words of the prefix whose task grows the row, so that no prefix has more than ``most`` rows."""
    rows = projected.withColumn("depth", F.lit(1))
    for d in range(1, LONGEST):
        keys = list(W[:d])
        large = scratch.write(rows.filter(F.col("depth") == d).groupBy(*keys).count().filter(F.col("count") > most).select(*keys, F.lit(True).alias("large")), f"large{d}")
        if large.isEmpty():
            break
        rows = scratch.equi_join(rows, large, keys, "left").withColumn("depth", F.when((F.col("depth") == d) & F.col("large"), d + 1).otherwise(F.col("depth"))).drop("large")
    return rows


def grow(columns: list[np.ndarray], n: np.ndarray, depth: int, min_count: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Frequent phrases that start with the ``depth`` words that all rows share, and their counts."""
    phrases: list[tuple[int, ...]] = []
    counts: list[int] = []

    def extend(prefix: tuple[int, ...], at: np.ndarray) -> None:
        following = columns[len(prefix)][at]
        order = np.argsort(following, kind="stable")
        at, following = at[order], following[order]
        first = int(np.searchsorted(following, 1)) if len(following) and following[0] == 0 else 0
        at, following = at[first:], following[first:]
        if not len(at):
            return
        starts = np.concatenate(([0], np.flatnonzero(following[1:] != following[:-1]) + 1))
        sums, ends = np.add.reduceat(n[at], starts), np.append(starts[1:], len(at))
        for k in np.flatnonzero(sums >= min_count).tolist():
            take((*prefix, int(following[starts[k]])), int(sums[k]), at[starts[k] : ends[k]])

    def take(prefix: tuple[int, ...], count: int, at: np.ndarray) -> None:
        phrases.append(prefix)
        counts.append(count)
        if len(prefix) < LONGEST:
            extend(prefix, at)

    everything = np.arange(len(n))
    total = int(n.sum())
    shared = tuple(int(c[0]) for c in columns[:depth])
    if total >= min_count and all(shared):  # a 0: no phrase of so many words, Spark's sums have its shorter ones
        if depth == 1:
            extend(shared, everything)
        else:
            take(shared, total, everything)
    return phrases, counts


def grown(rows: DataFrame, min_count: int) -> DataFrame:
    """(w1, w2, w3, w4, g, a, l_least) of the frequent phrases that start with each prefix, a run of sorted rows for each; each first part has ``l_least`` occurrences at least."""
    prefix = [F.when(F.col("depth") >= d, F.col(w)).otherwise(F.lit(0)).alias(f"p{d}") for d, w in enumerate(W, 1)]
    keys = [f"p{d}" for d in range(1, LONGEST + 1)]
    dealt = rows.select(*prefix, "depth", *W, "g", "n").repartition(*keys).sortWithinPartitions(*keys)

    def batch_of(phrases: list[tuple[int, ...]], counts: list[tuple[int, int, int]]) -> pa.RecordBatch:
        table = np.zeros((len(phrases), LONGEST), U64)
        for k, p in enumerate(phrases):
            table[k, : len(p)] = p
        numbers = np.array(counts, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([*(pa.array(table[:, k].copy().view(np.int64)) for k in range(LONGEST)), *(pa.array(numbers[:, k].copy()) for k in range(3))], [*W, "g", "a", "l_least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last run, which may go on in the next batch
        phrases: list[tuple[int, ...]] = []
        counts: list[tuple[int, int, int]] = []

        def finish() -> None:
            table = np.concatenate(held, axis=1)
            n = table[-1]
            found, a = grow([table[k].view(U64) for k in range(LONGEST + 1, 2 * LONGEST + 1)], n, int(table[LONGEST, 0]), min_count)
            g, total = int(table[-2, 0]), int(n.sum())
            phrases.extend(found)
            counts.extend((g, x, total) for x in a)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64)
            starts = np.concatenate(([0], np.flatnonzero((table[:LONGEST, 1:] != table[:LONGEST, :-1]).any(axis=0)) + 1, [table.shape[1]]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if held and (held[-1][:LONGEST, -1] != table[:LONGEST, a]).any():
                    finish()
                    held = []
                held.append(table[:, a:b])
            held[-1] = held[-1].copy()  # lets the batch go
            if len(phrases) >= 10_000:
                yield batch_of(phrases, counts)
                phrases, counts = [], []
        if held:
            finish()
        yield batch_of(phrases, counts)

    return dealt.mapInArrow(run, f"{_PHRASE}, g bigint, a bigint, l_least bigint")


def summed(rows: DataFrame, length: int) -> DataFrame:
    """(w1, w2, w3, w4, g, a, l_least) of the prefixes of ``length`` words that no task grows, as their rows are dealt by longer ones."""
    keys = list(W[:length])
    sums = rows.filter((F.col("depth") > length) & (F.col(W[length - 1]) != 0)).groupBy(*keys).agg(F.max("g").alias("g"), F.sum("n").alias("a"))
    return sums.select(*keys, *[F.lit(0).cast("bigint").alias(w) for w in W[length:]], "g", "a", F.col("a").alias("l_least"))


def frequent_phrases(texts: DataFrame, seed: int, words: DataFrame, scratch: Scratch, min_count: int, most: int = MOST, bits: int = BITS) -> DataFrame:
    """(w1, w2, w3, w4, g, a, l_least) of all phrases of two to four words with ``min_count`` occurrences or more; ``words``: the frequent ones."""
    pairs = scratch.write(pair_counts(texts, seed, bitmap(F.col("id"), words, bits)).filter(F.col("n") >= min_count), "pairs")
    projected = scratch.write(projections(texts, seed, bitmap(F.col("pair"), pairs, bits)), "projected", "zstd")
    rows = with_depth(projected, scratch, most)
    found = reduce(DataFrame.unionAll, [grown(rows, min_count), *(summed(rows, k) for k in range(2, LONGEST))])
    found = scratch.write(found.filter(F.col("a") >= min_count), "phrases")
    scratch.drop("projected", "pairs")
    return found


def _phrase(*words: Column) -> list[Column]:
    """Columns of a phrase of these words, 0 for those that it hasn't."""
    return [w.alias(name) for w, name in zip([*words, *[F.lit(0).cast("bigint")] * (LONGEST - len(words))], W)]


def _length() -> Column:
    return F.lit(2) + F.when(F.col("w3") != 0, 1).otherwise(0) + F.when(F.col("w4") != 0, 1).otherwise(0)


def scored(candidates: DataFrame, phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``candidates`` (w1, w2, w3, w4, g, a) with ``l``, ``r`` and ``score`` of their lowest-scoring cut, by the counts of all ``phrases`` and ``words``."""
    counts = phrases.select(*W, "a").unionByName(words.select(*_phrase(F.col("id")), F.col("n").alias("a"))).select(*[F.col(w).alias(f"p{w}") for w in W], F.col("a").alias("f"))
    cuts = []
    for m in range(2, LONGEST + 1):
        ids = [F.col(w) for w in W[:m]]
        parts = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *_phrase(*part)) for k in range(1, m) for side, part in (("l", ids[:k]), ("r", ids[k:]))]
        cuts.append(F.when(_length() == m, F.array(*parts)))
    own = [*W, "g", "a"]
    parts = candidates.select(*own, F.explode(F.coalesce(*cuts)).alias("part")).select(*own, "part.k", "part.side", *[F.col(f"part.{w}").alias(f"p{w}") for w in W])
    met = parts.join(counts, [f"p{w}" for w in W])
    sides = {f"{side}{k}": F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f"))) for k in range(1, LONGEST) for side in "lr"}
    wide = met.groupBy(*own).agg(*[c.alias(name) for name, c in sides.items()])
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(_score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    return wide.withColumn("cut", F.array_min(F.array(*cut))).select(*own, "cut.l", "cut.r", "cut.score")


def _score(left: str, right: str) -> Column:
    """floor(2000000 * a / (left + right)), in numbers of up to 38 digits."""
    return F.expr(f"(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST({left} AS DECIMAL(20, 0)) + CAST({right} AS DECIMAL(20, 0)))")


def outermost(phrases: DataFrame, within: tuple[int, int]) -> DataFrame:
    """``phrases`` without those inside a longer one whose count is at least ``within[0] / within[1]`` of theirs."""
    inner = []
    for m in range(3, LONGEST + 1):
        ids = [F.col(w) for w in W[:m]]
        inner.append(F.when(_length() == m, F.array(*[F.struct(*_phrase(*ids[i : i + size])) for size in range(2, m) for i in range(m - size + 1)])))
    none = F.lit(None).cast("bigint")
    parts = phrases.filter("w3 <> 0").select(F.explode(F.coalesce(*inner)).alias("part"), "a").select(*[f"part.{w}" for w in W], none.alias("g"), none.alias("a"), none.alias("l_least"), F.col("a").alias("longest"))
    met = phrases.select(*W, "g", "a", "l_least", none.alias("longest")).unionAll(parts).groupBy(*W).agg(*[F.max(c).alias(c) for c in ("g", "a", "l_least", "longest")])
    return met.filter(F.expr(f"longest IS NULL OR CAST(longest AS DECIMAL(20, 0)) * {within[1]} < CAST(a AS DECIMAL(20, 0)) * {within[0]}")).drop("longest")


def best_scored(candidates: DataFrame, phrases: DataFrame, words: DataFrame, scratch: Scratch, top: int, probes: int = 8) -> DataFrame:
    """The candidates of each language, scored, that can be among its ``top``; ``probes`` times as many are scored to find what score that takes."""
    bounded = scratch.write(candidates.withColumn("bound", _score("l_least", "a")), "candidates")
    by_bound = Window.partitionBy("g").orderBy(F.desc("bound"), F.desc("a"), *W)
    probed = bounded.withColumn("place", F.row_number().over(by_bound)).filter(F.col("place") <= probes * top)
    by_score = Window.partitionBy("g").orderBy(F.desc("score"))
    place = scored(probed, phrases, words).withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= top)
    reach = place.filter(F.col("place") == top).select("g", F.col("score").alias("reach"))  # none in languages with fewer phrases, which all count
    reach = scratch.write(reach, "reach")
    short = bounded.select("g").distinct().join(reach, "g", "left_anti").select("g", F.lit(0).cast("bigint").alias("reach"))
    reach = scratch.write(reach.unionAll(short), "reaches")
    near = scratch.equi_join(bounded, reach.withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")) & (F.col("bound") >= F.col("reach")))
    return scored(near.select(*W, "g", "a"), phrases, words)


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text", within: tuple[int, int] = (80, 100), most: int = MOST, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    A phrase goes if its words lie inside a longer one whose count is at least ``within[0] / within[1]`` of its own.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _texts(docs, lang_col, text_col)
    every, seed = vocabulary(texts, scratch, min_count)
    words = scratch.write(every.filter(F.col("n") >= min_count), "frequent")
    sizes = scratch.write(every.groupBy("lang").agg(F.sum("n").alias("size")).withColumn("g", F.xxhash64("lang")), "sizes")
    if not sizes.groupBy("g").count().filter("count > 1").isEmpty():
        raise ValueError("two languages have one number")
    scratch.drop(f"words{seed}")
    phrases = frequent_phrases(texts, seed, words, scratch, min_count, most, bits)
    found = best_scored(outermost(phrases, within), phrases, words, scratch, top)
    best = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"))
    cut = scratch.write(found.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"), "best")
    spelled = cut.select("*", F.posexplode(F.array(*W)).alias("at", "id")).filter("id <> 0").join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = spelled.groupBy(*W, "g", "a", "l", "r", "score").agg(phrase.alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    done = named.withColumn("rank", rank).filter(F.col("rank") <= top).join(sizes, "g")
    return done.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("size").alias("n"), "score")
