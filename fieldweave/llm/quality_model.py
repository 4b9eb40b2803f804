"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

1. Random indexing over all documents: every word has a fixed sparse ternary index vector drawn from its hash; a word's context
   vector is the sum of the index vectors of its neighbours in every text.  Words share ``BUCKETS`` rows by hash; beside each
   word its shape (classes of its characters, runs collapsed) is a unit of its own, so that rare words are known too.  Tasks sum
   their own texts to a matrix of fixed size; these matrices are added up level by level, ``FAN`` tasks' blocks of rows at a time, so
   no group grows with the number of tasks.
2. A document's features are the mean context vectors of its words and shapes, and the mean products of neighbouring words'
   vectors, so also what is said twice in a row; nothing else about it is read.
3. The network (numpy; one hidden layer) learns from at most ``max_labelled`` labelled documents, those of smallest hash of their id;
   a fifth of these is held back to choose the temperature that calibrates its probabilities.  Training rows are those whose
   ``crc32(id as text) mod folds`` is not ``held_fold``.

Defined results: null or empty texts have zero features and get a score like others; labels that are null, or whose id has
no text, teach nothing; ids may repeat; with labels of less than two classes, every score is their mean, or 0.5 without any.
Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import U64, Block, blocks, mix64

BUCKETS = 1 << 14
DIM = 32
NONZERO = 2
#: The bound on labelled documents that the network is fitted on.
MAX_LABELLED = 20_000
BLOCK_ROWS = 1 << 10
#: Tasks whose sums meet in one group, at each level.
FAN = 128
#: Words whose vectors are held at once.
STEP_WORDS = 1 << 16
#: Bytes of text whose contexts are added at once; each time costs some passes over all sums.
CONTEXT_BYTES = 1 << 20

_CLASS = np.arange(256)  # shape: A upper, a lower or not ASCII, 0 digit, else the character itself
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def _shape_hashes(block: Block) -> np.ndarray:
    """Hashes of words' shapes: character classes with runs collapsed."""
    n = len(block.data)
    if not len(block.starts):
        return np.zeros(0, U64)
    kind = _CLASS[block.data].astype(np.uint8)
    keep = np.ones(n, bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[block.starts] = True
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    small = Block.__new__(Block)
    small.data = kind[keep]
    return small.hash_spans(at[block.starts], at[block.ends]) ^ U64(0x5851F42D4C957F2D)


def units(block: Block) -> list[np.ndarray]:
    """Rows of each word: of the word itself and of its shape."""
    half = U64(BUCKETS // 2 - 1)
    words = (block.word_hashes(True) >> U64(20) & half).astype(np.int64)
    shapes = (mix64(_shape_hashes(block)) >> U64(20) & half).astype(np.int64) + BUCKETS // 2
    return [words, shapes]


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of every row."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(NONZERO):
        h = mix64(np.arange(BUCKETS, dtype=U64) * U64(NONZERO) + U64(k + 1))
        np.add.at(out, (np.arange(BUCKETS), (h % U64(DIM)).astype(np.int64)), np.where(h >> U64(40) & U64(1), 1, -1))
    return out


def _index_entries() -> tuple[np.ndarray, np.ndarray]:
    h = [mix64(np.arange(BUCKETS, dtype=U64) * U64(NONZERO) + U64(k + 1)) for k in range(NONZERO)]
    return np.stack([(x % U64(DIM)).astype(np.int64) for x in h]), np.stack([np.where(x >> U64(40) & U64(1), 1.0, -1.0) for x in h])


def add_contexts(block: Block, total: np.ndarray, entries: tuple[np.ndarray, np.ndarray]) -> None:
    """Add the index vectors of each word's two neighbours to the rows of its units; ``total`` is flat, int64."""
    slot, sign = entries
    same = np.ones(max(len(block.starts) - 1, 0), bool)
    cuts = block.word_bounds[1:-1]
    same[cuts[(cuts > 0) & (cuts < len(block.starts))] - 1] = False
    left = np.flatnonzero(same)
    for rows in units(block):
        for first in range(0, len(left), STEP_WORDS):
            at = left[first : first + STEP_WORDS]
            for a, b in ((rows[at], rows[at + 1]), (rows[at + 1], rows[at])):
                for k in range(NONZERO):
                    total += np.bincount(a * DIM + slot[k][b], sign[k][b], total.size).astype(np.int64)  # exact below 2**53


def _added_up(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK_ROWS * DIM, np.int64)
    for x in table.column("sums"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"part": table.column("part").slice(0, 1), "task": table.column("next").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def context_vectors(docs: DataFrame, text_col: str = "text", fan: int = FAN) -> np.ndarray:
    """Unit context vectors of all rows, summed over all documents; a matrix of fixed size."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, entries, any_rows = np.zeros(BUCKETS * DIM, np.int64), _index_entries(), False
        for batch in batches:
            for block in blocks(batch.column(0), CONTEXT_BYTES):
                any_rows = True
                add_contexts(block, total, entries)
        if any_rows:
            parts = total.reshape(-1, BLOCK_ROWS * DIM)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "task", "sums"])

    schema = "part int, task int, sums binary"
    scratch, level = Scratch(docs.sparkSession), 0
    sums = scratch.write(docs.select(F.col(text_col)).mapInArrow(own, schema), "sums0")
    while (sums.agg(F.max("task")).first()[0] or 0) > 0:
        level += 1
        met = sums.withColumn("next", F.floor(F.col("task") / fan).cast("int")).groupBy("part", "next").applyInArrow(_added_up, schema)
        sums = scratch.write(met, f"sums{level}")
        scratch.drop(f"sums{level - 1}")
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in sums.collect():  # BUCKETS / BLOCK_ROWS rows
        out[r["part"] * BLOCK_ROWS : (r["part"] + 1) * BLOCK_ROWS] = np.frombuffer(r["sums"], np.int64).reshape(BLOCK_ROWS, DIM)
    scratch.drop(f"sums{level}")
    return normalised(out)


def normalised(sums: np.ndarray) -> np.ndarray:
    out = sums.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.where(norm > 0, out / np.maximum(norm, 1e-9), 0).astype(np.float32)
    # rows never seen keep their index vector
    idle = norm[:, 0] == 0
    out[idle] = index_vectors()[idle] / np.sqrt(NONZERO)
    return out


N_FEATURES = 3 * DIM


def pooled(block: Block, vectors: np.ndarray) -> np.ndarray:
    """Features of the documents of a block; the vectors of ``STEP_WORDS`` words are held at once."""
    words, shapes = units(block)
    total, doc = np.zeros((block.n_docs, N_FEATURES)), block.word_docs()
    for first in range(0, len(words), STEP_WORDS):
        last = min(first + STEP_WORDS, len(words))
        of = doc[first:last]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        own = vectors[words[first : last + 1]]
        pairs = own[: last - first].copy()
        pairs[: len(own) - 1] *= own[1:]
        pairs[(block.word_bounds[1:][of[starts]] - 1 - first)[block.word_bounds[1:][of[starts]] <= last]] = 0  # a document's last word has no neighbour
        for k, x in enumerate((own[: last - first], vectors[shapes[first:last]], pairs)):
            total[of[starts], k * DIM : (k + 1) * DIM] += np.add.reduceat(x, starts)
    counts = block.n_words()[:, None]
    total[:, : 2 * DIM] /= np.maximum(counts, 1)
    total[:, 2 * DIM :] /= np.maximum(counts - 1, 1)
    return total.astype(np.float32)


class Network:
    """Standardised features, one hidden layer of tanh units, a sigmoid with a temperature."""

    def __init__(self, hidden: int = 32, seed: int = 7, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4):
        self.hidden, self.seed, self.epochs, self.batch, self.rate, self.decay = hidden, seed, epochs, batch, rate, decay
        self.constant: float | None = 0.5
        self.temperature = 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits(x.astype(np.float64)) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
        """``held``: rows kept for the temperature."""
        if len(y) == 0 or len(set(y[~held].tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.constant = None
        x, rnd = x.astype(np.float64), np.random.default_rng(self.seed)
        xt, yt = x[~held], y[~held].astype(np.float64)
        self.mean, self.scale = xt.mean(0), xt.std(0) + 1e-6
        self.w1 = rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden))
        self.b1, self.w2, self.b2 = np.zeros(self.hidden), rnd.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)
        z = np.clip((xt - self.mean) / self.scale, -8, 8)
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(self.epochs):
            rate = self.rate * (1 - epoch / self.epochs)
            order = rnd.permutation(len(yt))
            for at in range(0, len(order), self.batch):
                rows = order[at : at + self.batch]
                a = np.tanh(z[rows] @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(a @ self.w2 + self.b2, -60, 60)))
                g = (p - yt[rows]) / len(rows)
                ga = np.outer(g, self.w2) * (1 - a * a)
                grads = [z[rows].T @ ga + self.decay * self.w1, ga.sum(0), a.T @ g + self.decay * self.w2, np.array([g.sum()])]
                t += 1
                for param, grad, m, v in zip(params, grads, first, second):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if held.any():
            logits, truth, grid = self._logits(x[held]), y[held], np.geomspace(0.2, 5, 49)
            loss = [np.logaddexp(0, np.where(truth > 0, -logits, logits) / c).mean() for c in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def fold_of(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def _features(docs: DataFrame, vectors, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                x = pooled(block, vectors.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n_docs), pa.array([r.tobytes() for r in x], pa.binary())], [id_col, "x"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, x binary")


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0, max_labelled: int = MAX_LABELLED
) -> tuple[np.ndarray, Network]:
    """(context vectors, network).  The driver gets the vectors, of fixed size, and at most ``max_labelled`` pooled documents: of texts that share an id, one."""
    vectors = context_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (fold_of(F.col("_id"), folds) != held_fold))
    sample = usable.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    taught = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id", "left_semi")  # at most max_labelled ids
    rows = _features(taught, shared, "_id", "_text").join(sample, "_id").select("_id", "_y", "x").groupBy("_id").agg(F.max("_y").alias("_y"), F.min("x").alias("x"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) == 0).collect()
    rows.sort(key=lambda r: str(r["_id"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, N_FEATURES), np.float32)
    y, held = np.array([r["_y"] for r in rows]), np.array([r["held"] for r in rows], bool)
    return vectors, Network().fit(x, y, held)


def score_quality(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = model.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n_docs), pa.array(net.scores(pooled(block, v)), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    vectors, network = fit_quality(docs, labels, label_col, id_col, text_col, folds, held_fold, max_labelled)
    scored = score_quality(docs, vectors, network, id_col, text_col)
    return scored.select(id_col, F.coalesce(fold_of(F.col(id_col), folds) == held_fold, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of at least this score, with their columns; scoring neither joins nor shuffles."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label_col, id_col, text_col, **options))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = model.value
        for batch in batches:
            for block in blocks(batch.column(at)):
                keep = net.scores(pooled(block, v)) >= threshold
                yield batch.slice(block.first, block.n_docs).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
