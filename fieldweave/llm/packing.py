"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).  Pieces are taken by
falling length; each goes to the open sequence that can hold it in every dimension and scores best, by

* ``norm``: the smallest weighted squared norm of the capacity left after placing it, each dimension divided by its
  capacity; with weight on tokens alone this is best fit;
* ``dot``: the largest weighted dot product of the piece's demand and the capacity left.

If none can hold it, a sequence is opened.  Pieces are dealt by hash to groups of about ``group_pieces``, each packed in its own
task, so a group costs at most about one sequence that a single packing of everything would have filled.

Defined results: a null or empty text is one piece of length 1 (its end id); repeated rows and repeated ids are packed as
separate documents; a null id is kept; columns other than the id and the text are not read, so none can clash.  An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe
from .scratch import Scratch
from .textblocks import list_column

GROUP_PIECES = 25_000


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, added_tokens: bool = True) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` (little-endian unsigned 32-bit ids) and, by default, ``ids``.

    Only a document of more than ``max_tokens`` ids (end id included) is cut; all its pieces but the first are full.  ``added_tokens``: the
    strings of the vocabulary's added tokens get their ids, as ``tokenizers`` does by default; else they are ordinary text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(vocabulary, added_tokens)
        for batch in batches:
            for first, ids, bounds in bpe.ids(text.as_py() for text in batch.column(1)):
                of, rows, out_ids = [], [], []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    head = len(own) % max_tokens or max_tokens
                    cuts = [0, *range(head, len(own) + 1, max_tokens)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        of.append(first + d)
                        rows.append((k, x, y - x, zlib.crc32(own[x:y].tobytes())))
                    out_ids.append(own)
                k, x, n, crc = (np.array(c) for c in zip(*rows))
                columns = [batch.column(0).take(pa.array(of)), pa.array(k, pa.int32()), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(list_column(np.concatenate(out_ids).astype(np.int32), np.concatenate(([0], np.cumsum(n))), pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def vector_best_fit(lengths: np.ndarray, capacities: Sequence[int], weights: Sequence[float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece, in the order given, and the number of sequences; pieces must come by falling length."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    cap = [int(c) for c in capacities]
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    w = [weights[d] / cap[d] ** 2 for d in range(3)]
    # open sequences by tokens left, then by (documents left, attention left): equal vectors score alike
    left: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(cap[0] + 1)]
    filled = 0  # bit r: some sequence has r tokens left
    opened = 0
    for i, t in enumerate(lengths.tolist()):
        cost = t * t
        if t > cap[0] or cost > cap[2] or cap[1] < 1:
            raise ValueError(f"a piece of {t} tokens exceeds a capacity")
        best, at, rest = None, None, filled >> t
        while rest:
            r = t + ((rest & -rest).bit_length() - 1 if rule == "norm" else rest.bit_length() - 1)
            rest &= ~(1 << (r - t))
            bound = w[0] * (r - t) ** 2 if rule == "norm" else -w[0] * t * r - w[1] * cap[1] - w[2] * cost * cap[2]
            if best is not None and bound >= best:
                break
            for docs, attention in left[r]:
                if docs >= 1 and attention >= cost:
                    score = bound + w[1] * (docs - 1) ** 2 + w[2] * (attention - cost) ** 2 if rule == "norm" else -w[0] * t * r - w[1] * docs - w[2] * cost * attention
                    if best is None or score < best:
                        best, at = score, (r, docs, attention)
        if at is None:
            r, docs, attention, s = cap[0], cap[1], cap[2], opened
            opened += 1
        else:
            r, docs, attention = at
            same = left[r][(docs, attention)]
            s = same.pop()
            if not same:
                del left[r][(docs, attention)]
                if not left[r]:
                    filled &= ~(1 << r)
        sequence[i], offset[i] = s, cap[0] - r
        if r - t > 0 and docs > 1:
            left[r - t].setdefault((docs - 1, attention - cost), []).append(s)
            filled |= 1 << (r - t)
    return sequence, offset, opened


def pack(
    items: DataFrame,
    scratch: Scratch,
    max_tokens: int,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: Sequence[float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    id_col: str = "doc_id",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``items`` (rows of ``pieces``) with ``sequence_id`` and ``offset``.

    ``max_docs`` and ``max_attention`` default to what ``max_tokens`` alone implies (``max_tokens`` pieces, its square), where they
    never bind.
    """
    caps = (max_tokens, max_docs or max_tokens, max_attention or max_tokens**2)
    kept = scratch.write(items, "pieces")
    n_groups = max(1, -(-kept.count() // group_pieces))
    # the place in the written table is dealt, so that equal rows don't meet, and a lost task's rows are dealt alike again
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    dealt = kept.withColumn("pack_group", F.pmod(place, F.lit(n_groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id bigint, offset bigint"

    def run(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py() if table.num_rows else 0
        table = table.drop_columns(["pack_group"])
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset, _ = vector_best_fit(table.column("length").to_numpy(), caps, weights, rule)
        return table.append_column("sequence_id", pa.array(sequence + (group << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("pack_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, vocabulary, max_tokens, end_id, id_col, text_col, with_ids), Scratch(docs.sparkSession), max_tokens, id_col=id_col, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence with its document boundaries: ``sequence_id``, ``ids``, ``lengths``, ``n_tokens``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["length"]).alias("lengths"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["length"]).alias("n_tokens"),
    )
