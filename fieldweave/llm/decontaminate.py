"""Benchmark decontamination by template canonicalisation.

A word is canonicalised to a typed placeholder, or to its core (punctuation at its ends cut, A-Z lower-cased):

* ``<num>``: a word with a digit; letters after its digits are kept as a unit (``12km`` is a number with a unit);
* ``<unit>``: a unit of ``UNITS`` after a number;
* ``<name>``: a word whose first letter is upper case and whose second is not.

Windows of ``size`` canonical words of the benchmark are hash-joined with those of the documents, once as templates and once as
plain words (no placeholders), so a copy in another case is found as well as a question with other numbers and names.  Template windows
need at least two plain words.

Matched windows of a document and an item are grouped to occurrences: in an occurrence the places in the document and in the item both
go up, no step is over the larger of four windows and half the item, and no two steps differ by more than the larger of two windows and a quarter of the
item, so words may be changed, left out or put in.  An occurrence is a copy if its windows cover ``percent`` of the item's words that
windows can cover, or if they cover ``run`` words (``TEMPLATE_RUN`` for templates) that follow one another in both texts.  For templates, the slots' values must also be
consistent: over the slots of the occurrence, each value of the item is answered by one value of the document (by majority, in
``percent`` of the slots), else the windows met by chance.  A document without such an occurrence still holds the item if it has ``percent`` of the item's distinct
windows of a kind anywhere, in any order, with slots consistent over all of them.

Items that no document can tell apart are one class and met once: for plain words those with the same words, for templates those with the
same template whose slots hold equal values at the same places.  A document's row names the class by its smallest item id and says how many
``n_items`` it has; ``item_members`` lists them.  So a bank of questions of one template costs each document one row, not one for each question.

With ``short`` set, an item of fewer than ``size`` words is found where it is a document's whole text (kind 2), and only there.

The benchmark's windows go to every task if their number, which is counted, is at most ``broadcast_windows``; beyond, the
documents' windows are shuffled and joined by hash.  Matches are dealt by document and item and read in the order of their places.

Defined results: null or empty texts and items hold no windows; items of fewer than ``size`` words never match without ``short``; a change in every ``size`` words or less leaves no window, so such a copy isn't found; repeated
rows of one id and text give one row; a null id is kept, and an item's null id doesn't count in ``n_items``; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import U64, Block, blocks, mix64

BROADCAST_WINDOWS = 1 << 20
#: Words in a row that make a copy, for plain words and for templates, which more texts share.
RUN, TEMPLATE_RUN = 10, 13
#: Units of measure, as they are written after a number.
UNITS = (
    "mm cm dm m km inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds gram grams kilogram kilograms ton tons ml cl l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years k mph kmh percent % dollar dollars euro euros cent cents $ € £ degree degrees c f watt watts w kw volt volts v"
).split()

_NUM, _UNIT, _NAME = (mix64(np.array([k], U64))[0] for k in (101, 102, 103))
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Canonical:
    """Words of a block with their placeholders."""

    def __init__(self, block: Block):
        self.block, n = block, len(block.data)
        starts, ends = block.starts, block.ends
        at = np.flatnonzero(_ALNUM[block.data])
        # cores: from the first to the last letter or digit; a word without any is itself
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
        has = hi > lo
        self.core_start, self.core_end = starts.copy(), ends.copy()
        self.core_start[has], self.core_end[has] = at[lo[has]], at[hi[has] - 1] + 1
        self.plain = block.hash_spans(self.core_start, self.core_end, fold=True)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[block.data]))) if n else np.zeros(1, np.int64)
        number = digits[ends] > digits[starts]
        first = block.data[self.core_start] if n else np.zeros(0, np.uint8)
        second = block.data[np.minimum(self.core_start + 1, n - 1)] if n else first
        long = self.core_end - self.core_start > 1
        upper = (first >= 65) & (first <= 90) & ~((second >= 65) & (second <= 90) & long) & long
        # Latin capitals of two bytes: U+00C0-00DE
        upper |= (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (self.core_end - self.core_start > 2)
        after_number = np.zeros(len(starts), bool)
        after_number[1:] = number[:-1]
        heads = block.word_bounds[:-1]
        after_number[heads[heads < len(starts)]] = False
        unit = after_number & ~number & np.isin(self.plain, _UNIT_HASHES)
        self.template = np.where(number, _NUM, np.where(unit, _UNIT, np.where(upper, _NAME, self.plain)))
        self.slot = number | unit | upper

    def windows(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For templates (1) and plain words (0): kind, hashes, first words and whether the window counts."""
        for kind, words in ((1, self.template), (0, self.plain)):
            hashes, bounds = self.block.windows(words, size)
            per = np.diff(bounds)
            first = np.arange(len(hashes)) + np.repeat(self.block.word_bounds[:-1] - bounds[:-1], per)
            if kind:
                slots = np.concatenate(([0], np.cumsum(self.slot)))
                usable = size - (slots[first + size] - slots[first]) >= 2
            else:
                usable = np.ones(len(hashes), bool)
            yield kind, hashes ^ U64(kind), first, usable


def _sequence_hashes(block: Block, words: np.ndarray) -> np.ndarray:
    """A hash of each document's whole sequence of ``words``."""
    n = block.n_words()
    place = np.arange(len(words)) - np.repeat(block.word_bounds[:-1], n)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(words + mix64(place.astype(U64))))))
    return mix64(total[block.word_bounds[1:]] - total[block.word_bounds[:-1]] + n.astype(U64))


def _slot_numbers(text: Canonical) -> np.ndarray:
    """For each word 0, or the number of its slot's value, counted from 1 by first appearance in the document."""
    out = np.zeros(len(text.plain), U64)
    for a, b in zip(text.block.word_bounds[:-1], text.block.word_bounds[1:]):
        at = a + np.flatnonzero(text.slot[a:b])
        _, first, which = np.unique(text.plain[at], return_index=True, return_inverse=True)
        out[at] = np.argsort(np.argsort(first))[which] + 1
    return out


_UNIT_HASHES = np.array([b.hash_spans(np.array([0]), np.array([len(b.data)]), fold=True)[0] for b in (next(blocks(pa.array([u]))) for u in UNITS)])


def _item_rows(items: DataFrame, size: int, item_col: str, text_col: str, short: bool) -> DataFrame:
    id_type = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield _window_batch(block, batch.column(0).slice(block.first, block.n_docs), "item_id", size, None, short)

    return items.select(F.col(item_col), F.col(text_col)).mapInArrow(run, f"kind int, hash bigint, item_id {id_type}, slots array<bigint>, place int, words int, class bigint")


def item_windows(items: DataFrame, size: int = 5, item_col: str = "item_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """Distinct windows of the benchmark's classes: kind, hash, class, its smallest ``item_id`` and ``n_items``, ``places`` (words before it in the item), ``item_slots``, ``words`` that the item's windows cover and number of its ``windows``.

    ``item_slots`` has, for each place of a template window, the numbers of its words' values, 0 where it has a plain one.
    """
    rows, keys = _item_rows(items, size, item_col, text_col, short), ["kind", "hash", "class"]
    # all items of a class have all of its windows, so each window knows the class's items
    own = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("place", "slots"))).alias("at"), F.max("words").alias("words"), F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items")
    )
    item = Window.partitionBy("class", "kind")
    slots = F.when(F.col("kind") == 1, F.flatten("at.slots")).otherwise(F.array().cast("array<bigint>"))
    return own.select(*keys, "item_id", "n_items", F.col("at.place").alias("places"), slots.alias("item_slots"), F.max("words").over(item).alias("words"), F.count("*").over(item).alias("windows"))


def item_members(items: DataFrame, size: int = 5, item_col: str = "item_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(kind, item id, ``member``): the items of each class, which ``contaminated`` names by its smallest item id; items without windows are in none."""
    rows = _item_rows(items, size, item_col, text_col, short).select("kind", "class", F.col("item_id").alias("member")).distinct()
    names = rows.groupBy("kind", "class").agg(F.min("member").alias("item_id"))
    return rows.join(names, ["kind", "class"]).select("kind", "item_id", "member").distinct()


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _window_batch(block: Block, ids: pa.Array, name: str, size: int, known: np.ndarray | None, short: bool, keys: pa.Array | None = None) -> pa.RecordBatch:
    """Windows of a block's documents; ``known``: only those of these (sorted) hashes.  With what tells where they are.

    With ``short`` a text of fewer than ``size`` words is a window of kind 2 by itself.
    """
    text = Canonical(block)
    kinds, hashes, firsts = [], [], []
    for kind, h, first, usable in text.windows(size):
        if known is not None:
            usable &= _member(h, known)
        at = np.flatnonzero(usable)
        kinds.append(np.full(len(at), kind, np.int32))
        hashes.append(h[at])
        firsts.append(first[at])
    n_words = block.n_words()
    if short:
        whole = np.flatnonzero((n_words > 0) & (n_words < size))
        h = _sequence_hashes(block, text.plain)[whole] ^ U64(2)
        if known is not None:
            whole, h = whole[_member(h, known)], h[_member(h, known)]
        kinds.append(np.full(len(whole), 2, np.int32))
        hashes.append(h)
        firsts.append(block.word_bounds[whole])
    kind, h, first = np.concatenate(kinds), np.concatenate(hashes), np.concatenate(firsts)
    doc = np.searchsorted(block.word_bounds, first, side="right") - 1
    grid = np.minimum(first[:, None] + np.arange(size), max(len(text.plain) - 1, 0))  # only windows of kind 2 can end before
    values = _slot_numbers(text) if name == "item_id" else text.plain
    slots = np.where(text.slot[grid] & (kind == 1)[:, None], values[grid], U64(0)) if len(first) else np.zeros((0, size), U64)
    columns = [pa.array(kind), pa.array(h.view(np.int64)), ids.take(pa.array(doc)), pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int32()), pa.array(slots.reshape(-1).view(np.int64)))]
    names = ["kind", "hash", name, "slots"]
    columns.append(pa.array((first - block.word_bounds[doc]).astype(np.int32)))
    names.append("place")
    if name == "item_id":
        covered = np.zeros((2, len(text.plain) + 1), np.int64)
        long = kind < 2
        covered[np.repeat(kind[long], size), grid[long].reshape(-1)] = 1
        total = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(covered, axis=1)), axis=1)
        which = np.minimum(kind, 1)
        words = np.where(long, total[which, block.word_bounds[doc + 1]] - total[which, block.word_bounds[doc]], n_words[doc])
        same = np.stack((_sequence_hashes(block, text.plain), _sequence_hashes(block, mix64(text.template) + values)))
        columns += [pa.array(words.astype(np.int32)), pa.array(same[kind % 2, doc].view(np.int64))]
        names += ["words", "class"]
    else:
        # spans in code points of the text
        points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
        base = points[block.bounds[doc]]
        last = np.where(kind == 2, block.word_bounds[doc + 1], first + size) - 1
        columns += [keys.take(pa.array(doc)), pa.array(points[block.starts[first]] - base) if len(first) else pa.array([], pa.int64()), pa.array(points[block.ends[last]] - base) if len(first) else pa.array([], pa.int64())]
        names += ["text_key", "start", "end"]
    return pa.RecordBatch.from_arrays(columns, names)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array: a bit table first, then a search for the few that pass."""
    if not len(known):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 20, bool)
    table[(known >> U64(44)).astype(np.int64)] = True
    out = table[(values >> U64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    where = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
    out[at] = known[where] == values[at]
    return out


def document_windows(docs: DataFrame, size: int, known: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """Windows of all documents; ``known``: only those of these hashes.  ``text_key`` is a hash of the whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield _window_batch(block, batch.column(0).slice(block.first, block.n_docs), "doc", size, None if shared is None else shared.value, short, batch.column(2).slice(block.first, block.n_docs))

    return docs.select(F.col(id_col), F.col(text_col), _text_key(text_col)).mapInArrow(run, f"kind int, hash bigint, doc {id_type}, slots array<bigint>, place int, text_key bigint, start bigint, end bigint")


def _occurrences(matches: list[tuple], size: int) -> list[list[tuple]]:
    """Groups of (match, place in the item), by the nearest continuation; ``matches`` are of one kind, by place in the document."""
    words = matches[0][6]
    gap, slack = max(4 * size, words // 2), max(2 * size, words // 4)
    done, open_ = [], []
    for m in matches:
        at, places = m[0], m[4]
        done += [o for o in open_ if at - o[-1][0][0] > gap]
        open_ = [o for o in open_ if at - o[-1][0][0] <= gap]
        best = None
        for o in open_:
            last, before = o[-1][0][0], o[-1][1]
            aim = before + at - last
            k = bisect_left(places, aim)
            for q in places[max(k - 1, 0) : k + 1]:
                if before < q <= before + gap and abs(q - aim) <= slack and (best is None or abs(q - aim) <= best[0]):
                    best = abs(q - aim), o, q
        if best:
            best[1].append((m, best[2]))
        else:
            open_.append([(m, places[0])])
    return done + open_


def _agreement(pairs: list[tuple[int, int]]) -> float:
    """How often a value of the item meets its most frequent answer."""
    answers: dict[int, Counter] = defaultdict(Counter)
    for value, answer in pairs:
        answers[value][answer] += 1
    return sum(max(c.values()) for c in answers.values()) / len(pairs) if pairs else 1.0


def _judge(kind: int, matches: list[tuple], size: int, percent: int, run: int) -> list[tuple]:
    """Copies among the matches (place, start, end, slots, places, item_slots, words, windows, n_items) of one kind: (part, kind, matched, windows, consistency, start, end, n_items)."""
    words, windows = matches[0][6:8]
    found = []

    def add(members: list[tuple], consistency: float) -> None:
        matched = len({tuple(m[4]) for m in members})
        found.append((matched / windows, kind, matched, windows, consistency, min(m[1] for m in members), max(m[2] for m in members), matches[0][8]))

    for group in _occurrences(matches, size):
        covered = longest = length = before = shift = 0
        pairs = []
        for k, (m, q) in enumerate(group):
            fresh = min(size, q - before) if k else size
            together = k and q - m[0] == shift and q - before <= size
            length = length + fresh if together else size
            covered, longest, before, shift = covered + fresh, max(longest, length), q, q - m[0]
            if kind == 1:
                own = m[5][m[4].index(q) * size :][:size]
                pairs += [(v, a) for v, a in zip(own[-fresh:], m[3][-fresh:]) if v]
        if 100 * covered >= percent * words or longest >= run:
            consistency = _agreement(pairs)
            if 100 * consistency >= percent:
                add([m for m, _ in group], consistency)
    if not found and 100 * len({tuple(m[4]) for m in matches}) >= percent * windows:
        own = [(min(m[5][k : k + size] for k in range(0, len(m[5]), size)), m[3]) for m in matches] if kind == 1 else []
        consistency = _agreement([(v, a) for item, doc in own for v, a in zip(item, doc) if v])
        if 100 * consistency >= percent:
            add(matches, consistency)
    return found


def contaminated(
    docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, run: int = RUN, template_run: int = TEMPLATE_RUN, short: bool = False
) -> DataFrame:
    """One row per document and class of items it holds: id, ``item_id``, ``text_key``, and of the fullest copy ``matched`` and ``windows``, ``kind``, ``consistency``, the span (``start``, ``end``) of its windows in code points and ``n_items``."""
    spark = docs.sparkSession
    windows = Scratch(spark).write(item_windows(items, size, item_col, item_text, short), "items")
    n = windows.count()
    known = None
    if n <= broadcast_windows:
        known = np.unique(np.array([r["hash"] for r in windows.select("hash").distinct().toLocalIterator()], np.int64).view(np.uint64))
    found = document_windows(docs, size, known, id_col, text_col, short)
    key, rest = ["doc", "text_key", "item_id"], ["kind", "class", "place", "start", "end", "slots", "places", "item_slots", "words", "windows", "n_items"]
    met = found.join(windows, ["kind", "hash"]).select(*key, *rest).repartition(*key).sortWithinPartitions(*key, "kind", "class", "place")
    types = {f.name: f.dataType.simpleString() for f in met.schema}
    names = [*key, "kind", "matched", "windows", "consistency", "start", "end", "n_items"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, ids = None, {}, None
        out: list[tuple] = []

        def close() -> None:
            best = [x for (kind, _), matches in kinds.items() for x in _judge(kind, matches, size, percent, template_run if kind == 1 else run)]
            if best:
                out.append((*now, *max(best)[1:]))

        for batch in batches:
            ids = [f.type for f in batch.schema][:3]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if now is not None:
                        close()
                    now, kinds = row[:3], {}
                matches = kinds.setdefault(row[3:5], [])
                if not matches or matches[-1][0] != row[5]:  # else a repeated row of the document
                    matches.append(row[5:])
            if out:
                yield _found_batch(out, ids, names)
                out = []
        if now is not None:
            close()
        if out:
            yield _found_batch(out, ids, names)

    done = met.mapInArrow(judge, f"doc {types['doc']}, text_key bigint, item_id {types['item_id']}, kind int, matched bigint, windows bigint, consistency double, start bigint, end bigint, n_items bigint")
    return done.select(F.col("doc").alias(id_col), "item_id", "text_key", "kind", "matched", "windows", "consistency", "start", "end", "n_items")


def _found_batch(rows: list[tuple], ids: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    types = [*ids, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names)


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item.  A row is judged by its own text: others of its id, or without an id, stay."""
    scratch = Scratch(docs.sparkSession)
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
    return scratch.semi_join(docs, scratch.write(bad, "bad"), F.col(id_col).eqNullSafe(F.col("_bad")) & (_text_key(text_col) == F.col("_bad_key")), "left_anti")
