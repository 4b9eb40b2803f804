"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role are merged by array aggregation into
messages: the places where the role changes cut the sorted array into slices, so work grows with the number of turns.  A message keeps
its turns apart by a marker, so formatting is reversible.  Layout of one message::

    <|turn|>role\\ntext<|next|>text<|end|>\\n

Control strings inside texts (the markers' opening ``<|`` and the common ``</s>``, ``<s>``, ``[INST]``, ``[/INST]``, ``<SYS>``, ``</SYS>``)
get a backslash after their first character; where backslashes stand there already, one is added, so removing one undoes it.
Roles are URL-encoded, which leaves ordinary names as they are.

Defined results: null role or text counts as empty; turns that tie are ordered by role, then text; repeated rows stay
separate turns; null turns come first; a null conversation id is one conversation; an empty table gives no rows.  Columns
other than the four named are not read.  All rows of one conversation meet in one row, as its output is one string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"
_CONTROL = r"(\||/?s>|/?INST\]|/?SYS>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep inside functions ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(turns: Column) -> Column:
    def cut(all_: Column) -> Column:
        opens = lambda i: (i == 0) | (F.get(all_, i)["role"] != F.get(all_, i - 1)["role"])
        return _let(
            F.filter(F.sequence(F.lit(0), F.size(all_) - 1), opens),
            lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(all_, s)["role"].alias("role"), F.transform(F.slice(all_, s + 1, F.coalesce(F.get(starts, k + 1), F.size(all_)) - s), lambda t: t["text"]).alias("texts"))),
        )

    return _let(turns, cut)


def _offsets(lengths: Column, block: int = 256) -> Column:
    """Sums of what comes before each element: within blocks, then moved on by the sums of the blocks before."""

    def running(xs: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(xs, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), step)

    def joined(done: Column) -> Column:
        return _let(running(F.transform(done, lambda b: b["at"]))["all"], lambda before: F.flatten(F.transform(done, lambda b, k: F.transform(b["all"], lambda x: x + F.get(before, k)))))

    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")), lambda k: running(F.slice(all_, k * block + 1, F.lit(block))))
    return _let(lengths, lambda all_: _let(blocks(all_), joined))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``messages`` (merged, unescaped), ``formatted`` and ``loss_spans``.

    ``loss_spans`` are (start from 0, length) in code points of ``formatted``, one for each text of ``train_role``.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"),
    )
    messages = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_turn")).alias("turns")).select("_conv", _merged(F.col("turns")).alias("messages"))
    encoded = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(OPEN), F.url_encode(m["role"]), F.lit("\n")).alias("head"), F.transform(m["texts"], escape).alias("texts")))
    # the string's parts in order; part of a text of the trained role: on
    parts = F.flatten(
        F.transform(
            encoded,
            lambda m: F.concat(
                F.array(F.struct(m["head"].alias("s"), F.lit(False).alias("on"))),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, k: F.when(k == 0, F.array(F.struct(t.alias("s"), (m["role"] == train_role).alias("on")))).otherwise(
                            F.array(F.struct(F.lit(NEXT).alias("s"), F.lit(False).alias("on")), F.struct(t.alias("s"), (m["role"] == train_role).alias("on")))
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("on"))),
            ),
        )
    )

    def spans(all_: Column) -> Column:
        lengths = F.transform(all_, lambda p: F.char_length(p["s"]).cast("bigint"))
        placed = _let(_offsets(lengths), lambda at: F.transform(all_, lambda p, i: F.struct(p["on"].alias("on"), F.get(at, i).cast("int").alias("start"), F.char_length(p["s"]).alias("length"))))
        return F.transform(F.filter(placed, lambda p: p["on"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))

    return (
        messages.withColumn("_parts", parts)
        .select(
            F.col("_conv").alias(conv),
            "messages",
            F.array_join(F.transform("_parts", lambda p: p["s"]), "").alias("formatted"),
            _let(F.col("_parts"), spans).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda m: m != "")
    return F.flatten(
        F.transform(
            pieces,
            lambda m: F.transform(
                F.split(F.substr(m, F.locate("\n", m) + 1), r"<\|next\|>", -1),
                lambda t: F.struct(F.url_decode(F.substr(m, F.lit(len(OPEN) + 1), F.locate("\n", m) - len(OPEN) - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column, block: int = 1024) -> Column:
    """All text under the loss mask, unescaped, nothing between.  The string is cut to blocks of code points first, as a place in it is found by walking from its start."""

    def part(blocks: Column, s: Column) -> Column:
        start, end = s["start"], s["start"] + s["length"]
        covered = F.sequence(F.floor(start / block).cast("int"), F.floor((end - 1) / block).cast("int"))
        inside = F.transform(covered, lambda k: F.substr(F.get(blocks, k), F.greatest(start - k * block, F.lit(0)) + 1, F.least(end, (k + 1) * block) - F.greatest(start, k * block)))
        return F.when(s["length"] > 0, F.array_join(inside, "")).otherwise("")

    pieces = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % block), F.lit(0))
    return _let(pieces, lambda blocks: F.array_join(F.transform(spans, lambda s: unescape(part(blocks, s))), ""))
