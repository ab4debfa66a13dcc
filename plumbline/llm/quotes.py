"""Quotation linking: conversations in reply order, with quotes taken out and linked.

A message's lines begin with any number of ``>``, its quote level. Neighbouring lines of one
level are a passage. A quoted passage and each of its lines are normalised and hashed, and so
are the own passages and lines of all messages, of any length; equal hashes link. Only lines of
under ``LEAST`` characters in a quote of several lines don't: they are the quote's ``}`` or ``ok``. The original is the first
message that holds the passage: in the same conversation, before the quoting message, or else
the first of all conversations. A message's parent is the original, in its own conversation,
of its shallowest quote that has one. Messages linked by parents are a thread; threads come in
the order of their first messages, and each message after the one that it answers.

Hot keys: only the first holder of a hash is joined, found with pre-aggregation, so a line that
a third of all messages hold links no more than any other. Positions come from ranges of the
order and their counts, so a conversation with most of the messages isn't one task's.

Cases: a null text is an empty text without passages; a null conv_id is a conversation like any
other; null turns come first, and what quotes or is quoted there links with nothing of its own
conversation, as nothing is before it; messages of equal (conv_id, turn) have links of their own, and
as a parent names a turn they stand in one thread, by role and text; repeated rows are messages of
their own with equal links; texts of any length are taken whole; an empty table gives an empty table;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, stored
from plumbline.llm.graph import components

_LEVEL = re.compile(r"(?:[ \t]*>)*")
#: Shorter lines of a quote of several lines are too common to tell a message by, and shorter
#: passages count after longer ones of their level.
LEAST = 12


def normalised(text: str) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return " ".join(text.lower().split())


def key_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(normalised(text).encode()) - (1 << 63)


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(the text without quotes, its passages as (level, text)); blank lines part passages of a level."""
    passages, own = [], []
    last = None
    for line in text.split("\n"):
        mark = _LEVEL.match(line)[0]
        level, body = mark.count(">"), line[len(mark) :] if ">" in mark else line
        if level == 0:
            own.append(line)
        if not body.strip():
            last = None
        elif last == level:
            passages[-1][1].append(body.strip())
        else:
            passages.append((level, [body.strip()]))
            last = level
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if any(level for level, _ in passages) else text
    return clean, [(level, "\n".join(lines)) for level, lines in passages]


def keys_of(passage: str, quoted: bool) -> list[tuple[int, bool]]:
    """(hash, whether it is short) of a passage and of its lines; short lines of a longer quote are left out."""
    texts = list(dict.fromkeys(map(normalised, [passage, *passage.split("\n")])))
    return [(key_of(t), len(t) < LEAST) for i, t in enumerate(texts) if i == 0 or not quoted or len(t) >= LEAST]


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, levels and keys (level, key, short) of each message."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        out = {"own_text": [], "n_quotes": [], "levels": [], "keys": []}
        for text in batch["text"].to_pylist():
            own, found = parsed(text)
            out["own_text"].append(own)
            out["n_quotes"].append(sum(level > 0 for level, _ in found))
            out["levels"].append(max([level for level, _ in found], default=0))
            out["keys"].append([{"level": level, "key": k, "short": short} for level, passage in found for k, short in keys_of(passage, level > 0)])
        return {c: batch[c] for c in ("conv_id", "turn", "role")} | out

    return arrow_map(rows, run, "conv_id long, turn long, role string, own_text string, n_quotes int, levels int, keys array<struct<level:int,key:long,short:boolean>>")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order``: by ranges of all rows, then counts of the ranges."""
    ranged = stored(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_{g}") for g in group), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range", *group).orderBy(*order)
    rows = ranged.withColumn("_row", F.row_number().over(within) - 1)
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return rows.join(base, same).withColumn(name, (F.col("_row") + F.col("_base")).cast("long")).select(*df.columns, name)


def linked(messages: DataFrame) -> DataFrame:
    """One row per message with own_text, its original and parent, thread and position.

    original_conv and original_turn: of the shallowest quoted passage that is found anywhere;
    parent_turn: of the shallowest one found in the same conversation; thread_turn: the thread's
    first message; position: from 0 in the conversation's reply order.
    """
    rows = stored(passages(messages).withColumn("_row", F.monotonically_increasing_id()), "passages")
    keys = rows.select("_row", "conv_id", "turn", F.explode("keys").alias("k")).select("_row", "conv_id", "turn", "k.level", "k.key", "k.short")
    own = keys.where("level = 0")
    first = own.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("any"))
    first_here = own.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min("turn").alias("here"))
    quoted = keys.where("level > 0").distinct()
    here = quoted.join(first_here, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left").withColumn("here", F.when(F.col("here") < F.col("turn"), F.col("here")))
    found = here.join(first, "key", "left").withColumn("any", F.when(F.col("here").isNotNull(), F.struct("conv_id", F.col("here").alias("turn"))).when(~(F.col("any.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("any.turn") >= F.col("turn"))), F.col("any")))
    links = found.groupBy("_row", "conv_id", "turn").agg(
        F.min(F.when(F.col("here").isNotNull(), F.struct("level", "short", (-F.col("here")).alias("turn")))).alias("parent"),
        F.min(F.when(F.col("any").isNotNull(), F.struct("level", "short", "any"))).alias("original"),
    )
    links = stored(links.select("_row", F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), (-F.col("parent.turn")).alias("parent_turn"), F.col("original.any.conv_id").alias("original_conv"), F.col("original.any.turn").alias("original_turn")), "links")
    edges = links.where("parent_turn is not null").select(F.struct(F.col("_c").alias("conv_id"), F.col("_t").alias("turn")).alias("a"), F.struct(F.col("_c").alias("conv_id"), F.col("parent_turn").alias("turn")).alias("b"))
    threads = components(edges).select(F.col("node.conv_id").alias("_tc"), F.col("node.turn").alias("_tt"), F.col("component.turn").alias("thread_turn"))
    joined = rows.drop("keys").join(links.drop("_c", "_t"), "_row", "left")
    joined = joined.join(threads, F.col("conv_id").eqNullSafe(F.col("_tc")) & (F.col("turn") == F.col("_tt")), "left").withColumn("thread_turn", F.coalesce("thread_turn", "turn"))
    columns = ["conv_id", "turn", "role", "own_text", "n_quotes", "levels", "original_conv", "original_turn", "parent_turn", "thread_turn"]
    return ranked(joined.select(*columns), ["conv_id"], ["thread_turn", "turn", "role", "own_text"], "position")
