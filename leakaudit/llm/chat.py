"""Preference formatting of chosen and rejected conversations, DataFrame operations only.

A pair's longest common prefix of turns is rendered once as the prompt. What follows in either
conversation is its completion, together with the character spans of it that are to be
learned: the texts and ends of assistant turns.

Turns are gathered per conversation, which is one output row anyway; nothing else is grouped.

Defined results: turns of one number are ordered by role and text, rows equal in all are
kept; null roles and texts are rendered empty and equal each other; a pair without a
learnable span on both sides, or with equal completions, has ``usable`` = false; a null conversation id is one conversation;
an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEARNED = "assistant"
BLOCK = 64

# The markers around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    found = turns.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return found.withColumn("turns", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))))


def answered_by_others(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, donor, chosen, rejected): each conversation up to its last assistant turn, and the same with
    the last assistant turn of the next conversation in its block of ids instead."""
    replies = F.filter("turns", lambda t: t["role"] == LEARNED)
    last = F.aggregate(F.sequence(F.lit(1), F.size("turns")), F.lit(0), lambda a, i: F.when(F.element_at("turns", i)["role"] == LEARNED, i).otherwise(a))
    rows = convs.withColumn("reply", F.try_element_at(replies, F.lit(-1))).withColumn("last", last).withColumn("block", F.floor(F.col("id") / block))
    w = Window.partitionBy("block").orderBy("id")
    donor = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    rows = rows.withColumn("given", donor(F.struct("id", "reply")))
    before = F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    other = F.when(F.col("given.reply").isNull(), before).otherwise(F.concat(before, F.array("given.reply")))
    return rows.where("last > 0").select("id", F.col("given.id").alias("donor"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), other.alias("rejected")).unionByName(
        rows.where("last = 0").select("id", F.col("given.id").alias("donor"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    )


def _render(turns) -> F.Column:
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def _spans(turns) -> F.Column:
    """[begin, end) of what is learned, in characters of the rendered turns."""
    head = lambda t: F.length(F.lit(OPEN)) + F.length(t["role"]) + 1
    size = lambda t: head(t) + F.length(t["text"]) + len(CLOSE)
    kind = "struct<at:int,spans:array<struct<begin:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")).cast(kind)

    def step(a, t):
        own = F.array(F.struct((a["at"] + head(t)).alias("begin"), (a["at"] + size(t)).alias("end")))
        return F.struct((a["at"] + size(t)).alias("at"), F.when(t["role"] == LEARNED, F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans")).cast(kind)

    return F.aggregate(turns, start, step)["spans"]


def preference(pairs: DataFrame) -> DataFrame:
    """Pairs (chosen, rejected: arrays of (role, text), other columns kept) with prompt_turns, prompt, chosen_text,
    rejected_text, chosen_spans, rejected_spans and usable."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at("chosen", i) != F.element_at("rejected", i))
    first = F.when(shorter == 0, F.lit(0)).otherwise(F.array_position(differ, True).cast("int"))
    common = F.when(first > 0, first - 1).otherwise(shorter)
    cut = pairs.withColumn("prompt_turns", common)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    parts = cut.withColumns({"head": F.slice("chosen", F.lit(1), F.col("prompt_turns")), "own": rest("chosen"), "other": rest("rejected")})
    made = parts.withColumns(
        {"prompt": _render(F.col("head")), "chosen_text": _render(F.col("own")), "rejected_text": _render(F.col("other")), "chosen_spans": _spans(F.col("own")), "rejected_spans": _spans(F.col("other"))}
    )
    usable = (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0) & (F.col("chosen_text") != F.col("rejected_text"))
    return made.withColumn("usable", usable).drop("head", "own", "other", "chosen", "rejected")
