"""Preference formatting of chat pairs.

A pair is a chosen and a rejected conversation. Their longest common beginning of
turns is rendered once as the prompt; what follows on either side is a completion, of
which only what the assistant says is trained on.

The result has a row per rendered turn, in order, not a row per conversation: a pair
may have any number of turns without meeting in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import kept


@dataclass(frozen=True)
class Template:
    """A turn is head, role, after_role, text, tail."""

    head: str = "<|im_start|>"
    after_role: str = "\n"
    tail: str = "<|im_end|>\n"
    trained_role: str = "assistant"


def turns(conversations: DataFrame, pair: Column) -> DataFrame:
    """pair_id, turn, role, text without nulls: no role is `user`, no text is empty, no turn comes before all others."""
    return conversations.select(
        pair.cast("long").alias("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per rendered turn: pair_id, part, turn, role, rendered, masked_chars, trained_chars.

    Both sides have pair_id, turn, role, text (see `turns`). Repeated rows count
    once; several texts in one turn follow each other by role and text and are equal
    only as a whole. `part` is prompt, chosen or rejected; sorted by part, turn, role
    and text, `rendered` gives the three strings. The first `masked_chars` of a row
    take no part in the loss, the other `trained_chars` do: the text and end of the
    assistant's turns in completions. Equal sides are all prompt; a side that is the
    beginning of the other has no completion. A null pair_id is a pair of its own.
    """
    sides = chosen.select("pair_id", "turn", "role", "text", F.lit(True).alias("c"), F.lit(False).alias("r")).unionByName(
        rejected.select("pair_id", "turn", "role", "text", F.lit(False).alias("c"), F.lit(True).alias("r"))
    )
    rows = kept(
        sides.groupBy("pair_id", "turn", "role", "text").agg(F.max("c").alias("c"), F.max("r").alias("r")), "chat-turns"
    )
    parting = kept(rows.filter("c <> r").groupBy(F.col("pair_id").alias("pair")).agg(F.min("turn").alias("parts_at")), "chat-parting")
    placed = rows.join(parting, F.col("pair_id").eqNullSafe(F.col("pair")), "left")
    shared = F.col("parts_at").isNull() | (F.col("turn") < F.col("parts_at"))
    parts = F.when(shared, F.array(F.lit("prompt"))).otherwise(
        F.array_compact(F.array(F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected"))))
    )
    opening = F.concat(F.lit(template.head), F.col("role"), F.lit(template.after_role))
    trained = (F.col("part") != "prompt") & (F.col("role") == template.trained_role)
    return (
        placed.withColumn("part", F.explode(parts))
        .withColumn("rendered", F.concat(opening, F.col("text"), F.lit(template.tail)))
        .withColumn("masked_chars", F.when(trained, F.length(opening)).otherwise(F.length("rendered")).cast("long"))
        .withColumn("trained_chars", F.length("rendered") - F.col("masked_chars"))
        .select("pair_id", "part", "turn", "role", "rendered", "masked_chars", "trained_chars")
    )


def against_other_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text).

    The chosen side is a conversation up to its last assistant turn; the rejected one
    is the same with that turn answered by the last reply of the conversation whose id
    differs in the lowest bit (of several texts the smallest). Without such a reply the
    rejected side ends before the turn. Conversations without an assistant turn and a
    null conv_id give no pair. The chosen side keeps whatever else stands in that turn.
    """
    rows = turns(conversations.filter("conv_id IS NOT NULL"), F.col("conv_id"))
    last = rows.filter("role = 'assistant'").groupBy(F.col("pair_id").alias("conv")).agg(
        F.max("turn").alias("at"),
        # The complement turns the order of the turns round and cannot overflow.
        F.min(F.struct(F.bitwise_not(F.col("turn")).alias("back"), "text"))["text"].alias("reply"),
    )
    last = kept(last, "chat-last")
    cut = rows.join(last.select("conv", "at"), rows["pair_id"] == F.col("conv")).drop("conv")
    chosen = cut.filter("turn <= at").drop("at")
    own, other = last.select("conv", "at"), last.select((F.col("conv").bitwiseXOR(F.lit(1))).alias("conv"), "reply")
    answers = own.join(other, "conv").select(
        F.col("conv").alias("pair_id"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")
    )
    return chosen, cut.filter("turn < at").drop("at").unionByName(answers)
