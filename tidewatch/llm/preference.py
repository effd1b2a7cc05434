"""Preference formatting: chosen and rejected conversations share a prompt and get a completion each.

Everything is joined and aggregated by (pair, turn), so no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _turns(df: DataFrame) -> DataFrame:
    """One row per (pair_id, turn): of several, that with the smallest role and text."""
    said = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return (
        df.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("pair_id", "turn").agg(said.alias("said"))
    )


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def preference_rows(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``pair_id, part, turn, role, segment, loss_from, loss_to``: one row per rendered turn.

    Both inputs have ``pair_id, turn, role, text``.  The turns in front of the first turn that
    differs in role or text (or that only one side has) are the prompt, rendered once with part
    ``prompt``; the rest is rendered as ``chosen`` and ``rejected``.  The loss covers characters
    ``loss_from`` (0-based) to ``loss_to`` (exclusive) of a segment: the text and its final line
    break where ``trained_role`` speaks in a completion, nothing elsewhere (equal ends).

    Null roles and texts are empty.  Rows without pair_id or turn belong to no conversation and
    are left out.  Repeated turns count once.  A pair with one side only, or with equal sides,
    has no prompt or nothing but a prompt.  Other columns are ignored.
    """
    left = _turns(chosen).withColumnRenamed("said", "chosen")
    right = _turns(rejected).withColumnRenamed("said", "rejected")
    both = left.join(right, ["pair_id", "turn"], "full_outer")
    apart = both.filter(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("cut"))
    rows = both.join(apart, "pair_id", "left")
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said")),
        )
    )
    rows = rows.select("pair_id", "turn", F.explode(parts).alias("p")).filter(F.col("p.said").isNotNull())
    rows = rows.select("pair_id", "p.part", "turn", "p.said.role", render(F.col("p.said.role"), F.col("p.said.text")).alias("segment"))
    head = F.length("role") + F.lit(len("<||>\n"))
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    return rows.select(
        "pair_id", "part", "turn", "role", "segment",
        F.when(trained, head).otherwise(F.length("segment")).cast("long").alias("loss_from"),
        F.length("segment").cast("long").alias("loss_to"),
    )


def branched_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns out of plain conversations, as a ranking set with random negatives.

    The chosen side is the whole conversation.  The rejected side has, in place of one answer, the
    last answer of the conversation whose number follows (in blocks of two: 2k and 2k+1 swap), or an
    empty text where that one has no answer; all turns around it are the same.  The answer is picked by
    the remainder of numbers, of equal ones the first, so both sides part after prefixes of any length.
    A conversation without an answer, or whose replacement says the same, has equal sides.  Rows without conv_id or turn belong to no conversation
    and are left out; of repeated turns the one with the smallest role and text counts.
    """
    turns = _turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))
    answers = turns.filter(F.col("said.role") == "assistant")
    mixed = (F.col("pair_id") % 1009 * 31 + F.col("turn") % 1009 * 17) % 101
    picked = answers.groupBy("pair_id").agg(
        F.min(F.struct(mixed.alias("mixed"), "turn")).alias("at"), F.max_by("said.text", "turn").alias("last")
    )
    other = picked.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last").alias("wrong"))
    wrong = picked.join(other, "pair_id", "left").select("pair_id", F.col("at.turn").alias("turn"), F.coalesce("wrong", F.lit("")).alias("wrong"))
    rejected = turns.join(wrong, ["pair_id", "turn"], "left")
    return turns.select("pair_id", "turn", "said.role", "said.text"), rejected.select(
        "pair_id", "turn", "said.role", F.coalesce("wrong", "said.text").alias("text")
    )
