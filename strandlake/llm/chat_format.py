"""Preference formatting of chosen and rejected conversations. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations_as_arrays(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``_conv, _turns``: a conversation's turns as array<struct<role, text>>.

    Ordered by turn number, nulls first, ties by role then text, so the order
    never depends on how rows arrive. Null role reads ``user``, null text ''.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return turns.groupBy(F.col(conv_col).alias("_conv")).agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda t: F.struct(t["role"], t["text"])).alias("_turns")
    )


def _render(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(CLOSE))), ""
    )


def _mask(turns: Column) -> Column:
    """Character spans ``start:end`` (end exclusive) of assistant text and its end mark in the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.lit(len(OPEN) + len(MID)) + F.char_length(t["role"])
        end = begin + F.char_length(t["text"]) + F.lit(len(CLOSE))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        joined = F.when(acc["spans"] == "", span).otherwise(F.concat(acc["spans"], F.lit(","), span))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", joined).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds prompt, completions and loss masks to rows holding two turn arrays.

    The longest common prefix of equal (role, text) turns is rendered once as
    ``prompt``; what follows in either is ``chosen_completion`` and
    ``rejected_completion``; ``*_mask`` lists the spans of each completion
    that count for the loss (assistant turns), every other character is masked.
    A missing side (null) leaves its completion and mask null and the common
    prefix is empty; identical conversations give two empty completions.
    Name clashes: the added columns replace columns of the same name.
    """
    a, b = F.col(chosen), F.col(rejected)
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    shorter = F.least(F.size(a), F.size(b))
    n = F.when(a.isNull() | b.isNull(), 0).when(first_other == 0, shorter).otherwise(first_other - 1)
    out = pairs.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(F.col(c)), F.lit(1)))
    return out.withColumns(
        {
            "prompt": F.when(F.col("n_prompt_turns") == 0, "").otherwise(_render(F.slice(a, 1, F.greatest("n_prompt_turns", F.lit(1))))),
            "chosen_completion": _render(rest(chosen)),
            "rejected_completion": _render(rest(rejected)),
            "chosen_mask": _mask(rest(chosen)),
            "rejected_mask": _mask(rest(rejected)),
        }
    )


def preference_pairs(turns: DataFrame, conv_col: str = "conv_id", **cols: str) -> DataFrame:
    """Formatted pairs from a table of turns: conversation 2k is chosen, 2k+1 rejected.

    One row per pair of ids of which at least one occurs: ``pair_id,
    chosen_id, rejected_id, n_prompt_turns, prompt, chosen_completion,
    rejected_completion, chosen_mask, rejected_mask``. A conversation without
    its partner is returned with the other side null. Rows with a null
    conversation id belong to no pair and form one row with pair_id null, as
    chosen side. Turns are grouped by pair and side only, so the largest group
    is one conversation whatever texts repeat.
    """
    conv = conversations_as_arrays(turns, conv_col, **cols)
    side = F.coalesce(F.pmod("_conv", F.lit(2)), F.lit(0))
    pair = conv.groupBy(F.floor(F.col("_conv") / 2).cast("long").alias("pair_id")).agg(
        F.max(F.when(side == 0, F.col("_conv"))).alias("chosen_id"),
        F.max(F.when(side == 1, F.col("_conv"))).alias("rejected_id"),
        F.first(F.when(side == 0, F.col("_turns")), ignorenulls=True).alias("chosen"),
        F.first(F.when(side == 1, F.col("_turns")), ignorenulls=True).alias("rejected"),
    )
    return preference_format(pair).drop("chosen", "rejected")
