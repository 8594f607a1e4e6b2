"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions.

The longest common prefix of turns (same role and text) is rendered once, as the prompt; what follows is rendered for
either side, with the spans that a loss counts: text and end mark of assistant turns.  The prompt never counts.

Scale: turns meet by pair, in one grouping whose groups are single conversations; everything else happens inside the row.
A first turn or a whole conversation that very many pairs share is no key anywhere.

Defined results: a missing side has no turns; turns are ordered by number, then role and text; a null text is empty and a
null role is the role ``unknown``; a null turn number comes first; a null pair is left out; identical conversations have empty completions; repeated turns count as
often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn, as ``{OPEN}role\n text {CLOSE}``.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    """Turns ``(role, text)`` as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """Code point ranges of the rendered turns that a loss counts; end exclusive."""

    def step(a, t):
        start = a["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == LOSS_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns``: ``pair_id, chosen`` (boolean), ``turn, role, text``.  One row per pair: ``pair_id, n_prompt_turns,
    n_chosen_turns, n_rejected_turns`` (of the completions), ``prompt, chosen, rejected, chosen_loss, rejected_loss``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda yes: F.sort_array(F.collect_list(F.when(F.col("chosen") == yes, turn)))
    pairs = turns.where("pair_id is not null").groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    common = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(
        F.slice("c", F.lit(1), common), F.slice("r", F.lit(1), common), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    )
    first = F.array_position(same, False)
    pairs = pairs.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(common).cast("int"))
    rest = lambda x: F.slice(x, F.col("n_prompt_turns") + 1, F.size(x))
    return pairs.select(
        "pair_id",
        "n_prompt_turns",
        F.size(rest("c")).alias("n_chosen_turns"),
        F.size(rest("r")).alias("n_rejected_turns"),
        render(F.slice("c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        render(rest("c")).alias("chosen"),
        render(rest("r")).alias("rejected"),
        loss_spans(rest("c")).alias("chosen_loss"),
        loss_spans(rest("r")).alias("rejected_loss"),
    )


def spliced_pairs(conversations: DataFrame) -> DataFrame:
    """Preference turns from a table of conversations: each is preferred to itself with its turns from
    ``conv_id mod (turns + 1)`` on exchanged for those of the conversation with the next id (none: left out)."""
    keep = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    sizes = keep.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.pmod("conv_id", F.col("n") + 1).alias("cut"))
    own = keep.join(sizes, "conv_id").where("turn < cut")
    other = keep.withColumn("conv_id", F.col("conv_id") - 1).join(sizes, "conv_id").where("turn >= cut")
    rejected = own.unionByName(other).select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("chosen"), "turn", "role", "text")
    chosen = keep.select(F.col("conv_id").alias("pair_id"), F.lit(True).alias("chosen"), "turn", "role", "text")
    return chosen.unionByName(rejected)
