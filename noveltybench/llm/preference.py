"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns is rendered once as prompt; what is left of
either conversation becomes a completion with the spans to learn from (the
assistant's words and their end mark; all else is masked).

Spans count characters of the completion strings.

Defined cases: a null role or text counts as empty; equal conversations have
empty completions; a missing side (null array) is an empty conversation; turns
with equal numbers stand in the order of role and text; rows without a key belong
to no conversation and are left out; columns that aren't results pass through
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.storage import unused

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _words(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _words(t))), "")


def learned_spans(turns: Column) -> Column:
    """[start, end) characters of the rendered turns that are the assistant's, as "start-end,start-end"."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(_header(t))
        last = first + F.length(_words(t))
        span = F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
        return F.struct(last.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a["role"], F.lit("")).eqNullSafe(F.coalesce(b["role"], F.lit(""))) & F.coalesce(a["text"], F.lit("")).eqNullSafe(F.coalesce(b["text"], F.lit(""))) & a.isNotNull() & b.isNotNull())
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` (turn arrays of struct<role, text>) with n_prompt_turns, prompt, both completions and their learned spans.

    The two array columns are replaced by the completion strings; other columns with a result's name are replaced too.
    """
    added = ["n_prompt_turns", "prompt", "chosen_spans", "rejected_spans"]
    kept = pairs.drop(*added)
    empty = F.array().cast(kept.schema[chosen].dataType)
    c, r, prompt = (unused(name, kept.columns) for name in ("c", "r", "prompt"))
    turns = kept.withColumn(c, F.coalesce(chosen, empty)).withColumn(r, F.coalesce(rejected, empty)).withColumn("n_prompt_turns", common_turns(F.col(c), F.col(r)))

    def after(name: str) -> Column:
        return F.slice(F.col(name), F.col("n_prompt_turns") + 1, F.size(name))

    rest = turns.withColumn(prompt, F.slice(c, F.lit(1), F.col("n_prompt_turns"))).withColumn(c, after(c)).withColumn(r, after(r))
    others = [name for name in kept.columns if name not in (chosen, rejected)]
    return rest.select(
        *others,
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        render(F.col(prompt)).alias("prompt"),
        render(F.col(c)).alias(chosen),
        render(F.col(r)).alias(rejected),
        learned_spans(F.col(c)).alias("chosen_spans"),
        learned_spans(F.col(r)).alias("rejected_spans"),
    )


def partner_pairs(rows: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: each conversation, against the same with its partner's last reply in place of its own.

    Partners are conv_id 2k and 2k + 1, so both are gathered at once.  All turns are kept, those after the last reply
    on both sides.  Without a partner that has a reply the rejected side lacks the reply; without a reply of its own a
    conversation stands on both sides.
    """
    turn = F.struct("conv_id", "turn", "role", "text")
    both = rows.where(F.col("conv_id").isNotNull()).groupBy(F.shiftright("conv_id", 1).alias("pair")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def of(bit: int) -> Column:
        return F.filter("turns", lambda t: t["conv_id"].bitwiseAND(1) == bit)

    sides = F.array(*[F.struct(F.lit(bit).cast("long").alias("bit"), of(bit).alias("own"), of(1 - bit).alias("other")) for bit in (0, 1)])
    each = both.select("pair", F.explode(sides).alias("side")).where(F.size("side.own") > 0)

    def last_reply(turns: Column) -> Column:
        return F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i).otherwise(-1)))

    placed = each.select(
        (F.shiftleft("pair", 1).bitwiseOR(F.col("side.bit"))).alias("conv_id"),
        F.transform("side.own", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"),
        last_reply(F.col("side.own")).alias("at"),
        F.get("side.other", F.coalesce(F.nullif(last_reply(F.col("side.other")), F.lit(-1)), F.size("side.other"))).alias("reply"),
    )
    answer = F.struct(F.lit("assistant").alias("role"), F.col("reply.text").alias("text"))
    swapped = F.transform("chosen", lambda t, i: F.when(i == F.col("at"), answer).otherwise(t))
    without = F.filter("chosen", lambda t, i: i != F.col("at"))
    return placed.select("conv_id", "chosen", F.when(F.col("reply").isNotNull(), swapped).otherwise(without).alias("rejected"))


def digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    return format_pairs(partner_pairs(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))))
