"""Chat preference formatting: shared turns once as the prompt, then two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: how a turn is written; the body of an assistant turn and its end mark are what is trained on
END = "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: prompt, the two completions, and for each the spans (in characters) to train on.

    ``turns`` holds a row per turn; ``side`` is ``chosen`` or ``rejected``. Turns are taken in the order of
    ``turn`` (ties by role and text). The longest common prefix are the turns in which both sides have
    the same role and text (null equals null); it is found by comparing positions, one aggregate per pair,
    and written once as ``prompt``. What is left of each side is its completion; inside it, the texts
    of assistant turns with their end marks are trained on, all else (heads, other roles) is
    masked. Spans are ``start:end`` of the completion, joined by commas.

    Null roles are written as ``unknown`` and never trained on, null texts as empty. A side without turns,
    or that is wholly shared, has an empty completion. Rows without a pair id, or with another
    side, are left out. Repeated rows are turns of their own. Columns that are not named are ignored.
    """
    rows = turns.select(
        F.col(pair_col).alias("pair_id"), F.col(side_col).alias("side"), F.col(turn_col).alias("_turn"),
        F.col(role_col).alias("_role"), F.col(text_col).alias("_text"),
    ).filter("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')")
    order = Window.partitionBy("pair_id", "side").orderBy("_turn", "_role", "_text")
    placed = rows.withColumn("_at", F.row_number().over(order))
    # a position is shared if both sides have it, with the same content
    content = F.struct(F.col("_role").alias("r"), F.col("_text").alias("t"))
    at = placed.groupBy("pair_id", "_at").agg(
        F.min(content).alias("_lo"), F.max(content).alias("_hi"), F.count(F.lit(1)).alias("_sides"),
    ).withColumn("_same", (F.col("_sides") == 2) & F.col("_lo").eqNullSafe(F.col("_hi")))
    shared = at.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.col("_same"), F.col("_at"))) - 1, F.max("_at")).alias("shared_turns")
    )
    head = _head(F.coalesce("_role", F.lit("unknown")))
    body = F.concat(F.coalesce("_text", F.lit("")), F.lit(END))
    written = placed.join(shared, "pair_id").select(
        "pair_id", "side", "_at", "shared_turns", F.concat(head, body).alias("_written"),
        F.length(head).alias("_head"), F.length(F.concat(head, body)).alias("_length"),
        F.coalesce(F.col("_role") == "assistant", F.lit(False)).alias("_trained"),
        (F.col("_at") <= F.col("shared_turns")).alias("_in_prompt"),
    )
    before = F.sum(F.when(~F.col("_in_prompt"), F.col("_length"))).over(
        Window.partitionBy("pair_id", "side").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    written = written.withColumn("_start", F.coalesce(before, F.lit(0)) + F.col("_head")).withColumn(
        "_span", F.concat_ws(":", F.col("_start"), F.col("_start") + F.col("_length") - F.col("_head"))
    )

    def joined(when: Column, what: str, glue: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(when, F.struct("_at", F.col(what).alias("x")))))
        return F.array_join(F.transform(parts, lambda p: p["x"]), glue)

    out = [joined(F.col("_in_prompt") & (F.col("side") == "chosen"), "_written", "").alias("prompt")]
    for side in ("chosen", "rejected"):
        rest = (F.col("side") == side) & ~F.col("_in_prompt")
        out += [joined(rest, "_written", "").alias(side), joined(rest & F.col("_trained"), "_span", ",").alias(f"{side}_spans")]
    return written.groupBy("pair_id").agg(F.max("shared_turns").cast("long").alias("shared_turns"), *out)


def branched_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of single conversations, as input for ``format_preferences``.

    A conversation is the chosen side. The rejected side has its turns up to a branching point, the
    conversation's id modulo its number of turns, and from there the turns that the next conversation (by id) has at
    these places. The last conversation is not paired. Ids come from a window over a row per
    conversation, in ranges of ids.
    """
    known = conversations.filter("conv_id IS NOT NULL")
    counts = known.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    # the next id: the smallest of the same range of ids, or else the first id of the next range that has one
    ranged = counts.withColumn("_range", F.floor(F.col("conv_id") / 1000).cast("long"))
    inside = ranged.withColumn("_next", F.lead("conv_id").over(Window.partitionBy("_range").orderBy("conv_id")))
    firsts = ranged.groupBy("_range").agg(F.min("conv_id").alias("_first"))
    following = firsts.withColumn("_first", F.lead("_first").over(Window.orderBy("_range")))
    pairs = inside.join(following, "_range").select(
        F.col("conv_id").alias("pair_id"), F.coalesce("_next", "_first").alias("_other"), F.pmod("conv_id", "_n").alias("_branch")
    ).filter("_other IS NOT NULL")
    turns = known.select("conv_id", "turn", "role", "text")
    own = turns.join(pairs, turns["conv_id"] == pairs["pair_id"])
    chosen = own.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    common = own.filter("turn < _branch").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    other = turns.join(pairs, turns["conv_id"] == pairs["_other"]).filter("turn >= _branch").select(
        "pair_id", F.lit("rejected").alias("side"), "turn", "role", "text"
    )
    return chosen.unionByName(common).unionByName(other)
