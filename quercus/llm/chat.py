"""Chat formatting: logged snapshots that a longer conversation begins with are collapsed, the rest rendered.

A log that writes a conversation after every turn holds each of its prefixes as a conversation too. Each
turn gets two 64-bit hashes of its place, role and text; their running exclusive-or is a hash of the
conversation up to that turn. A conversation goes if its whole hash is the hash of a proper prefix of
another one (anti-join), and of equal conversations the one with the least id stays.

A running value over a conversation would bring all its turns into one task. Turns are therefore summed in
slices of SLICE turn numbers, and the slice totals, a few numbers each, are summed over the conversation.
Rendering gives one row per turn; the texts of a conversation in the order of ``position`` are its rendering.

Texts are read twice, once to be hashed and once to be rendered; only hashes are sorted and shuffled for
the prefix test. Rendering gives one row per turn: the segments of a conversation in the order of turn (and,
within equal turns, of ``tie``) are its rendering, so no conversation has to fit into one row or task.

Defined cases: a repeated row is a repeated turn; rows without conv_id are left out; turns are ordered by
turn (null last) and then by a hash of role and text; a null role reads ``unknown`` and a null text is
empty; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.llm.common import settle

SLICE = 512
START, END = "<|im_start|>", "<|im_end|>"
UNKNOWN_ROLE = "unknown"


def _clean(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(UNKNOWN_ROLE)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.filter(F.col("conv_id").isNotNull()).withColumn("tie", F.xxhash64("role", "text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), n_turns, h1, h2: the hash of the conversation up to and with each turn."""
    other = F.xxhash64(F.lit(2), "role", "text").alias("_other")
    in_slice = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(1 << 62)).cast("bigint").alias("_slice")
    rows = turns.select("conv_id", "turn", "tie", other, in_slice)
    inside = Window.partitionBy("conv_id", "_slice").orderBy(F.col("turn").asc_nulls_last(), "tie", "_other")
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("conv_id", "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "conv_id", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("conv_id")).alias("n_turns"),
        )
    )
    position = F.col("_before") + F.row_number().over(inside) - 1
    placed = rows.join(offsets, ["conv_id", "_slice"]).withColumn("position", position)
    marked = settle(
        placed.select(
            "conv_id", "_slice", "position", "n_turns",
            *[F.xxhash64(F.lit(seed), "position", "tie", "_other").alias(f"_m{seed}") for seed in (1, 2)],
        ),
        "turn-hashes",
    )
    earlier = (
        marked.groupBy("conv_id", "_slice")
        .agg(*[F.bit_xor(f"_m{k}").alias(f"_x{k}") for k in (1, 2)])
        .select("conv_id", "_slice", *[F.coalesce(F.bit_xor(f"_x{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in (1, 2)])
    )
    upto = Window.partitionBy("conv_id", "_slice").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.withColumns({f"_r{k}": F.bit_xor(f"_m{k}").over(upto) for k in (1, 2)})
    return running.join(earlier, ["conv_id", "_slice"]).select(
        "conv_id", "position", "n_turns", *[F.col(f"_r{k}").bitwiseXOR(F.col(f"_b{k}")).alias(f"h{k}") for k in (1, 2)]
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no prefix of a longer one; one of equal ones."""
    ends = (
        hashes.filter(F.col("position") == F.col("n_turns") - 1)
        .groupBy("n_turns", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    proper = (
        hashes.filter(F.col("position") < F.col("n_turns") - 1)
        .select((F.col("position") + 1).alias("n_turns"), "h1", "h2")
        .distinct()
    )
    return ends.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template; template marks inside a text are broken up, so they can't end a turn."""
    safe = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "< |$1| >")
    return F.concat(F.lit(START), F.lower(role), F.lit("\n"), safe, F.lit(f"{END}\n"))


def collapse_and_render(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turn, tie, n_turns, n_copies, segment: the rendered turns of every maximal conversation."""
    turns = _clean(conversations, conv, turn, role, text)
    kept = maximal(prefix_hashes(turns))
    return turns.join(kept, "conv_id").select(
        "conv_id", "turn", "tie", "n_turns", "n_copies", rendered(F.col("role"), F.col("text")).alias("segment")
    )
