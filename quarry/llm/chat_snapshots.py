"""Chat formatting by cumulative-snapshot collapse.

A chat service often logs a conversation again after every turn, so the log
holds prefixes of longer conversations.  A rolling hash over the turns names
every prefix of every conversation; a conversation whose whole hash is a proper
prefix hash of another is a snapshot and goes (anti-join); of conversations
that are equal turn by turn, the one with the smallest id stays.  What remains
is rendered.

The rolling hash is a running sum (exclusive or) over a window of the turns in
order, two times 64 bits, so a conversation of very many turns costs in proportion
to them.  Both sides of the anti-join are grouped to unique hashes first (with map-side
combining), so a first turn or a whole conversation that a third of the log
shares is one row on either side.

Defined results
* rows without a conversation id belong to no conversation and are left out;
* turns are ordered by (turn, role, text), a null turn first; a row logged
  twice with equal turn, role and text counts once;
* a null role or text counts as the empty string; a null turn number takes no
  part in the hash, nor does any turn number: only order does;
* other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_in_order(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per different turn: conv_id, at (from 1), role, text, prefix (the rolling hash after it), last (no turn follows)."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = log.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    # the place is hashed with the turn, so no two terms of a sum are alike
    link = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "at", "role", "text")).over(order)
    return rows.select("conv_id", "at", "role", "text", "last", F.struct(link(1).alias("a"), link(2).alias("b"), F.col("at").alias("n")).alias("prefix"))


def render(role: Column, text: Column) -> Column:
    """A turn as marked-up text; markers inside it are broken up so that no text can forge a turn."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def collapse_snapshots(log: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations that conv_id stands for, itself included), rendered."""
    turns = turns_in_order(log, **columns)
    keepers = turns.where("last").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = turns.where(~F.col("last")).select("prefix").distinct()
    maximal = keepers.join(prefixes, "prefix", "left_anti").select("conv_id", "n_copies")
    parts = turns.join(maximal, "conv_id").select("conv_id", "n_copies", F.struct("at", render(F.col("role"), F.col("text")).alias("part")).alias("turn"))
    whole = parts.groupBy("conv_id").agg(F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("turns.part"), "").alias("rendered"))
