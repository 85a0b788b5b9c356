"""Streamed answers put together: text and tool calls out of fragments that come in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last_given(name: str) -> Column:
    """The last value, in the order of fragments, that is not empty."""
    given = F.coalesce(F.col(name), F.lit("")) != ""
    return F.coalesce(F.max_by(F.when(given, F.col(name)), F.when(given, F.struct("ord", name))), F.lit("")).alias(name)


def tool_calls(fragments: DataFrame) -> DataFrame:
    """call, idx, id, name, arguments, n: of every call of a tool its pieces in their order.

    fragments: call, idx, ord, id, name, arguments (of a fragment: null or empty where it does not have them).  As a stream (update mode)
    a call is given anew whenever a fragment of it comes in, however late; the state holds the pieces of each call.
    """
    pieces = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("arguments", F.lit("")).alias("piece"))))
    text = F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("arguments")
    return fragments.groupBy("call", "idx").agg(_last_given("id"), _last_given("name"), text, F.count(F.lit(1)).alias("n"))


def read_arguments(calls: DataFrame, known: list[str]) -> DataFrame:
    """calls with fine: whether the tool is known and its arguments are JSON (or none at all)."""
    readable = (F.col("arguments") == "") | F.try_parse_json(F.col("arguments")).isNotNull()
    return calls.withColumn("fine", F.col("name").isin(*known) & readable)


def continued_answers(rounds: DataFrame, follow_up: int = 8) -> DataFrame:
    """call, text, n_rounds, cut: rounds joined as long as each was cut off by its length; cut if the last one allowed still was.

    rounds: call, round (from 0), text, finish (length where it was cut off).
    """
    listed = F.array_sort(F.collect_list(F.struct("round", F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("finish", F.lit("")) == "length").alias("more"))))
    rows = rounds.where(F.col("round") <= follow_up).groupBy("call").agg(listed.alias("r"))
    goes_on = F.transform("r", lambda r: r["more"] & (r["text"] != ""))
    n = F.coalesce(F.nullif(F.array_position(goes_on, F.lit(False)), F.lit(0)), F.size("r")).cast("int")
    told = rows.select("call", F.slice("r", F.lit(1), n).alias("r"))
    return told.select("call", F.array_join(F.transform("r", lambda r: r["text"]), "").alias("text"), F.size("r").alias("n_rounds"), F.element_at("r", -1)["more"].alias("cut"))
