"""Connected components of a link table by contraction, in DataFrames only.

Each round hooks every node onto its smallest neighbour (or itself), shortens
the hooks twice, and keeps the links between different hooks: at least half of
the linked nodes vanish in every round, so the rounds grow with the logarithm
of the input.  Every round is a written table; minima are combined on the map
side, so a node with very many links is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import discard, settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b", of: Iterable[DataFrame] = ()) -> DataFrame:
    """node, root: the smallest node reachable, as a settled table; nodes without a link do not appear.  of: settled tables whose bytes say how large links is, about."""
    first, second = F.col(a), F.col(b)
    edges = settle(links.where(first != second).select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).distinct(), "links", of)
    maps: list[DataFrame] = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "hooks", [edges])
        short = hooks
        for _ in range(2):
            short = short.join(short.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", F.col("up").alias("root"))
        maps.append(settle(short, "roots", [hooks]))
        left = maps[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = maps[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        apart = edges.join(left, "a").join(right, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, edges = edges, settle(apart, "links", [edges])
        discard(before, hooks)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for k, later in enumerate(maps):
        up = later.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")) if k else later
    out = settle(out, "components", maps[:1] or [edges])
    discard(edges, *maps)
    return out
