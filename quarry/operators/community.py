"""Louvain communities over an edge table of any size.

Every level is a loop of rounds over DataFrames.  A round adds up, for each
node and each community among its neighbours, the weight between them, prices
a move by the gain in modularity, and lets half of the nodes (another half each
round) take their best move; of two lone nodes only the one with the larger id
moves, so that they do not change places.  When rounds bring no more, the
communities become the nodes of a smaller edge table and the next level begins;
after the last one single nodes move once more between the communities found,
and the levels begin anew, as long as that brings something.
Weights are added up on the map side, no node, community or component has to
fit a task, and the best labels of a level are what is kept.

Results are the same in every run: halves are drawn by hash, ties go to the
smallest community.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import removed, written

#: Rounds of a level, rounds without a gain that end it, least gain in modularity that counts.
ROUNDS, PATIENCE, LEAST = 24, 2, 5e-4
PASSES = 3


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, weight of an undirected graph, each edge in both directions, a loop once with twice its weight; of edges between two nodes the heaviest counts."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    back = pairs.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return pairs.select("src", "dst", F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight")).unionByName(back)


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """Of a grouping of the nodes; members: id, community."""
    both = both_ways(edges)
    total = both.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    a, b = (members.select(F.col("id").alias(c), F.col("community").alias(f"{c}_c")) for c in ("src", "dst"))
    inside = both.join(a, "src").join(b, "dst").where("src_c = dst_c").agg(F.sum("weight")).first()[0] or 0.0
    return inside / total - resolution * _squares(both.groupBy("src").agg(F.sum("weight").alias("degree")).join(a, "src").groupBy("src_c").agg(F.sum("degree").alias("degree")), total)


def _squares(totals: DataFrame, total: float) -> float:
    return totals.agg(F.sum(F.pow(F.col("degree") / total, F.lit(2)))).first()[0] or 0.0


def _priced(both: DataFrame, nodes: DataFrame, totals: DataFrame, total: float, resolution: float) -> DataFrame:
    """id, degree, community, inside (weight to the own one), best (community), gain.  nodes: id, degree, community; totals: community, degree, size."""
    where = nodes.select(F.col("id").alias("dst"), "community")
    votes = both.where("src != dst").join(where, "dst").select(F.col("src").alias("id"), "community", "weight")
    votes = votes.unionByName(nodes.select("id", "community", F.lit(0.0).alias("weight"))).groupBy("id", "community").agg(F.sum("weight").alias("weight"))
    about = nodes.select("id", "degree", F.col("community").alias("own"))
    rows = votes.join(about, "id").join(totals.select("community", F.col("degree").alias("mass"), "size"), "community")
    here = F.col("community") == F.col("own")
    worth = F.col("weight") - resolution * F.col("degree") * (F.col("mass") - F.when(here, F.col("degree")).otherwise(0.0)) / total
    rows = rows.withColumn("worth", worth)
    other = F.when(~here, F.struct((-F.col("worth")).alias("o"), "community", "size"))
    found = rows.groupBy("id").agg(F.first("degree").alias("degree"), F.first("own").alias("community"), F.max(F.when(here, F.col("weight"))).alias("inside"), F.max(F.when(here, F.col("worth"))).alias("stay"), F.max(F.when(here, F.col("size"))).alias("own_size"), F.min(other).alias("best"))
    return found.select("id", "degree", "community", "inside", "own_size", F.col("best.community").alias("best"), F.col("best.size").alias("best_size"), (-F.col("best.o") - F.col("stay")).alias("gain"))


def _turn(number: int) -> Column:
    """The half of the nodes that may move in a round."""
    return F.pmod(F.xxhash64("id", F.lit(number // 2)), F.lit(2)) == number % 2


def level(both: DataFrame, resolution: float, start: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, float, float]:
    """(id, community) of one level, the modularity it starts with, and the one reached; it starts from given communities, or from all nodes alone."""
    nodes = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    nodes = nodes.withColumn("community", F.col("id")) if start is None else nodes.join(start, "id")
    total, loops = both.agg(F.sum("weight"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))).first()
    best, kept, first, idle, tables = None, None, None, 0, []
    lone = (F.col("own_size") == 1) & (F.col("best_size") == 1) & (F.col("best") > F.col("community"))
    moves = F.coalesce((F.col("gain") > 1e-9) & ~lone, F.lit(False))
    for number in range(rounds + 1):
        totals = nodes.groupBy("community").agg(F.sum("degree").alias("degree"), F.count(F.lit(1)).alias("size"))
        priced = written(_priced(both, nodes, totals, total, resolution), "louvain")
        tables.append(priced)
        mass = priced.groupBy("community").agg(F.sum("degree").alias("degree"), F.sum("inside").alias("inside"), F.count(F.when(moves, 1)).alias("movable"))
        inside, movable, squares = mass.agg(F.sum("inside"), F.sum("movable"), F.sum(F.pow(F.col("degree") / total, F.lit(2)))).first()
        reached = (inside + loops) / total - resolution * squares
        first = reached if first is None else first
        idle = idle + 1 if best is not None and reached < best + LEAST else 0
        if best is None or reached > best:
            best, kept = reached, priced
        if not movable or idle >= PATIENCE:
            break
        nodes = priced.select("id", "degree", F.when(moves & _turn(number), F.col("best")).otherwise(F.col("community")).alias("community"))
    removed(*[t for t in tables if t is not kept])
    return kept.select("id", "community"), first, best


def _coarser(both: DataFrame, found: DataFrame) -> DataFrame:
    a, b = (found.select(F.col("id").alias(c), F.col("community").alias(f"{c}_c")) for c in ("src", "dst"))
    return written(both.join(a, "src").join(b, "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain")


def louvain_communities(edges: DataFrame, resolution: float = 1.0, passes: int = PASSES) -> DataFrame:
    """id, community (its smallest member).  edges: src, dst, weight; nodes without an edge do not appear."""
    whole = written(both_ways(edges), "louvain")
    members = whole.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    if not whole.where("weight > 0").take(1):
        return members
    last = None
    for k in range(passes):
        found, _, reached = level(whole, resolution, members if k else None)
        members, both, before = found, whole, None
        while before is None or reached >= before + LEAST:
            both = _coarser(both, found)
            found, before, reached = level(both, resolution)
            up = found.select(F.col("id").alias("community"), F.col("community").alias("up"))
            members = written(members.join(up, "community").select("id", F.col("up").alias("community")), "louvain")
        if last is not None and reached < last + LEAST:
            break
        last = reached
    names = members.groupBy("community").agg(F.min("id").alias("name"))
    return members.join(names, "community").select("id", F.col("name").alias("community"))
