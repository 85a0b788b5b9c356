"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, those whose hashed id
is smallest) and every vector is put into a leaf.  A query walks the tree best
bin first: a priority queue holds the branches met so far by the inner product
of the query and the branch's centre, and leaves are visited in that order.
How many are visited is calibrated: for ``PROBES`` of the queries, the true
neighbours are found among all rows, and the visits widen until ``RECALL`` of
these is reached.

Equal vectors are one point that carries its smallest ids (k + 1, as no more can
be among the k nearest of any query), and equal queries are answered once.  A
leaf with many points is cut into blocks, many queries for it into chunks; every
pair of a block and a chunk is one small matrix product.  Broadcast are the tree
(bounded by the sample) and a count per leaf.

Nearness is the inner product in double precision, ties go to the smaller id.
Defined results: vectors that are null, zero, hold null or non-finite
components, or are not of the most common length take no part, nor do rows
without an id; repeated rows count once; queries with no other vector have no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import settle

SAMPLE = 16_384
#: Vectors of a leaf; fewer where all would be in one.
LEAF = 1024
SMALLEST_LEAF = 4
BRANCHES = 8
PROBES = 100
RECALL = 0.94
BLOCK = 4096
CHUNK = 2048
#: Queries of one matrix product.
ROWS = 256
SEED = 11


class KMeansTree:
    """Centres of all nodes and the children of each; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.rng = np.random.default_rng(SEED)
        self.centres: list[np.ndarray] = []  # of the children of each inner node
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []  # -1 for inner nodes
        self.n_leaves = 0
        self._grow(sample, max(leaf, 1))

    def _grow(self, points: np.ndarray, leaf: int) -> None:
        todo = [(self._node(), points)]
        while todo:
            node, own = todo.pop()
            parts = self._split(own) if len(own) > leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = self.n_leaves
                self.n_leaves += 1
                continue
            self.centres[node] = np.stack([p.mean(0) for p in parts])
            for p in parts:
                child = self._node()
                self.children[node].append(child)
                todo.append((child, p))

    def _node(self) -> int:
        self.centres.append(np.zeros((0, 0)))
        self.children.append([])
        self.leaf_of.append(-1)
        return len(self.leaf_of) - 1

    def _split(self, own: np.ndarray) -> list[np.ndarray]:
        centres = own[[int(self.rng.integers(len(own)))]]
        away = ((own - centres[0]) ** 2).sum(1)
        while len(centres) < BRANCHES and away.max() > 0:
            pick = int(self.rng.choice(len(own), p=away / away.sum()))
            centres = np.vstack([centres, own[pick]])
            away = np.minimum(away, ((own - own[pick]) ** 2).sum(1))
        for _ in range(8):
            at = _nearest(own, centres)
            centres = np.stack([own[at == i].mean(0) if (at == i).any() else c for i, c in enumerate(centres)])
        at = _nearest(own, centres)
        return [own[at == i] for i in range(len(centres)) if (at == i).any()]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down to the nearest centre."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if self.leaf_of[node] >= 0:
                out[own] = self.leaf_of[node]
            elif len(own):
                at = _nearest(points[own], self.centres[node])
                todo += [(c, own[at == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves of the query, best bin first."""
        out: list[int] = []
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                out.append(self.leaf_of[node])
            else:
                for score, child in zip((self.centres[node] @ query).tolist(), self.children[node]):
                    heapq.heappush(queue, (-score, child))
        return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, key (equal for equal vectors), v array<double>."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return rows.select("vec_id", F.unhex(F.md5(F.array_join(F.col("v").cast("array<string>"), ","))).alias("key"), "v")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def _truth(rows: DataFrame, queries: pd.DataFrame, k: int) -> dict[int, np.ndarray]:
    """For each probing query the vectors of its true neighbours, from all rows; each task gives its own k best."""
    ids, q = queries["vec_id"].to_numpy(), _matrix(queries["v"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int, list]]] = {}
        for frame in frames:
            frame = frame.drop_duplicates(["vec_id", "key"])
            scores = q @ _matrix(frame["v"]).T
            names = frame["vec_id"].to_numpy()
            for i in range(len(ids)):
                top = np.argsort(-scores[i], kind="stable")[: k + 1]
                own = best.setdefault(i, [])
                own += [(-scores[i, j], int(names[j]), frame["v"].iloc[j]) for j in top if names[j] != ids[i]]
                own[:] = {x[:2]: x for x in sorted(own, key=lambda x: x[:2])}.values()
                del own[k:]
        yield pd.DataFrame([(i, s, n, v) for i, own in best.items() for s, n, v in own], columns=["i", "s", "n", "v"])

    found = rows.select("vec_id", "key", "v").mapInPandas(run, "i int, s double, n long, v array<double>")
    nearest = F.row_number().over(Window.partitionBy("i").orderBy("s", "n"))  # of a task's best, so few rows for each probe
    found = found.dropDuplicates(["i", "s", "n"]).withColumn("r", nearest).where(F.col("r") <= k).drop("r").toPandas()
    return {int(i): _matrix(g["v"]) for i, g in found.groupby("i")}


def calibrated_visits(tree: KMeansTree, rows: DataFrame, queries: pd.DataFrame, k: int, recall: float) -> int:
    """The fewest leaf visits that find the wanted share of the probes' true neighbours."""
    if not len(queries) or tree.n_leaves == 1:
        return 1
    truth = _truth(rows, queries, k)
    q = _matrix(queries["v"])
    needed = []
    for i, neighbours in truth.items():
        place = {leaf: n for n, leaf in enumerate(tree.visit(q[i], tree.n_leaves))}
        needed += [place[leaf] + 1 for leaf in tree.assign(neighbours).tolist()]
    if not needed:
        return 1
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def nearest_neighbours(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, itself left out."""
    rows = settle(valid_vectors(table, id_col, vec_col), "vectors")
    spark = rows.sparkSession
    asked = rows.withColumn("asked", is_query)
    kept = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = kept.groupBy("key").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    points = settle(points, "points")
    n = points.count()
    sample = points.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toPandas()
    tree = KMeansTree(_matrix(sample["v"]), max(SMALLEST_LEAF, min(leaf, n // BRANCHES) * len(sample) // max(n, 1)))
    probes = asked.where("asked").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).select("vec_id", "v").toPandas()
    visits = calibrated_visits(tree, rows, probes, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = _matrix(f["v"])
            yield pd.DataFrame({"key": f["key"], "ids": f["ids"], "v": [x.tobytes() for x in v], "leaf": shared.value.assign(v) if len(f) else np.zeros(0, np.int32)})

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = _matrix(f["v"])
            yield pd.DataFrame({"key": f["key"], "v": [x.tobytes() for x in v], "leaves": [shared.value.visit(x, visits) for x in v]})

    placed = settle(points.mapInPandas(place, "key binary, ids array<long>, v binary, leaf int"), "placed")
    queries = asked.where("asked").groupBy("key").agg(F.first("v").alias("v"))
    routed = settle(queries.mapInPandas(route, "key binary, v binary, leaves array<int>"), "routed").select("key", "v", F.explode("leaves").alias("leaf"))
    load = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(
        routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "leaf"
    )
    load = F.broadcast(load)  # a row per leaf: bounded by the sample
    slot = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = placed.join(load, "leaf").select("leaf", slot("blocks").alias("block"), each("chunks").alias("chunk"), "key", "ids", "v")
    b = routed.join(load, "leaf").select("leaf", each("blocks").alias("block"), slot("chunks").alias("chunk"), "key", "v")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "s": [], "i": []})
        p = np.stack([np.frombuffer(x) for x in left["v"]])
        q = np.stack([np.frombuffer(x) for x in right["v"]])
        ids = left["ids"].tolist()
        first = np.array([i[0] for i in ids])
        alone = np.array([len(i) == 1 for i in ids])
        size = np.sqrt((p**2).sum(1)).max() * np.sqrt((q**2).sum(1))
        key, out = right["key"].tolist(), []
        for a in range(0, len(q), ROWS):
            rough = q[a : a + ROWS] @ p.T
            most = min(k + 1, len(p))
            limit = np.partition(rough, len(p) - most, axis=1)[:, len(p) - most] - 1e-12 * size[a : a + ROWS]
            for i in range(len(rough)):  # what may be among the best is scored again in the order of the components
                near = np.flatnonzero(rough[i] >= limit[i])
                s = (p[near] * q[a + i]).sum(1)
                top = np.lexsort((first[near], -s))[:most]
                if alone[near[top]].all():
                    out.append((key[a + i], -s[top], first[near[top]]))
                    continue
                best = sorted((-float(s[j]), int(x)) for j in top for x in ids[near[j]])[: k + 1]
                out.append((key[a + i], np.array([x for x, _ in best]), np.array([n for _, n in best])))
        return pd.DataFrame(out, columns=["key", "s", "i"])

    found = a.groupBy("leaf", "block", "chunk").cogroup(b.groupBy("leaf", "block", "chunk")).applyInPandas(score, "key binary, s array<double>, i array<long>")
    found = found.select("key", F.arrays_zip("s", "i").alias("found"))
    best = settle(found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")), "found")
    own = asked.where("asked").select(F.col("vec_id").alias("query_id"), "key").distinct().join(best, "key")
    listed = own.select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["i"] != F.col("query_id")), 1, k)))
    return listed.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.i").alias("vec_id"), (-F.col("col.s")).alias("score"))
