"""The knowledge graph as two tables: upserts, layers, traversal, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import written


def upsert_entities(events: DataFrame) -> DataFrame:
    """Raw entity rows, by id: the first row's name and type, mentions, ordered distinct paths, properties of which the first value stays.

    events: id, name, entity_type, ord, source_path, prop_key, prop_value, mentions (optional, 1).
    """
    mentions = F.col("mentions") if "mentions" in events.columns else F.lit(1)
    rows = events.withColumn("m", mentions)
    base = rows.groupBy("id").agg(
        F.min_by("name", "ord").alias("name"), F.min_by("entity_type", "ord").alias("entity_type"), (F.greatest(F.min_by("m", "ord"), F.lit(1)) + F.count(F.lit(1)) - 1).alias("mentions")
    )
    firsts = rows.groupBy("id", "source_path").agg(F.min("ord").alias("ord"))
    paths = firsts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_path"))), lambda x: x["source_path"]).alias("source_paths"))
    props = rows.where("prop_key is not null and prop_value <> ''").groupBy("id", "prop_key").agg(F.min_by("prop_value", "ord").alias("v"))
    maps = props.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("prop_key", "v"))).alias("p"))
    return base.join(paths, "id").join(maps, "id", "left").withColumn("properties", F.map_from_entries("p")).drop("p")


def upsert_edges(events: DataFrame, by_relation: bool = False) -> DataFrame:
    """Raw edge rows, by ordered pair: the first row's type, path and (where there are any) properties, its weight and one more for each repeat."""
    keys = ["src", "dst", "relation_type"] if by_relation else ["src", "dst"]
    kept = [c for c in ("relation_type", "source_path", "properties") if c in events.columns and c not in keys]
    first = F.min_by(F.struct(*kept, "weight"), "ord").alias("first")
    rows = events.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n"))
    return rows.select(*keys, *[F.col(f"first.{c}").alias(c) for c in kept], (F.col("first.weight") + F.col("n") - 1).alias("weight"))


def stub_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes, as nodes of their own."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("name"), F.lit("concept").alias("entity_type"), F.lit(0).cast("long").alias("mentions"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, label, n: counts by entity type and by relation type, and the totals."""
    one = lambda df, kind, col: df.groupBy(F.lit(kind).alias("kind"), F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("label"), "n")
    return one(nodes, "entity", "entity_type").unionByName(one(edges, "relation", "relation_type")).unionByName(total(nodes, "nodes")).unionByName(total(edges, "edges"))


def merged_layers(base: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """Base rows with the overlay's attributes on top, attribute by attribute; an overlay's null leaves the base's value."""
    rest = [c for c in base.columns if c != key]
    both = base.withColumn("_l", F.lit(0)).unionByName(overlay.withColumn("_l", F.lit(1)))
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_l"))).alias(c) for c in rest])


def neighbours(edges: DataFrame, start: str, depth: int, relations: list[str] | None = None) -> DataFrame:
    """id, hops: what lies within depth steps of start, along edges in either direction; start itself is left out.

    The frontier is a table joined with the edges once per step, edges being filtered first.
    """
    kept = edges.where(F.col("relation_type").isin(*relations)) if relations else edges
    both = kept.select("src", "dst").unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    frontier = seen
    for hop in range(1, depth + 1):
        nxt = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = nxt.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"))
        if hop < depth:
            frontier = written(frontier)
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def traversed(edges: DataFrame, start: str, depth: int, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id and hops of what lies within depth steps of start, the edges met on the way and the step that met them first).

    A step leaves the nodes that the last one reached, along edges in either direction; an edge is met once for each ordered pair, with
    its properties, also where it leads back to a node that was seen before.
    """
    kept = edges.where(F.col("relation_type").isin(*relations)) if relations else edges
    seen = frontier = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    met = None
    for hop in range(1, depth + 1):
        ends = frontier.select(F.col("id").alias("at"))
        out = kept.join(ends, F.col("src") == F.col("at")).withColumn("to", F.col("dst"))
        back = kept.join(ends, F.col("dst") == F.col("at")).withColumn("to", F.col("src"))
        touched = written(out.unionByName(back).drop("at").withColumn("hop", F.lit(hop)))
        fresh = touched.select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = written(fresh.select("id", F.lit(hop).alias("hops")))
        seen = seen.unionByName(frontier)
        met = touched if met is None else met.unionByName(touched)
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    if met is None:
        return seen.where("hops > 0"), edges.where("false").withColumn("hop", F.lit(0))
    once = met.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), "hop").alias("first"), F.min("hop").alias("hop"))
    return seen.where("hops > 0"), once.select("src", "dst", *[F.col(f"first.{c}").alias(c) for c in rest], "hop")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Edges among the seeds and what lies within depth steps of any of them."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ids = seeds.select("id").distinct()
    for _ in range(depth):
        step = both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        ids = ids.unionByName(step).distinct()
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends, or the ids where a name is missing."""
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(side + "_name"))
    out = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return out.withColumns({"src_name": F.coalesce("src_name", "src"), "dst_name": F.coalesce("dst_name", "dst")})


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that can be reached; minima spread along edges, then along themselves, until nothing changes."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    both = written(both)
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("component"))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        better = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = better.join(labels.select(F.col("id").alias("component"), F.col("component").alias("far")), "component", "left")
        labels = written(jump.select("id", F.least("component", F.coalesce("far", "component")).alias("component"), "old"))
        if not labels.where("component != old").take(1):
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def label_communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """id, community: weighted label spreading; each round every node takes the label that weighs most among its neighbours, ties to the smallest."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = written(both.groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        own = labels.select(F.col("id").alias("src"), "community", F.lit(0.5).alias("w"))  # a node clings to its label a little
        all_votes = votes.unionByName(own).groupBy("src", "community").agg(F.sum("w").alias("w"))
        labels = written(all_votes.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community")))
    return labels


def louvain(nodes: int, links: list[tuple[int, int, float]], resolution: float = 1.0) -> list[int]:
    """Communities of a small undirected weighted graph: local moves in node order, then the same over communities, while modularity rises."""
    member = list(range(nodes))
    graph: list[dict[int, float]] = [{} for _ in range(nodes)]
    for a, b, w in links:
        graph[a][b] = graph[a].get(b, 0.0) + w
        if a != b:
            graph[b][a] = graph[b].get(a, 0.0) + w
    while True:
        size = len(graph)
        degree = [sum(g.values()) + g.get(i, 0.0) for i, g in enumerate(graph)]
        total = sum(degree)
        at, inside = list(range(size)), degree[:]
        moved_any, moved = False, total > 0
        while moved:
            moved = False
            for i in range(size):
                weights: dict[int, float] = {}
                for j, w in graph[i].items():
                    if j != i:
                        weights[at[j]] = weights.get(at[j], 0.0) + w
                inside[at[i]] -= degree[i]
                gain = lambda c: weights.get(c, 0.0) - resolution * inside[c] * degree[i] / total  # noqa: B023, E731
                best = at[i]
                for c in sorted(weights):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                inside[best] += degree[i]
                if best != at[i]:
                    at[i], moved, moved_any = best, True, True
        names = {c: k for k, c in enumerate(dict.fromkeys(at))}
        member = [names[at[m]] for m in member]
        if not moved_any:
            return member
        merged: list[dict[int, float]] = [{} for _ in names]
        for i, g in enumerate(graph):
            for j, w in g.items():
                if i <= j:
                    a, b = names[at[i]], names[at[j]]
                    merged[a][b] = merged[a].get(b, 0.0) + w
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + w
        graph = merged


def community_table(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, name (its most mentioned member's, the smallest id first), size, entity_ids."""
    rows = members.join(nodes.select("id", "name", "mentions"), "id", "left")
    top = F.min_by(F.coalesce("name", "id"), F.struct(-F.coalesce("mentions", F.lit(0)), "id"))
    return rows.groupBy("community").agg(F.concat(top, F.lit(" cluster")).alias("name"), F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("id")).alias("entity_ids"))


def newest_versions(entities: DataFrame, as_of: str) -> DataFrame:
    """Of entities of one name, the latest in force at the date; if none is dated, the best-ranked.  entities: name, effective_date, rank, ..."""
    in_force = entities.where(F.col("effective_date").isNull() | (F.col("effective_date") <= as_of))
    order = Window.partitionBy("name").orderBy(F.coalesce(F.col("effective_date") != "", F.lit(False)).desc(), F.col("effective_date").desc_nulls_last(), "rank")
    return in_force.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def repaired_paths(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Source paths put right: the current path of the file's name, else Public/ becomes Shared/.  entities: id, source_paths; files: path."""
    name = lambda c: F.substring_index(c, "/", -1)
    current = files.groupBy(name(F.col("path")).alias("base")).agg(F.min("path").alias("now"))
    rows = entities.select("id", F.posexplode("source_paths").alias("pos", "p")).withColumn("base", name(F.col("p")))
    fixed = rows.join(current, "base", "left").select("id", "pos", F.coalesce("now", F.regexp_replace("p", "^/?Public/", "Shared/")).alias("p"))
    return fixed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("source_paths"))


def layer_of(path: Column) -> Column:
    """The owner whose overlay a path belongs to, or base."""
    owner = F.regexp_extract(path, r"^/?Private/([^/]+)", 1)
    return F.when(owner != "", owner).otherwise("base")


def link_graph(docs: DataFrame) -> DataFrame:
    """Edges from documents to what they link to in double brackets.  docs: doc_id, path, md."""
    from quarry.functions.text import slug, stem, wikilinks

    rows = docs.select("path", F.posexplode(wikilinks(F.col("md"))).alias("pos", "target"), "doc_id")
    events = rows.select(slug(stem(F.col("path"))).alias("src"), slug(F.col("target")).alias("dst"), F.lit("references").alias("relation_type"), (F.col("doc_id") * 1000 + F.col("pos")).alias("ord"), F.col("path").alias("source_path"), F.lit(1.0).alias("weight"))
    return upsert_edges(events)
