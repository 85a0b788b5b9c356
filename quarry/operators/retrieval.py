"""Vector, keyword and graph retrieval under access control."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cosine_distance, keyword_hits


def secure_knn(chunks: DataFrame, query: list[float], visible: Column, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k visible chunks nearest by cosine distance; the filter stands below the distance, ties go by key."""
    probe = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.where(visible).withColumn("distance", F.round(cosine_distance(F.col("embedding"), probe), 9))
    return scored.orderBy("distance", key).limit(k)


def hybrid_search(chunks: DataFrame, query: list[float], words: str, visible: Column, k: int = 10, keyword_weight: float = 0.3, key: str = "doc_id", texts: DataFrame | None = None) -> DataFrame:
    """Three times k candidates (100 at most) by distance, ranked again by closeness and by the words that they hold.

    texts: key and text, where chunks have none: only the candidates' texts are fetched then.
    """
    asked = sorted(set(re.findall("[a-zA-Z0-9가-힣]+", words.lower())))
    near = secure_knn(chunks, query, visible, min(3 * k, 100), key)
    near = texts.join(F.broadcast(near), key) if texts is not None else near  # at most 100 rows
    near = near.withColumn("hits", keyword_hits(asked, F.col("text")))
    every = Window.partitionBy()  # at most 100 rows
    close = 1.0 - F.col("distance") / F.greatest(F.max("distance").over(every), F.lit(1e-9))
    found = F.col("hits") / F.greatest(F.max("hits").over(every), F.lit(1))
    return near.withColumn("score", F.round((1 - keyword_weight) * close + keyword_weight * found, 6)).orderBy(F.desc("score"), key).limit(k)


def named_in(query: str, name: Column) -> Column:
    """Whether a name is in the query, or shares a token with it, letters of either case."""
    token = "[a-zA-Z0-9가-힣-]+"
    asked = sorted(set(re.findall(token, query.lower())))
    low = F.lower(name)
    inside = F.contains(F.lit(query.lower()), low)
    return inside | F.arrays_overlap(F.regexp_extract_all(low, F.lit(token), F.lit(0)), F.array(*map(F.lit, asked))) if asked else inside


def matched_entities(entities: DataFrame, query: str, limit: int = 20, fuzzy: int = 50, index: DataFrame | None = None) -> DataFrame:
    """Entities whose name is in the query or shares a token with it, and the `fuzzy` names most like it; the most mentioned first.

    index: gram_index of the entities, where there is one.
    """
    from quarry.operators.fuzzy import fuzzy_top

    rows = entities.where(named_in(query, F.col("name")))
    if fuzzy:
        rows = rows.unionByName(fuzzy_top(entities, query, fuzzy, index).drop("score")).dropDuplicates(["id"])
    return rows.orderBy(F.desc("mentions"), "id").limit(limit)


def related_documents(matched: DataFrame, sources: DataFrame) -> DataFrame:
    """source_path and the rank of the first matched entity that names it.  matched: id, rank; sources: id, source_path."""
    return sources.join(F.broadcast(matched.select("id", "rank")), "id").groupBy("source_path").agg(F.min("rank").alias("rank"))


def local_context(matched: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """Edges around the matched entities, as lines, the first `most` of them by weight.  matched holds `most` rows at most."""
    from quarry.operators.graph import named_edges, subgraph

    around = named_edges(subgraph(edges, matched.select("id"), depth - 1), nodes)
    line = F.concat(F.lit("- "), F.col("src_name"), F.lit(" --["), F.col("relation_type"), F.lit("]--> "), F.col("dst_name"))
    return around.select("src", "dst", "weight", line.alias("line")).orderBy(F.desc("weight"), "src", "dst").limit(most)


def overlapping_communities(members: DataFrame, matched: DataFrame) -> DataFrame:
    """Communities that hold a matched entity, and how many."""
    return members.join(F.broadcast(matched.select("id")), "id", "left_semi").groupBy("community").agg(F.count(F.lit(1)).alias("n_matched"))


def fused_sources(vector: DataFrame, graph: DataFrame, n: int) -> DataFrame:
    """n graph sources, then vector ones not among them, up to twice n, numbered.  Both: title, rank."""
    first = graph.orderBy("rank", "title").limit(n).select("title", "rank", F.lit(0).alias("from_vector"))
    other = vector.orderBy("rank", "title").limit(2 * n).join(F.broadcast(first.select("title")), "title", "left_anti").select("title", "rank", F.lit(1).alias("from_vector"))
    both = first.unionByName(other)
    order = Window.partitionBy().orderBy("from_vector", "rank", "title")  # at most 3 n rows
    return both.withColumn("number", F.row_number().over(order)).where(F.col("number") <= 2 * n).select("number", "title", "from_vector")


def first_reason(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node the first edge that touches it: target before source, then by edge order.  edges: ord, src, dst, relation_type."""
    touch = edges.select(F.col("dst").alias("id"), "ord", F.lit(0).alias("side"), "relation_type").unionByName(edges.select(F.col("src").alias("id"), "ord", F.lit(1).alias("side"), "relation_type"))
    first = touch.groupBy("id").agg(F.min_by("relation_type", F.struct("ord", "side")).alias("relation_type"))
    return nodes.join(first, "id", "left").withColumn("reason", F.coalesce("relation_type", F.lit("related"))).drop("relation_type")


def passage_text(found: DataFrame, most: int = 800) -> DataFrame:
    """One text of all passages found, best first.  found: doc_id, heading, text, score."""
    one = F.concat(F.lit("["), F.format_string("%.3f", "score"), F.lit("] "), F.col("heading"), F.lit("\n"), F.left("text", F.lit(most)))
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("passages"))


def sufficient(found: DataFrame, matched: DataFrame, least: float = 0.35) -> DataFrame:
    """verdict: answer, rewrite (weak results) or refuse (weak and no entity)."""
    best = found.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"), F.count(F.lit(1)).alias("n"))
    known = matched.limit(1).agg((F.count(F.lit(1)) > 0).alias("known"))
    row = best.withColumn("_k", F.lit(1)).join(known.withColumn("_k", F.lit(1)), "_k")
    return row.select("best", F.when(F.col("best") >= least, "answer").when(~F.col("known"), "refuse").when(F.col("n") > 0, "rewrite").otherwise("answer").alias("verdict"))
