"""Graph-aware retrieval under access control: local, global and hybrid search, contexts, entity details.

Every search gives one table (section, item, ...): matched and related entities,
relations, communities, sources.  What is matched is bounded (20 entities), so
are the seeds of a traversal; everything else stays distributed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.acl import readable_entities
from quarry.operators.retrieval import matched_entities
from quarry.sources.tables import written

MATCHED, RELATIONS, COMMUNITIES, PASSAGE, PROMPT_TEXT = 20, 20, 20, 800, 800
#: Names most like the query that are matched besides those that it holds.
FUZZY = 50
#: Properties that a context shows, and their labels (fixed values).
SHOWN: Mapping[str, str] = {
    "product_code": "상품코드",
    "rider_code": "보종코드",
    "coverage_amount": "보장금액",
    "coverage_period": "보장기간",
    "payment_period": "납입기간",
    "waiting_period": "면책기간",
    "renewal_type": "갱신유형",
    "surrender_type": "환급유형",
    "surrender_ratio": "환급비율",
    "underwriting_class": "심사등급",
    "age_range": "가입연령",
    "claim_conditions": "지급조건",
    "exclusions": "면책사항",
    "duplicate_surgery_rule": "중복수술규칙",
    "effective_date": "시행일",
    "severity": "중증도",
    "icd_code": "질병코드",
    "rate_reference": "위험률출처",
    "parent_product": "주계약",
    "base_amount": "기준가입금액",
    "sub_types": "세부유형",
    "mandatory_riders": "의무동시가입",
}
#: Headings of a context (fixed values).
ASKED, FOUND, SUMMARIES, NO_SUMMARY = "[검색 쿼리: ", "=== 검색 결과 (벡터 검색) ===", "=== 커뮤니티 요약 ===", "(요약 없음)"


def reached(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, hops (0 for the seeds): what lies within depth steps of any seed, along edges in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = seeds.select("id", F.lit(0).alias("hops")).distinct()
    for hop in range(1, depth + 1):
        out = written(out)  # else every step holds the plans of all before twice
        step = both.join(out.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(hop).alias("hops"))
        out = out.unionByName(step).groupBy("id").agg(F.min("hops").alias("hops"))
    return written(out)


def visible(entities: DataFrame, sources: DataFrame, may_read: Column) -> DataFrame:
    """Entities without a source, or with one that may be read."""
    return readable_entities(entities, sources, sources.where(may_read)).drop("readable_paths")


def _items(df: DataFrame, section: str, item: Column | str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.col(item) if isinstance(item, str) else item).alias("item"))


def local_search(query: str, entities: DataFrame, edges: DataFrame, members: DataFrame, sources: DataFrame, may_read: Column, depth: int = 2, fuzzy: int = FUZZY) -> DataFrame:
    """section, item: matched and related entities that may be seen, relations met on the way, communities of the matched, sources that may be read.

    entities: id, name, mentions; edges: src, dst, relation_type; members: community, id; sources: id, source_path.
    """
    matched = written(visible(matched_entities(entities, query, MATCHED, fuzzy), sources, may_read).select("id"))
    near = reached(edges, matched, depth)
    related = written(visible(entities.select("id").join(near.where("hops > 0"), "id", "left_semi"), sources, may_read).select("id"))
    inner = near.where(F.col("hops") < depth).select("id")
    met = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
    lines = met.select("src", "dst", "relation_type").distinct().orderBy("src", "dst", "relation_type").limit(RELATIONS)
    touched = members.join(F.broadcast(matched), "id", "left_semi").select("community").distinct()
    paths = sources.where(may_read).join(matched.unionByName(related).distinct(), "id", "left_semi").select("source_path").distinct()
    parts = [_items(matched, "matched", "id"), _items(related, "related", "id"), _items(lines, "relation", F.concat_ws("|", "src", "relation_type", "dst")), _items(touched, "community", "community"), _items(paths, "source", "source_path")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summarised_communities(communities: DataFrame) -> DataFrame:
    """Communities with a summary, all of them if none has one.  communities: community, name, summary, size."""
    has = F.coalesce(F.col("summary"), F.lit("")) != ""
    wanted = communities.agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("has"))  # one row
    return communities.withColumn("has", has).join(F.broadcast(wanted), "has", "left_semi").drop("has")


def global_search(communities: DataFrame, near: DataFrame) -> DataFrame:
    """section, item: the summarised communities and the documents that vectors find.  near: path."""
    return _items(summarised_communities(communities), "community", "community").unionByName(_items(near, "vector", "path"))


def hybrid_graph_search(query: str, near: DataFrame, *graph, fuzzy: int = FUZZY) -> DataFrame:
    """section, item: what local_search gives, the documents that vectors find, and the sources of both."""
    own, vector = local_search(query, *graph, fuzzy=fuzzy), _items(near, "vector", "path")
    sources = own.where("section = 'source'").unionByName(vector.select(F.lit("source").alias("section"), "item")).distinct()
    return own.where("section <> 'source'").unionByName(vector).unionByName(sources)


def graph_search(mode: str, query: str, near: DataFrame, communities: DataFrame, *graph, fuzzy: int = FUZZY) -> DataFrame:
    """local, global, or else hybrid search."""
    mode = mode.lower()
    return local_search(query, *graph, fuzzy=fuzzy) if mode == "local" else global_search(communities, near) if mode == "global" else hybrid_graph_search(query, near, *graph, fuzzy=fuzzy)


def _joined(rows: DataFrame, order: list[Column], line: Column, name: str) -> DataFrame:
    """One text of bounded rows, a line each."""
    listed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))))
    return rows.agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias(name))


def global_context(query: str, communities: DataFrame, near: DataFrame) -> DataFrame:
    """context: the query, the passages found and the summaries of the largest communities as one text.  near (bounded): path, text, score, doc_id."""
    score = F.rank().over(_ranked())
    head = F.concat(F.lit("["), score.cast("string"), F.lit("] "), "path", F.format_string(" (score=%.3f)", "score"))
    passages = near.select("doc_id", "score", F.concat(head, F.lit("\n"), F.trim(F.left("text", F.lit(PASSAGE))), F.lit("\n")).alias("line"))
    passages = _joined(passages, [-F.col("score"), F.col("doc_id")], F.col("line"), "passages")
    top = summarised_communities(communities).orderBy(F.desc("size"), "community").limit(COMMUNITIES)
    shown = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", NO_SUMMARY).otherwise(F.col("summary"))
    summaries = _joined(top, [-F.col("size"), F.col("community")], F.concat(F.lit("- "), "name", F.lit(": "), shown), "summaries")
    block = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(title + "\n"), F.col(c)))
    both = passages.select("passages", F.lit("").alias("summaries")).unionByName(summaries.select(F.lit("").alias("passages"), "summaries")).agg(F.max("passages").alias("passages"), F.max("summaries").alias("summaries"))
    return both.select(F.concat_ws("\n", F.lit(f"{ASKED}{query}]\n"), block(FOUND, "passages"), F.concat(F.lit(SUMMARIES + "\n"), "summaries")).alias("context"))


def _ranked():
    from pyspark.sql import Window

    return Window.partitionBy().orderBy(F.desc("score"), "doc_id")  # of the few rows that a search returns


def shown_properties(properties: Column) -> Column:
    """The fixed list of properties that have a value, as label=value, comma-joined."""
    pairs = [F.when(F.coalesce(F.element_at(properties, F.lit(k)), F.lit("")) != "", F.concat(F.lit(label + "="), F.element_at(properties, F.lit(k)))) for k, label in SHOWN.items()]
    return F.array_join(F.array_compact(F.array(*pairs)), ", ")


def prompt_context(query: str, entities: DataFrame, sources: DataFrame, may_read: Column, n: int = 5, entity_type: str | None = None, fuzzy: int = FUZZY) -> DataFrame:
    """id, text: the n matched entities that may be seen, each as JSON of name, type and the properties shown, cut at 800 characters.

    entities: id, name, entity_type, mentions, properties map<string,string>.
    """
    kept = entities.where(F.col("entity_type") == entity_type) if entity_type else entities
    top = visible(matched_entities(kept, query, MATCHED, fuzzy), sources, may_read).orderBy(F.desc("mentions"), "id").limit(n)
    text = F.to_json(F.struct("name", F.col("entity_type").alias("type"), shown_properties(F.col("properties")).alias("properties")))
    return top.select("id", F.left(text, F.lit(PROMPT_TEXT)).alias("text"))


def community_tags(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with the community they are in, the last one where there are several, null without one.  members: community, id, ord."""
    last = members.groupBy("id").agg(F.max_by("community", "ord").alias("community"))
    return nodes.join(last, "id", "left")


def entity_detail(entities: DataFrame, edges: DataFrame, sources: DataFrame, may_read: Column, start: str) -> DataFrame:
    """section, item: the entity, its neighbours and the relations to them, as far as they may be seen; nothing if the entity may not."""
    own = written(visible(entities.where(F.col("id") == start), sources, may_read).select("id"))
    touching = edges.where((F.col("src") == start) | (F.col("dst") == start)).withColumn("id", F.lit(start)).join(own, "id", "left_semi").drop("id")
    other = F.when(F.col("src") == start, F.col("dst")).otherwise(F.col("src"))
    touching = written(touching)
    seen = written(visible(entities.select("id").join(touching.select(other.alias("id")).distinct(), "id", "left_semi"), sources, may_read).select("id"))
    lines = touching.withColumn("id", other).join(seen, "id", "left_semi").select("src", "dst", "relation_type").distinct()
    return _items(own, "entity", "id").unionByName(_items(seen, "neighbour", "id")).unionByName(_items(lines, "relation", F.concat_ws("|", "src", "relation_type", "dst")))


def merged_subgraphs(subgraphs: list[DataFrame], key: str = "id") -> DataFrame:
    """One row for each key of several tables, from the first that has it."""
    every = None
    for i, df in enumerate(subgraphs):
        rows = df.withColumn("_from", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    rest = [c for c in subgraphs[0].columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "_from").alias("_first")).select(key, *[F.col("_first")[c].alias(c) for c in rest])
