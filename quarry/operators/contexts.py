"""Texts for a prompt out of the graph: related entities, relations and communities; entities of a skill with a notice of what is denied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.acl import readable_entities
from quarry.operators.fuzzy import fuzzy_search
from quarry.operators.graph import named_edges
from quarry.operators.graphrag import ASKED, FOUND, FUZZY, MATCHED, NO_SUMMARY, PASSAGE, SUMMARIES, reached, shown_properties, visible
from quarry.operators.retrieval import matched_entities
from quarry.sources.tables import written

#: Headings and marks of a context (fixed values).
ENTITIES, RELATIONS, SCOPE, ORIGIN = "=== 관련 엔티티 ===", "=== 관계 ===", " [범위: ", " [출처: "
#: What a skill says of entities that may not be seen (fixed values).
DENIED, DENIED_TEXT = ("[접근 제한 ", "건]"), ("권한이 없는 문서에서 ", "건의 관련 정보가 발견되었으나 접근이 제한됩니다. 관리자에게 열람 권한을 요청하세요.")
SENSITIVE = 3


def entity_line(entity_type: Column, name: Column, properties: Column, namespace: Column) -> Column:
    """One entity as a line: type, name, description, the properties shown, its scope and its document."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    given = lambda key: F.try_element_at(properties, F.lit(key))
    part = lambda c, before, after: F.when(has(c), F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    return F.concat(
        F.lit("- ["), entity_type, F.lit("] "), name, part(given("description"), ": ", ""), part(shown_properties(properties), " (", ")"), part(namespace, SCOPE, "]"), part(given("source_document"), ORIGIN, "]")
    )


def _lines(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    """One row: the lines of rows, in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.agg(F.array_join(F.transform(listed, lambda x: x["_line"]), "\n").alias("t"))


def graph_text(entities: DataFrame, relations: DataFrame, communities: DataFrame) -> DataFrame:
    """context: one text of entities, relations and community summaries, parts without rows left out.

    All three are results of a search: entities: ord, entity_type, name, properties, namespace; relations: ord, src_name, relation_type,
    dst_name; communities: ord, name, summary.
    """
    summary = F.when(F.coalesce("summary", F.lit("")) == "", NO_SUMMARY).otherwise(F.col("summary"))
    parts = [
        (ENTITIES, _lines(entities, ["ord"], entity_line(F.col("entity_type"), F.col("name"), F.col("properties"), F.col("namespace")))),
        (RELATIONS, _lines(relations, ["ord"], F.concat(F.lit("- "), "src_name", F.lit(" --["), "relation_type", F.lit("]--> "), "dst_name"))),
        (SUMMARIES, _lines(communities, ["ord"], F.concat(F.lit("- "), "name", F.lit(": "), summary))),
    ]
    rows = None
    for k, (title, text) in enumerate(parts):
        row = text.where("t <> ''").select(F.lit(k).alias("k"), F.concat(F.lit(title + "\n"), "t").alias("_text"))
        rows = row if rows is None else rows.unionByName(row)
    listed = F.array_sort(F.collect_list(F.struct("k", "_text")))
    return rows.agg(F.array_join(F.transform(listed, lambda x: x["_text"]), "\n\n").alias("context"))


def passages_text(near: DataFrame) -> DataFrame:
    """t: the passages that vectors found, numbered, best first.  near (bounded): doc_id, path, text, score."""
    nth = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id"))  # of the few rows that a search returns
    rows = near.withColumn("n", nth)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "path", F.format_string(" (score=%.3f)", "score"), F.lit("\n"), F.trim(F.left("text", F.lit(PASSAGE))), F.lit("\n"))
    return _lines(rows, ["n"], line).select(F.when(F.col("t") != "", F.concat(F.lit(FOUND + "\n"), "t")).otherwise("").alias("t"))


def combined_text(query: str, passages: DataFrame | None, graph: DataFrame) -> DataFrame:
    """context: the query, the passages and the graph's text in one."""
    both = graph.select(F.lit("").alias("p"), F.col("context").alias("g"))
    if passages is not None:
        both = both.unionByName(passages.select(F.col("t").alias("p"), F.lit("").alias("g")))
    row = both.agg(F.max("p").alias("p"), F.max("g").alias("g"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return row.select(F.regexp_replace(F.concat_ws("\n", F.lit(f"{ASKED}{query}]"), F.lit(""), filled("p"), filled("g")), r"(?U)^\s+|\s+$", "").alias("context"))


def search_context(query: str, entities: DataFrame, edges: DataFrame, members: DataFrame, communities: DataFrame, sources: DataFrame, may_read: Column, near: DataFrame | None = None, depth: int = 2, fuzzy: int = FUZZY) -> DataFrame:
    """context: the text of a local search, or (with near) of a hybrid one, as far as the entities may be seen.

    Matched entities come first, the most mentioned before the others, then related ones by distance and id; relations by the step that
    met them.  entities: id, name, entity_type, mentions, properties; edges: src, dst, relation_type; members: community, id;
    communities: community, name, summary; sources: id, source_path.
    """
    namespace = F.col("namespace") if "namespace" in entities.columns else F.lit("")
    every = entities.withColumn("namespace", namespace)
    matched = written(visible(matched_entities(every, query, MATCHED, fuzzy), sources, may_read))
    hops = reached(edges, matched.select("id"), depth)
    related = visible(every.join(hops.where("hops > 0"), "id"), sources, may_read)
    columns = ["id", "entity_type", "name", "properties", "namespace"]
    shown = matched.select(*columns, F.struct(F.lit(0).alias("hops"), (-F.col("mentions")).alias("m"), "id").alias("ord"))
    shown = shown.unionByName(related.select(*columns, F.struct("hops", F.lit(0).cast("long").alias("m"), "id").alias("ord")))
    steps = hops.where(F.col("hops") < depth)
    touched = edges.join(steps.select(F.col("id").alias("src"), "hops"), "src").select("src", "dst", "relation_type", "hops")
    touched = touched.unionByName(edges.join(steps.select(F.col("id").alias("dst"), "hops"), "dst").select("src", "dst", "relation_type", "hops"))
    once = touched.groupBy("src", "dst", "relation_type").agg(F.min("hops").alias("hops"))
    relations = named_edges(once, entities.select("id", "name")).withColumn("ord", F.struct("hops", "src", "dst", "relation_type"))
    own = members.join(F.broadcast(matched.select("id")), "id", "left_semi").select("community").distinct()  # 20 matched at most
    told = communities.join(own, "community", "left_semi").withColumn("ord", F.col("community"))
    return combined_text(query, None if near is None else passages_text(near), graph_text(shown, relations, told))


def skill_entities(query: str, entities: DataFrame, sources: DataFrame, may_read: Column, admin: bool = False, n: int = 5, entity_type: str | None = None) -> DataFrame:
    """ord, name, type, security_grade, sources, description: the n entities most like the query that a skill may show, and a notice of how many before the last of them it may not.

    Twice as many are fetched; an entity is denied if none of its sources may be read, or if it is sensitive, unless the user is an
    administrator.  entities: id, name, entity_type, security_grade, properties.
    """
    top = written(fuzzy_search(entities, query, entity_type, None, 2 * n).select("id", "name", "entity_type", F.coalesce("security_grade", F.lit(1)).alias("security_grade"), "properties", "score"))
    seen = readable_entities(top.select("id"), sources, sources.where(may_read | F.lit(admin)))
    rows = top.join(seen.select("id", "readable_paths", F.lit(True).alias("open")), "id", "left")
    fine = F.coalesce("open", F.lit(False)) & ((F.col("security_grade") < SENSITIVE) | F.lit(admin))
    order = Window.partitionBy().orderBy(F.desc("score"), "id")  # of the 2 n rows fetched
    rows = rows.withColumn("fine", fine).withColumn("before", F.coalesce(F.sum(F.col("fine").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(order))
    met = rows.where(F.col("before") < n)
    name = lambda p: F.split(F.replace(F.substring_index(p, "/", -1), F.lit(".md"), F.lit("")), "@")[0]
    names = F.transform(F.slice(F.coalesce("readable_paths", F.array().cast("array<string>")), 1, 3), name)
    shown = met.where("fine").select("nth", "name", F.col("entity_type").alias("type"), F.col("security_grade").cast("int").alias("security_grade"), F.array_join(names, ",").alias("sources"), F.try_element_at("properties", F.lit("description")).alias("description"))
    count = met.where("not fine").agg(F.count(F.lit(1)).cast("string").alias("c"))
    notice = count.where("c <> '0'").select(
        F.lit(2 * n + 1).alias("nth"), F.concat(F.lit(DENIED[0]), "c", F.lit(DENIED[1])).alias("name"), F.lit("notice").alias("type"), F.lit(None).cast("int").alias("security_grade"),
        F.lit("").alias("sources"), F.concat(F.lit(DENIED_TEXT[0]), "c", F.lit(DENIED_TEXT[1])).alias("description"),
    )
    return shown.unionByName(notice).withColumnRenamed("nth", "ord")
