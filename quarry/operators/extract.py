"""From text and model answers to raw entities and edges."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import entity_id, page_numbers, section_label, slug, stem

#: Properties that an answer may add (fixed values).
PROPERTIES = (
    "product_code rider_code coverage_amount coverage_period payment_period payment_frequency waiting_period renewal_type age_range underwriting_class premium_type surrender_type "
    "surrender_ratio base_amount sub_types parent_product effective_date document_type claim_conditions exclusions duplicate_surgery_rule icd_code severity article_number definition "
    "rate_reference expense_ratio lapse_rate premium_exemption mandatory_riders conversion_period revival_period content_type"
).split()
ANSWER = "entities array<struct<name: string, type: string, description: string, properties: map<string,string>>>, relationships array<struct<source: string, target: string, type: string, description: string>>"


def raw_entities(answers: DataFrame) -> DataFrame:
    """id, name, entity_type, properties, source_path, ord of every named entity.  answers: doc_id, path, text, answer struct."""
    rows = answers.select("doc_id", "path", "text", F.posexplode("answer.entities").alias("pos", "e")).withColumn("name", F.trim("e.name")).where("name <> ''")
    kind = F.lower(F.coalesce("e.type", F.lit("concept")))
    given = F.coalesce(F.map_filter("e.properties", lambda k, v: k.isin(*PROPERTIES) & (v != "")), F.create_map().cast("map<string,string>"))
    pages, section = page_numbers(F.col("text")), section_label(F.col("text"))
    own = F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, ("description", "source_document", "page_start", "page_end", "section_ref"))), F.array(F.coalesce("e.description", F.lit("")), stem(F.col("path")), F.array_min(pages).cast("string"), F.array_max(pages).cast("string"), section)),
        lambda _, v: v.isNotNull() & (v != ""),
    )
    properties = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(given, k)), given)
    return rows.select(entity_id(F.col("name"), kind, F.col("path"), F.try_element_at(given, F.lit("parent_product"))).alias("id"), "name", kind.alias("entity_type"), properties.alias("properties"), F.col("path").alias("source_path"), (F.col("doc_id") * 1000 + F.col("pos")).alias("ord"))


def raw_edges(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, relation_type, source_path, ord, weight; an end is the entity of that name in the same document (the last one), else the slug of the name."""
    names = entities.groupBy(F.col("source_path").alias("path"), F.lower("name").alias("low")).agg(F.max_by("id", "ord").alias("id"))
    rows = answers.select("doc_id", "path", F.posexplode("answer.relationships").alias("pos", "r")).select("doc_id", "path", "pos", F.trim("r.source").alias("s"), F.trim("r.target").alias("t"), F.coalesce("r.type", F.lit("references")).alias("relation_type")).where("s <> '' and t <> ''")
    end = lambda df, col, out: df.withColumn("low", F.lower(col)).join(names, ["path", "low"], "left").withColumn(out, F.coalesce("id", slug(F.col(col)))).drop("low", "id")
    placed = end(end(rows, "s", "src"), "t", "dst")
    return placed.select("src", "dst", "relation_type", F.col("path").alias("source_path"), (F.col("doc_id") * 1000 + F.col("pos")).alias("ord"), F.lit(1.0).alias("weight"))


def dictionary_answers(docs: DataFrame, terms: dict[str, str]) -> DataFrame:
    """The default extractor: known terms that occur in a text are entities, each related to the one before."""
    wanted = sorted(terms)
    found = F.filter(F.array(*map(F.lit, wanted)), lambda w: F.contains(F.lower("text"), F.lower(w)))
    kind = F.create_map(*[F.lit(x) for w in wanted for x in (w, terms[w])])
    none = F.create_map().cast("map<string,string>")
    entities = F.transform(found, lambda w: F.struct(w.alias("name"), kind[w].alias("type"), F.lit("").alias("description"), none.alias("properties")))
    pairs = F.transform(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda w, i: F.struct(F.get(found, i).alias("source"), w.alias("target"), F.lit("related_to").alias("type"), F.lit("").alias("description")))
    return docs.withColumn("answer", F.struct(entities.alias("entities"), pairs.alias("relationships")))


def table_facts(tables: DataFrame) -> DataFrame:
    """table_id, subject (first cell), key (heading), value of every other cell.  tables: table_id, rows array<array<string>> with the heading first."""
    head = F.get("rows", F.lit(0))
    rows = tables.select("table_id", head.alias("h"), F.explode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("r"))
    cells = rows.select("table_id", F.get("r", F.lit(0)).alias("subject"), F.posexplode(F.arrays_zip("h", "r")).alias("i", "c"))
    return cells.where("i > 0 and c.r <> ''").select("table_id", "subject", F.col("c.h").alias("key"), F.col("c.r").alias("value"))


def _images(node) -> Iterator[tuple[str, str]]:
    todo = [node]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            c = x.get("c")
            if x.get("t") == "Image" and isinstance(c, list) and len(c) > 2:
                alt = "".join(" " if p.get("t") == "Space" else str(p.get("c", "")) for p in c[1] if isinstance(p, dict))
                yield (c[2][0] if isinstance(c[2], list) else str(c[2])), alt
            todo[:0] = list(x.values())
        elif isinstance(x, list):
            todo[:0] = x


def document_images(tree: Column) -> Column:
    """array<struct<src, alt>> of the images of a document tree in JSON, in order."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            out = []
            for t in texts:
                try:
                    out.append([{"src": s, "alt": a} for s, a in _images(json.loads(t or "null"))])
                except json.JSONDecodeError:
                    out.append([])
            yield pd.Series(out)

    return F.pandas_udf(run, "array<struct<src: string, alt: string>>")(tree)
