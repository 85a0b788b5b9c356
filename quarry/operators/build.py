"""What a graph build needs around extraction: which files count, older versions, images and tables, plans out of replies, removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.documents import history
from quarry.operators.service import ordered_plans
from quarry.sources.readers import HIDDEN_ROOTS

#: Files that hold no knowledge (fixed values).
NO_KNOWLEDGE = ("iam.yaml", "iam.yml", "README.md")
#: Fewer Hangul syllables mean a scan; more letters mean a usable conversion; recognised text is longer than this.
SCAN_BELOW, USABLE_ABOVE, RECOGNISED_ABOVE = 50, 100, 5
TABLE_TEXT, CAPTION, NAME, KEY, MESSAGE = 800, 200, 80, 30, 100


def graph_files(files: DataFrame) -> DataFrame:
    """Files outside the hidden folders, wherever these are in the path, and not those without knowledge.  files: path below the root."""
    steps = F.split(F.ltrim("path", F.lit("/")), "/")
    return files.where(~F.exists(steps, lambda s: s.isin(*HIDDEN_ROOTS)) & ~F.element_at(steps, -1).isin(*NO_KNOWLEDGE))


def build_files(files: DataFrame, below: str = "") -> DataFrame:
    """Files whose names do not start with a dot, of one folder if given."""
    kept = files.where(~F.startswith(tx.base_name(F.col("path")), F.lit(".")))
    return kept.where(F.startswith("path", F.lit(below.rstrip("/") + "/"))) if below else kept


def conversion_quality(text: Column) -> dict[str, Column]:
    """scanned (too little Hangul, so that characters have to be recognised), usable (letters enough to keep), recognised (what recognition found, empty if too short); no text is a scan."""
    found = tx.letters(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return {
        "scanned": found["hangul"] < SCAN_BELOW,
        "usable": found["hangul"] + found["latin"] > USABLE_ABOVE,
        "recognised": F.when(F.length(plain) > RECOGNISED_ABOVE, plain).otherwise(""),
    }


def image_result(table: Column, text: Column, caption: Column) -> Column:
    """kind and content of an image: its table, else its text, else its caption."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    kind = F.when(has(table), "table").when(has(text), "text").otherwise("diagram")
    content = F.when(has(table), table).when(has(text), text).otherwise(F.coalesce(caption, F.lit("")))
    return F.struct(kind.alias("kind"), content.alias("content"))


def asset_graph(images: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of images: tables with their facts, other images by their captions, each belonging to the folder's document.

    images: path, kind, caption, table_md (one row for each path); facts: path, key, value, context.  A table without its Markdown is an image;
    facts of what is no table are left out; rows without a path give nothing.
    """
    path = F.col("path")
    parent = F.coalesce(F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2), F.lit(""))
    table = F.coalesce((F.col("kind") == "table") & (F.col("table_md") != ""), F.lit(False))
    name = F.coalesce(F.nullif(F.col("caption"), F.lit("")), tx.stem(path))
    seen = images.where(path.isNotNull()).withColumns({"parent": parent, "is_table": table, "id": F.concat(F.when(table, "tbl_").otherwise("img_"), tx.stem(path))})
    source = F.concat(F.lit("/assets/"), "parent", F.lit("/"), tx.base_name(path)).alias("source_path")
    title = F.when(F.col("is_table"), F.concat(F.lit("표: "), F.coalesce(F.nullif("parent", F.lit("")), tx.stem(path)))).otherwise(F.left(name, F.lit(NAME)))
    shown = F.when(F.col("is_table"), F.map_from_arrays(F.array(F.lit("image_path"), F.lit("raw_markdown"), F.lit("parent_document")), F.array(path, F.left("table_md", F.lit(TABLE_TEXT)), F.col("parent"))))
    shown = shown.otherwise(F.map_from_arrays(F.array(F.lit("image_path"), F.lit("caption"), F.lit("parent_document")), F.array(path, F.left(name, F.lit(CAPTION)), F.col("parent"))))
    own = seen.select("id", title.alias("name"), F.when(F.col("is_table"), "table").otherwise("image").alias("entity_type"), shown.alias("properties"), source)

    fact = facts.where(F.col("key").isNotNull()).join(seen.where("is_table").select("path", "parent", F.col("id").alias("table_id")), "path")
    fact_id = F.concat(F.lit("fact_"), tx.stem(path), F.lit("_"), F.replace(F.left("key", F.lit(KEY)), F.lit(" "), F.lit("_")))
    fact = fact.withColumn("id", fact_id).groupBy("id", "table_id", "path", "parent").agg(F.min(F.struct("key", "value", "context")).alias("f"))
    about = F.map_from_arrays(
        F.array(*map(F.lit, ("value", "context", "parent_table", "parent_document"))),
        F.array(F.col("f.value"), F.coalesce("f.context", F.lit("")), F.col("table_id"), F.col("parent")),
    )
    nodes = own.unionByName(fact.select("id", F.col("f.key").alias("name"), F.lit("fact").alias("entity_type"), about.alias("properties"), source))
    holds = fact.select(F.col("table_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation_type"), path.alias("source_path"))
    belongs = seen.where("parent <> ''").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("belongs_to").alias("relation_type"), path.alias("source_path"))
    return nodes, holds.unionByName(belongs)


def historical_entities(extracted: DataFrame, versions: DataFrame, most: int = 10) -> DataFrame:
    """Entities found in older versions of documents, with the version in their properties and in their source.

    extracted: path, commit_hash, id, name, properties map<string,string>; versions: path, commit_hash, ts, day, message.  The current version does not count.
    """
    short = F.left("commit_hash", F.lit(8))
    version = F.map_from_arrays(
        F.array(*map(F.lit, ("version_hash", "version_date", "version_label", "is_historical", "version_message"))),
        F.array(short, F.col("day"), F.concat("day", F.lit(" ("), short, F.lit(")")), F.lit("true"), F.left(F.trim(F.coalesce("message", F.lit(""))), F.lit(MESSAGE))),
    )
    old = history(versions, most=most).select("path", "commit_hash", version.alias("_version"))
    kept = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("_version"), k))
    return extracted.join(old, ["path", "commit_hash"]).select("id", "name", F.map_concat(kept, "_version").alias("properties"), F.concat("path", F.lit("@"), short).alias("source_path"))


def plans_from_replies(replies: DataFrame, registry: DataFrame) -> DataFrame:
    """run, step, skill, method, endpoint of the plans that replies ask for, in the order of their needs.

    replies: run, reply (JSON with a list `skills` of objects with a name; anything else is an empty plan); registry: skill, depends_on, method, endpoint,
    whose needs are those that count.  A skill asked for twice is one step, at its first place.
    """
    asked = F.from_json("reply", "struct<skills: array<struct<name: string>>>")["skills"]
    items = replies.select("run", F.posexplode(asked).alias("pos", "asked")).groupBy("run", F.col("asked.name").alias("skill")).agg(F.min("pos").alias("pos"))
    needs = registry.select("skill", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    return ordered_plans(items.join(needs, "skill"), registry)


def without_chunks(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without the chunks of some documents.  index, paths: source_path."""
    return index.join(paths.select("source_path").distinct(), "source_path", "left_anti")


def removal_counts(index: DataFrame, paths: DataFrame) -> DataFrame:
    """source_path, n_removed: how many chunks each of the documents loses, 0 where it has none."""
    counts = index.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_removed"))
    return paths.select("source_path").distinct().join(counts, "source_path", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))


def newest_tasks(tasks: DataFrame, most: int = 20) -> DataFrame:
    """The tasks made last (their number is the feature).  tasks: task_id, created_at."""
    return tasks.orderBy(F.desc("created_at"), F.desc("task_id")).limit(most)


def thread_history(checkpoints: DataFrame, thread: str) -> DataFrame:
    """A thread's checkpoints, the oldest first, with the roles of their messages (`unknown` where there is none).  checkpoints: thread_id, checkpoint_id, messages array<struct<role, content>>."""
    role = lambda m: F.struct(F.coalesce(m["role"], F.lit("unknown")).alias("role"), m["content"].alias("content"))
    return checkpoints.where(F.col("thread_id") == thread).select("checkpoint_id", F.transform("messages", role).alias("messages")).orderBy("checkpoint_id")
