"""The corpus pipeline: raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last give the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import boundary_bpe, feistel_pii, kneser_ney, minhash_containment, trie_join
from quarry.llm.kernel import settle
from quarry.llm.queries import pii_key, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the languages go; a missing label is filled in."""
    known = kneser_ney.identify_languages(docs.select(*COLUMNS)).where(~F.col("lang_rejected"))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts link at a Jaccard similarity of 0.8 of their five-word shingles.  Of every component of texts that link, the document with the smallest id stays (all rows of that id); texts without words stay all, and so do rows without an id."""
    groups = trie_join.ngram_components(docs.select("doc_id", "text"), k=5, percent=80)
    keep = groups.where((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.select(*COLUMNS).join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return minhash_containment.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows."""
    out = feistel_pii.pseudonymise(docs.select(*COLUMNS), key=pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the digests of the tokens and of what they decode to."""
    return boundary_bpe.round_trip_digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonyms),
    ("bpe", tokens),
]

#: Language models, pseudonyms and BPE are beyond SQL: tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
