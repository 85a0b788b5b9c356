"""The thin queries over the operators, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boundary_bpe, chat_snapshots, feistel_pii, filter_audit, kmeans_tree, kneser_ney, license_join, minhash_containment, pigeonring_simhash, random_index_quality, source_divergence, trie_join, url_rules


def tokenizer_path() -> str:
    """The default tokenizer file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The key of the registered query and of the corpus pipeline where the session names none.  It is public: pseudonyms made with it can be undone by anybody.
EVALUATION_KEY = "quarry-evaluation-key"


def pii_key(spark: SparkSession) -> str:
    """The session's key for pseudonyms, or the public one for evaluation, with a warning."""
    key = spark.conf.get("spark.quarry.pii.key", None)
    if not key:
        warnings.warn("spark.quarry.pii.key is not set: pseudonyms are made with a public key and can be undone", stacklevel=2)
    return key or EVALUATION_KEY


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_snapshots.collapse_snapshots(_table(spark, sf_dir, "conversations"))


def op2_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return kmeans_tree.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole text with pseudonyms, how many of each kind."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = feistel_pii.pseudonymise(docs, key=pii_key(spark), found_col="found")
    count = lambda name: F.size(F.filter("found", lambda k: k == name)).cast("long").alias(f"n_{name}")
    return out.select("doc_id", "text", *map(count, feistel_pii.KINDS))


def op4_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's tokens and of what they decode to."""
    return boundary_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = kneser_ney.identify_languages(docs)
    return out.select("doc_id", kneser_ney.held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op6_trie_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 85 in a hundred 4-word shingles."""
    return trie_join.ngram_components(_table(spark, sf_dir, "documents"))


def op7_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text."""
    out = random_index_quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", random_index_quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the licence phrases in every whole text, and the labels of the templates that its lines meet."""
    out = license_join.scan_licenses(_table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    by_block = F.transform("blocks", lambda b: b["label"])
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("blocks", lambda b: b["containment"]), F.transform("places", lambda _: F.lit(1.0))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        joined(F.col("place_labels")).alias("base_labels"),
        joined(F.concat("place_labels", by_block)).alias("labels"),
        best.alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the exact containment."""
    return minhash_containment.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; a URL is labelled bad if its page's text is of low quality or toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", "bad")
    return url_rules.judge_urls(pages, labelled).drop("url")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do to every language in all 120 orders."""
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every whole text and its component under links of two bits."""
    return pigeonring_simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of every language, and the terms that tell them apart."""
    return source_divergence.audit_sources(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in own}


_CHAT_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
         list(length(role) || chr(31) || role || chr(31) || text || chr(30) ORDER BY turn NULLS FIRST, role, text) AS parts,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM turns GROUP BY conv_id),
prefixes AS (
  SELECT DISTINCT array_to_string(parts[1:k], '') AS prefix
  FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM chats)),
keepers AS (
  SELECT array_to_string(parts, '') AS whole, min(conv_id) AS conv_id, count(*) AS n_copies FROM chats GROUP BY 1)
SELECT k.conv_id, c.n_turns, k.n_copies, c.rendered
FROM keepers k JOIN chats c ON c.conv_id = k.conv_id
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.prefix = k.whole)
"""

_LEAK_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.side = 'd' AND i.side = 'i' AND d.s = i.s GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON sizes.id = shared.item_id WHERE n_shared * 5 >= n_item * 4
"""


_AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_where(['A', 'B', 'C', 'D', 'E'], [
           len(w) < 200,
           100 * len(list_distinct(w)) < 50 * len(w),
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
           regexp_matches(t, '[#$%&*|]'),
           repeats]) AS f
  FROM (SELECT *, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS repeats FROM texts) t
  LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = t.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letters a, letters b, letters d, letters e, letters g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
steps AS (SELECT o, k AS step, o[k:k] AS own, string_split(o[1:k - 1], '') AS earlier FROM orders, range(1, 6) r(k)),
grouped AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM fails GROUP BY 1, 2),
told AS (
  SELECT part, o AS filter_order, step, own,
         coalesce(sum(n) FILTER (NOT list_has_any(f, earlier) AND NOT list_contains(f, own)), 0) AS kept,
         coalesce(sum(n) FILTER (NOT list_has_any(f, earlier) AND list_contains(f, own)), 0) AS removed,
         coalesce(sum(n) FILTER (list_has_any(f, earlier) AND list_contains(f, own)), 0) AS redundant,
         coalesce(sum(n) FILTER (f = [own]), 0) AS unique_fails,
         coalesce(sum(g) FILTER (NOT list_has_any(f, earlier) AND list_contains(f, own)), 0) AS good_lost,
         coalesce(sum(x) FILTER (NOT list_has_any(f, earlier) AND list_contains(f, own)), 0) AS toxic_lost
  FROM grouped, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""


_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY 1, 2 HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (
  SELECT g.lang, g.source, coalesce(max(v.v), 0) AS v, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN v ON v.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS BIGINT) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (
  SELECT lang, term, 1 + CAST(1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM counts GROUP BY 1, 2),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT s.lang, s.source, s.term AS item, (s.p - l.q) * (s.p - l.q) // (s.p + l.q) AS value
  FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND s.p > l.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_snapshots": _CHAT_SQL, "op9_minhash_containment": _LEAK_SQL, "op11_filter_audit": _AUDIT_SQL, "op13_source_divergence": _DIVERGENCE_SQL}
