"""Source divergence audit: how differently the sources of a language use its terms.

Every (language, source) group gives each kept term of its language a share in
billionths, p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), and two groups
differ in a term by f(p, q) = floor((p - q)**2 / (p + q)).  The distance of two
groups is the sum of f over all V kept terms, most of which neither group has.
It is taken apart by inclusion and exclusion over the supports A and B (terms
with a count):

    sum over A of f(p, q0)  +  sum over B of f(p0, q)      one-sided
    + (V - |A| - |B|) * f(p0, q0)                          neither
    + sum over A and B of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

with p0 and q0 the shares of a term that the group lacks.  The one-sided sums
are priced by each group's histogram of counts, not term by term; only terms
that both groups have are met, in a join of sparse postings.

Words are cut and counted in Arrow batches (dictionary-encoded, so exact), then
every count is a sum combined on the map side; the pricing is SQL in decimals
and longs, so all is exact.  No group of rows is larger than the sources of one
term.

Defined results: null text, language and source are empty strings; a row is a
document, so rows that repeat count as often as they stand there, ids are not
looked at; a group without terms has N = 0 and is compared all the same; a
language with no kept term has distances 0 and no terms; a language with one
source has no pairs; an empty table gives no rows; other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import LOWER, _segments, lean, settle, string_buffers

#: Bytes of terms: A-Z, a-z and every byte beyond ASCII.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LEAST_DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Bytes of text that are counted at once; longer texts are walked in segments.
CHUNK = 4 << 20
#: Parts in which the histograms of a language are priced.
SPREAD = 32


def term_array(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts as one Arrow array of bytes, and the text each stands in."""
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    inner = LETTERS[raw]
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    starts[cuts] = inner[cuts]
    first = np.flatnonzero(starts)
    letters_before = np.concatenate([[0], np.cumsum(inner)]).astype(np.int64)
    ends = letters_before[np.append(first, len(raw))]
    data = LOWER[raw[inner]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return terms, np.searchsorted(offs, first, "right") - 1


def count_long(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(term, occurrences) of one long text, segment by segment."""
    found = []
    for a, b in _segments(raw, offs, LETTERS):
        coded = pc.dictionary_encode(term_array(raw[a:b], np.array([0, b - a]))[0])
        found.append((coded.dictionary, np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))))
    coded = pc.dictionary_encode(pa.concat_arrays([terms for terms, _ in found]))
    n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate([n for _, n in found]), len(coded.dictionary))
    return coded.dictionary, n.astype(np.int64)


def count_terms(groups: np.ndarray, column: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences in the group, texts that hold it), groups as codes of the texts."""
    raw, offs = string_buffers(column)
    if len(column) == 1 and len(raw) > chunk:
        terms, n = count_long(raw, offs)
        return np.repeat(groups[:1], len(terms)), terms, n, np.ones(len(terms), np.int64)
    terms, text = term_array(raw, offs)
    if not len(terms):
        return np.zeros(0, np.int64), terms, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pc.dictionary_encode(terms)
    size = len(coded.dictionary)
    in_text, often = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    own = groups[in_text // size] * size + in_text % size
    keys, place, texts = np.unique(own, return_inverse=True, return_counts=True)
    return keys // size, coded.dictionary.take(pa.array(keys % size)), np.bincount(place, often, len(keys)).astype(np.int64), texts


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch a few MB of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a null term counts the group's documents, so that no group is lost."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _chunks(whole)):
            pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"]).to_pylist()
            codes: dict = {}
            group = np.array([codes.setdefault((p["lang"], p["source"]), len(codes)) for p in pairs], np.int64)
            own, terms, n, texts = count_terms(group, batch.column(2))
            own = np.concatenate([np.arange(len(codes)), own])
            names = list(codes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in names], pa.string()).take(pa.array(own)),
                    pa.array([p[1] for p in names], pa.string()).take(pa.array(own)),
                    pa.concat_arrays([pa.nulls(len(codes), pa.string()), terms.cast(pa.binary()).cast(pa.string())]),
                    pa.array(np.concatenate([np.zeros(len(codes), np.int64), n])),
                    pa.array(np.concatenate([np.bincount(group, minlength=len(codes)), texts]).astype(np.int64)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    partial = rows.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), in decimals as the product may be beyond a long; null where nothing is kept."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + CAST((CAST({SCALE} AS DECIMAL(12, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) DIV CAST({total} + 2 * {kept} AS DECIMAL(20, 0)) AS BIGINT) END")


def difference(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q)) as SQL text; the square of a difference of shares fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q})))"


class Shares:
    """The settled tables of the audit: groups (lang, source, n_group, v, p0, support) and postings (lang, source, term, n, p)."""

    def __init__(self, counts: DataFrame, least: int = LEAST_DOCUMENTS):
        counts = settle(counts, "terms")
        words = counts.where("term is not null")
        self.lexicon = settle(words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least).select("lang", "term", "n_lang"), "lexicon")
        kept = words.join(self.lexicon.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
        kept = settle(kept, "kept")
        langs = self.lexicon.groupBy("lang").agg(F.sum("n_lang").alias("total"), F.count(F.lit(1)).alias("v"))
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("support"))
        found = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "support", "v", "total"])
        self.groups = settle(found.withColumn("p0", share("0", "n_group", "v")), "groups")
        self.postings = settle(kept.join(self.groups, ["lang", "source"]).withColumn("p", share("n", "n_group", "v")).select("lang", "source", "term", "n", "p", "p0", "total", "v"), "postings")

    def pairs(self) -> DataFrame:
        """lang, a, b (a < b), value: the sum of the differences of two groups of a language over all kept terms."""
        groups = self.groups.select("lang", "source", "v", "support", F.coalesce("p0", F.lit(1)).alias("p0"))
        other = groups.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "p0")])
        # one-sided terms: a bar of one group's histogram against every other group's share of a missing term
        bars = self.postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("bar"))
        spread = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        priced = bars.withColumn("part", F.pmod(F.xxhash64("source", "p"), F.lit(SPREAD)).cast("int")).join(spread, ["lang", "part"]).where("source != o_source")
        one_sided = priced.select("lang", F.least("source", "o_source").alias("a"), F.greatest("source", "o_source").alias("b"), F.expr(f"bar * {difference('p', 'o_p0')}").alias("value"))
        # terms that neither has, as if the supports were apart
        x, y = (groups.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in ("source", "v", "support", "p0")]) for s in ("x", "y"))
        neither = x.join(y, "lang").where("x_source < y_source").select("lang", F.col("x_source").alias("a"), F.col("y_source").alias("b"), F.expr(f"(x_v - x_support - y_support) * {difference('x_p0', 'y_p0')}").alias("value"))
        # what that counts wrongly for the terms that both have
        i, j = (self.postings.select("lang", "term", *[F.col(c).alias(f"{s}_{c}") for c in ("source", "p", "p0")]) for s in ("i", "j"))
        right = f"{difference('i_p', 'j_p')} - {difference('i_p', 'j_p0')} - {difference('i_p0', 'j_p')} + {difference('i_p0', 'j_p0')}"
        overlap = i.join(j, ["lang", "term"]).where("i_source < j_source").select("lang", F.col("i_source").alias("a"), F.col("j_source").alias("b"), F.expr(right).alias("value"))
        parts = [d.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for d in (one_sided, neither, overlap)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: the terms that a group uses more than its language does, those that differ most."""
        lang = self.lexicon.select("lang", "term", "n_lang")
        told = self.postings.join(lang, ["lang", "term"]).withColumn("q", share("n_lang", "total", "v")).where("p > q")
        told = told.select("lang", "source", F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
        return told.withColumn("rank", F.row_number().over(_best())).where(F.col("rank") <= top)


def _best():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to every other source of its language (part pair), and its most telling terms (part term)."""
    shares = Shares(term_counts(docs, text_col, lang_col, source_col), least)
    half = settle(shares.pairs(), "pairs")
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = both.withColumn("rank", F.row_number().over(_best()))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return columns(ranked, "pair").unionByName(columns(shares.terms(top), "term"))
