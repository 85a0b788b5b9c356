"""Audit of how quality filters interact, by incidence matrix products.

A document is reduced to the set of filters it fails, a mask of n bits.  What a
chain of filters does to a corpus depends on nothing else, so every part of the
corpus is three histograms over the 2**n masks: all documents, those labelled
good, those labelled toxic.  The histograms of many parts are stacked as rows
and multiplied by integer matrices with one column for each order of the
filters and each step of it: which masks are kept after the step, removed by
it, removed before although they fail it, fail nothing else.  With five filters
the matrices are 32 by 600.

Spark makes the masks and the histograms (built-in functions; counts combine on
the map side, so a part with a third of the rows is 2**n rows a task); the
products are numpy over Arrow batches of parts.

Whether a text repeats is decided over the whole table: the smallest id of each
text, named by its SHA-256, is found with a map-side minimum, and a document is
compared with it by joining on text and id together, so copies of one text
spread over all tasks.

Defined results: a null text is the empty text, a null part the empty string;
a row without an id repeats nothing and has no labels; rows that repeat under
one id count each, and none is a repeat of the other; of labels that repeat,
one that says good (toxic) is enough; an empty table has no parts and gives no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import settle

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Distinct words and capitals, in hundredths of the words and of the characters.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def text_failures(text: Column) -> list[Column]:
    """The failure conditions A to D of a text: too short, too repetitive, too many capitals, symbols."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n_words < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n_words, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]


def bit_mask(fails: list[Column]) -> Column:
    """Bit k is set where fails[k] holds."""
    total = F.lit(0)
    for k, failed in enumerate(fails):
        total = total + F.when(failed, 1 << k).otherwise(0)
    return total


def failure_masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask, n: how many documents of an id and a part fail which filters; the last bit is a text that a smaller id has as well."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    narrow = rows.select("id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("name"), bit_mask(text_failures(F.col("text"))).alias("mask"))
    narrow = settle(narrow.groupBy("id", "part", "name", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    firsts = narrow.groupBy("name").agg(F.min("id").alias("id")).select("name", "id", F.lit(True).alias("first"))
    joined = narrow.join(firsts, ["name", "id"], "left")
    repeats = F.col("id").isNotNull() & F.col("first").isNull()
    return joined.select("id", "part", (F.col("mask") + F.when(repeats, 1 << len(FILTERS) - 1).otherwise(0)).alias("mask"), "n")


class IncidenceMatrices:
    """For each outcome an integer matrix of masks by (order, step)."""

    def __init__(self, filters: str = FILTERS):
        n = len(filters)
        self.orders = ["".join(p) for p in itertools.permutations(filters)]
        place = np.array([[filters.index(c) for c in order] for order in self.orders])  # the bit of each step
        masks = np.arange(1 << n)[:, None, None]
        earlier = np.cumsum(1 << place, axis=1) - (1 << place)
        own = 1 << place
        fails, before = (masks & own) > 0, (masks & earlier) > 0
        shape = (1 << n, len(self.orders) * n)
        self.kept = ((masks & (earlier | own)) == 0).reshape(shape).astype(np.int64)
        self.removed = (fails & ~before).reshape(shape).astype(np.int64)
        self.redundant = (fails & before).reshape(shape).astype(np.int64)
        self.unique_fails = (fails & (masks == own)).reshape(shape).astype(np.int64)
        self.filter = place.reshape(-1)
        #: Adds up the columns of one filter over all orders, for each column.
        self.same = (self.filter[:, None] == np.arange(n)).astype(np.int64)

    def shapley(self, removed: np.ndarray) -> np.ndarray:
        """For each column, what its filter removed, summed over all orders."""
        return (removed @ self.same)[:, self.filter]


def histograms(masks: DataFrame, labels: DataFrame, id_col: str, quality_col: str, toxic_col: str, n_masks: int) -> DataFrame:
    """part and three arrays over the masks: all documents, good ones, toxic ones."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(quality_col) == 1).alias("good"), F.max(F.col(toxic_col) == 1).alias("toxic"))
    counted = masks.join(marks, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    kinds = ("all", "good", "toxic")
    by_mask = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*kinds)))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(n_masks - 1))
    bars = lambda kind: F.transform(places, lambda mask: F.coalesce(F.try_element_at("m", mask).getField(kind), F.lit(0)))
    return by_mask.select("part", *[bars(kind).alias(kind) for kind in kinds])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, filter_order, step and what the filter at that step of that order does there: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  One row for every part, order and step."""
    rows = histograms(failure_masks(docs, id_col, text_col, part_col), labels, id_col, quality_col, toxic_col, 1 << len(FILTERS))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = IncidenceMatrices()
        n = len(FILTERS)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                parts = batch.slice(at, 64)
                stacked = [np.array(parts[c].to_pylist(), np.int64).reshape(len(parts), 1 << n) for c in ("all", "good", "toxic")]
                h = np.concatenate(stacked)
                whole = h[: len(parts)]
                removed, good_lost, toxic_lost = np.split(h @ by.removed, 3)
                found = [whole @ by.kept, removed, whole @ by.redundant, whole @ by.unique_fails, good_lost, toxic_lost, by.shapley(removed)]
                names = pa.array(np.repeat(np.arange(len(parts)), len(by.filter)))
                orders = pa.array(by.orders).take(pa.array(np.tile(np.repeat(np.arange(len(by.orders)), n), len(parts))))
                steps = pa.array(np.tile(np.arange(1, n + 1), len(by.orders) * len(parts)), pa.int32())
                yield pa.RecordBatch.from_arrays([parts["part"].take(names), orders, steps, *[pa.array(f.reshape(-1)) for f in found]], names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)
