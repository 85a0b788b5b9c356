"""Fuzzy name search: a gram index gives upper bounds in the JVM, only names that may be among the best are compared exactly.

The likeness of two names (0 to 100) rests on longest common subsequences, of
the whole names, of their sorted words and of the best part of the longer one.
A subsequence cannot be longer than the characters that two names share, nor
than a third of the pairs of neighbours that they share and both lengths (each
deletion costs two pairs at most, each insertion one).  ``gram_index`` lists
for every character, pair and word the names that hold it, with their sizes;
a query meets only the postings of its own grams, and sums of shared counts
with the sizes bound every name's likeness.  The best-bounded names are
compared, which gives a threshold that the k best must reach; every name whose
bound reaches it is compared then, and no other, so the result is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import written

#: Names that set the threshold, for each one wanted.
SEEDS = 4
#: Weights of the comparisons (fixed values): by words, by parts, by parts of much longer names; lengths from which parts count.
BY_WORDS, BY_PARTS, BY_SMALL_PARTS, LONGER, MUCH_LONGER = 0.95, 0.9, 0.6, 1.5, 8


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, all of a's positions at once in the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = open_ = (1 << len(a)) - 1
    for c in b:
        met = open_ & places.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    return len(a) - open_.bit_count()


def similarity(a: str, b: str) -> float:
    """0 to 100: 200 times the longest common subsequence over both lengths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def part_similarity(a: str, b: str) -> float:
    """The best likeness of the shorter name and a part of the longer that is as long, or cut off by its beginning or end."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    parts = {long_[max(0, i) : i + n] for i in range(1 - n, len(long_))}
    return max(similarity(short, p) for p in parts)


def weighted_similarity(a: str, b: str) -> float:
    """Of the whole, the words, and (where one is much longer) the best part, each with its weight, the best."""
    if not a or not b:
        return 0.0
    short, long_ = sorted((a, b), key=len)
    sorted_words = lambda s: " ".join(sorted(s))

    def by_words(score) -> float:
        x, y = short.split(), long_.split()
        common = sorted_words(set(x) & set(y))
        one, two = (" ".join(filter(None, (common, sorted_words(set(own) - set(other))))) for own, other in ((x, y), (y, x)))
        return max(score(sorted_words(x), sorted_words(y)), score(common, one), score(common, two), score(one, two))

    whole, ratio = similarity(a, b), len(long_) / len(short)
    if ratio < LONGER:
        return max(whole, BY_WORDS * by_words(similarity))
    scale = BY_PARTS if ratio <= MUCH_LONGER else BY_SMALL_PARTS
    return max(whole, scale * part_similarity(a, b), BY_WORDS * scale * by_words(part_similarity))


_SIZES = ("chars", "n_words", "word_chars", "set_chars")


def gram_index(entities: DataFrame, name: str = "name") -> DataFrame:
    """gram, name, n and the sizes of the name: for each distinct name its characters (c), pairs of neighbours (p), words (w) and whether it has several (s).

    Written out sorted by gram it serves any number of queries.
    """
    names = entities.select(F.col(name).alias("name")).where("name <> ''").distinct()
    words = F.array_remove(F.split("name", r"(?U)\s+"), "")
    sized = names.withColumn("words", words).withColumns({"once": F.array_distinct("words"), "chars": F.length("name"), "n_words": F.size("words")})
    joined = lambda c: F.length(F.array_join(c, " "))
    tagged = lambda tag, items: F.transform(items, lambda g: F.concat(F.lit(tag), g))
    pairs = F.when(F.col("chars") > 1, F.transform(F.sequence(F.lit(1), F.col("chars") - 1), lambda i: F.substring("name", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    several = F.when(F.col("n_words") > 1, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    grams = F.concat(tagged("c", F.split("name", "")), tagged("p", pairs), tagged("w", F.col("once")), several)
    rows = sized.select("name", F.explode(grams).alias("gram"), "chars", "n_words", joined("words").alias("word_chars"), joined("once").alias("set_chars"))
    return rows.groupBy("gram", "name", *_SIZES).agg(F.count(F.lit(1)).alias("n"))


def query_grams(query: str) -> Counter:
    """The grams of a query, as gram_index makes them."""
    words = query.split()
    grams = Counter("c" + c for c in query) + Counter("p" + query[i : i + 2] for i in range(len(query) - 1)) + Counter({"w" + w: 1 for w in words})
    return grams + Counter({"s": 1} if len(words) > 1 else {})


def bounds(index: DataFrame, query: str) -> DataFrame:
    """name, bound: no less than the name's likeness with the query; names without a gram of the query do not appear, their likeness is 0."""
    words = query.split()
    asked = index.sparkSession.createDataFrame([(g, n, g[0] == "c" and not g[1:].isspace()) for g, n in sorted(query_grams(query).items())], "gram string, asked long, ink boolean")
    met = index.join(F.broadcast(asked), "gram")  # no larger than the query
    both = F.least("n", "asked")
    kind = lambda k: F.startswith("gram", F.lit(k))
    told = met.groupBy("name", *_SIZES).agg(F.sum(F.when(kind("c"), both).otherwise(0)).alias("shared"), F.sum(F.when(F.col("ink"), both).otherwise(0)).alias("ink"), F.sum(F.when(kind("p"), both).otherwise(0)).alias("pairs"), F.max(kind("w")).alias("word"))
    size, n_words, word_chars, set_chars = len(query), len(words), len(" ".join(words)), len(" ".join(set(words)))
    shorter, longer = F.least("chars", F.lit(size)), F.greatest("chars", F.lit(size))
    in_words = F.col("ink") + F.greatest(F.least("n_words", F.lit(n_words)) - 1, F.lit(0))
    likeness = lambda length, a, b: 200.0 * F.least(length, a, b) / F.greatest(a + b, F.lit(1))
    by_part = lambda length, short: 200.0 * F.least(length, short) / F.greatest(short + F.least(length, short), F.lit(1))
    lit, col = F.lit, F.col
    whole = likeness(F.least(col("shared"), F.floor((col("pairs") + col("chars") + size + 1) / 3)), col("chars"), lit(size))
    by_words = F.when(col("word"), 100.0).otherwise(F.greatest(likeness(in_words, col("word_chars"), lit(word_chars)), likeness(in_words, col("set_chars"), lit(set_chars))))
    part = by_part(F.least(col("shared"), F.floor((col("pairs") + 2 * shorter + 1) / 3)), shorter)
    part_words = F.when(col("word"), 100.0).otherwise(F.greatest(by_part(in_words, F.least("word_chars", lit(word_chars))), by_part(in_words, F.least("set_chars", lit(set_chars)))))
    scale = F.when(longer <= MUCH_LONGER * shorter, BY_PARTS).otherwise(BY_SMALL_PARTS)
    best = F.when(longer < LONGER * shorter, F.greatest(whole, BY_WORDS * by_words)).otherwise(F.greatest(whole, scale * part, BY_WORDS * scale * part_words))
    return told.select("name", (best + 1e-6).alias("bound"))


def compared(names: DataFrame, query: str) -> DataFrame:
    """names with score: the likeness of name and query."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield frame.map(lambda n: weighted_similarity(query, n or "")).astype("float64")

    return names.withColumn("score", F.pandas_udf(run, "double")(F.col("name")))


def candidates(index: DataFrame, query: str, k: int) -> tuple[DataFrame, float]:
    """(name, score) of every name that may be among those of the k best entities, and the score that these reach at least."""
    held = bounds(index, query)
    seeds = compared(held.orderBy(F.desc("bound"), "name").limit(SEEDS * k), query)
    best = seeds.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = best["least"] if best["n"] == k else 0.0
    # both are tables, else the comparison sinks below the sums of grams, and a join by name infers it for every row of the entities
    near = written(compared(written(held.where(F.col("bound") >= least).select("name"), "names"), query), "near")
    return near.where(F.col("score") >= least), least


def fuzzy_top(entities: DataFrame, query: str, k: int, index: DataFrame | None = None) -> DataFrame:
    """entities with score, the k most like the query, ties by id; index: gram_index of (at least) these entities."""
    near, least = candidates(gram_index(entities) if index is None else index, query, k)
    rows = entities.join(near, "name", "inner" if least > 0 else "left").select(*entities.columns, F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(k)


def fuzzy_search(entities: DataFrame, query: str, entity_type: str | None = None, as_of: str | None = None, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """The entities most like the query, filtered by type and by date; with a date, of the versions of one name the latest in force stays."""
    from quarry.operators.graph import newest_versions

    rows = entities.where(F.col("entity_type") == entity_type) if entity_type else entities
    if not as_of:
        return fuzzy_top(rows, query, limit, index)
    rows = rows.where(F.coalesce(F.col("effective_date") <= as_of, F.lit(True)) | (F.col("effective_date") == ""))
    top = fuzzy_top(rows, query, limit, index)
    return newest_versions(top.withColumn("rank", F.struct(-F.col("score"), "id")), as_of).drop("rank").orderBy(F.desc("score"), "id")


def readable_fuzzy_search(entities: DataFrame, query: str, sources: DataFrame, may_read: Column, limit: int = 20, entity_type: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Three times as many as wanted are fetched, those that may be seen stay, the best of them are given.  sources: id, source_path."""
    from quarry.operators.graphrag import visible

    return visible(fuzzy_search(entities, query, entity_type, None, 3 * limit, index), sources, may_read).orderBy(F.desc("score"), "id").limit(limit)
