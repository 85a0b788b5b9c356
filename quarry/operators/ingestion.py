"""From files to stored documents: a chain of converters with fallbacks, normalisation, grading, policy, errors as rows.

A converter is a function from files to the same rows with text and error.  The
chain is ordered: every step sees only the rows that the steps before left
without a usable text, so dear steps (character recognition) get few rows.
What a step gives is written once, and its errors stay with the file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import security as sec
from quarry.functions.text import stem
from quarry.operators.build import conversion_quality
from quarry.operators.chunks import post_processed, without_front_matter
from quarry.sources.tables import written

Converter = Callable[[DataFrame], DataFrame]
#: Endings that are taken (fixed values).
ENDINGS = ("docx", "pptx", "pdf", "md", "hwp", "hwpx")
_ERRORS = "array<struct<step:string,error:string>>"


def not_blank(text: Column) -> Column:
    """Whether a text has anything but blanks."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def enough_letters(text: Column) -> Column:
    """Whether a text has letters enough to be kept."""
    return F.coalesce(conversion_quality(text)["usable"], F.lit(False))


def called(call: Callable[[bytes, str], str], data: str = "content") -> Converter:
    """A converter that calls call(bytes, path) for each file; what it raises is the file's error."""

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, paths in frames:
            found = []
            for content, path in zip(contents, paths):
                try:
                    found.append((call(bytes(content or b""), path), None))
                except Exception as e:  # noqa: BLE001  every failure is a row
                    found.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"text": pd.Series([t for t, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    def convert(files: DataFrame) -> DataFrame:
        told = files.withColumn("_c", F.pandas_udf(run, "text string, error string")(F.col(data).cast("binary"), "path"))
        return told.withColumns({"text": F.col("_c.text"), "error": F.col("_c.error")}).drop("_c")

    return convert


def converted(files: DataFrame, steps: list[tuple[str, Converter, Callable[[Column], Column]]]) -> DataFrame:
    """files with text, step (the first that gave a usable text; both null if none did) and errors (of the steps before, in order).

    steps: name, converter, and when its text is usable.  A step that gives neither an error nor a usable text leaves the error "not usable".
    """
    columns = files.columns
    left = files.withColumn("errors", F.array().cast(_ERRORS))
    done = None
    for name, convert, usable in steps:
        out = written(convert(left), "converted")
        good = F.col("error").isNull() & usable(F.col("text"))
        kept = out.where(good).select(*columns, "text", F.lit(name).alias("step"), "errors")
        done = kept if done is None else done.unionByName(kept)
        told = F.struct(F.lit(name).alias("step"), F.coalesce("error", F.lit("not usable")).alias("error"))
        left = out.where(~good).select(*columns, F.concat("errors", F.array(told)).alias("errors"))
    rest = left.select(*columns, F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("step"), "errors")
    return rest if done is None else done.unionByName(rest)


def step_counts(rows: DataFrame) -> DataFrame:
    """step, n: how many files each step converted; null for those that none could."""
    return rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def ending(path: Column) -> Column:
    """The ending of a path in small letters, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def titled(text: Column, path: Column) -> Column:
    """A converted text below a heading of the file's name."""
    return F.concat(F.lit("# "), stem(path), F.lit("\n\n"), text)


def ingested(rows: DataFrame, user: Column) -> DataFrame:
    """path (where it is stored), text, meta, error of converted files: normalised, graded, with the policy of the grade; errors are rows without a text.

    rows: path, text, step, errors.
    """
    known = ending(F.col("path")).isin(*ENDINGS)
    clean = rows.withColumn("body", F.when(known & F.col("text").isNotNull(), post_processed(without_front_matter(F.col("text")))))
    graded = clean.withColumn("g", F.struct(*[c.alias(k) for k, c in sec.classified(F.col("body"), F.col("path")).items()]))
    policy = sec.grade_policy(F.col("g.grade"))
    meta = {
        "owner": user, "source_format": F.concat(F.lit("."), ending(F.col("path"))), "converted_by": F.col("step"), "security_grade": F.col("g.grade").cast("string"),
        "security_reason": F.array_join("g.detected", ","), **{k: policy[k].cast("string") for k in ("learning_allowed", "rag_allowed")},
    }
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(c, F.lit("")).alias("v")) for k, c in meta.items()]))
    error = F.when(~known, F.concat(F.lit("unsupported format "), ending(F.col("path")))).when(F.col("text").isNull(), F.concat_ws("; ", F.transform("errors", lambda e: F.concat(e["step"], F.lit(": "), e["error"]))))
    stored = F.concat(F.lit("Shared/"), stem(F.col("path")), F.lit(".md"))
    return graded.select(F.when(error.isNull(), stored).otherwise(F.col("path")).alias("path"), F.when(error.isNull(), F.col("body")).alias("text"), F.when(error.isNull(), pairs).alias("meta"), error.alias("error"))


def ingest_files(files: DataFrame, steps: list[tuple[str, Converter, Callable[[Column], Column]]], user: str, folder: str) -> DataFrame:
    """Converts, grades and appends documents below folder (a Parquet table for each grade); gives path and error of every file."""
    out = written(ingested(converted(files, steps), F.lit(user)), "ingested")
    good = out.where("error is null").withColumn("grade", F.col("meta")["security_grade"].cast("int"))
    good.select("path", "text", "meta", "grade").write.mode("append").partitionBy("grade").parquet(folder)
    return out.select("path", "error")
