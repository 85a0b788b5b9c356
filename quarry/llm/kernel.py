"""Vectorised text kernels that work on the raw buffers of an Arrow string column.

Words, their 64-bit hashes and word shingles of a whole batch are found with a
handful of numpy passes over the UTF-8 bytes; no Python string is ever made.
Texts longer than ``SEGMENT`` bytes are walked in segments that end between
words, so memory stays bounded by the segment and the words, not by 8-byte
temporaries for the whole text.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SEGMENT = 1 << 20
#: Bytes of settled tables for each file of a table made of them.
PART_BYTES = 4 << 20
#: Bytes of words parted by blanks: everything but 0x20 and 0x09-0x0D.
BLANK_PARTED = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
#: Bytes of alphanumeric words: 0-9, A-Z, a-z and every byte beyond ASCII.
ALPHANUMERIC = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Every byte as it is.
SAME = np.arange(256, dtype=np.uint8)

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 32


def _byte_names(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit name of a byte at a place of its word."""
    return mix(mix(place.astype(np.uint64) * np.uint64(256) + byte + np.uint64(0x9E3779B97F4A7C15)))


#: The names of all bytes at the first places of a word.
_TABLE = _byte_names(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256, dtype=np.uint64), _PLACES))


def span_hashes(part: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the bytes first:last for each pair (in order, apart): the sum of the names of its bytes at their places, mixed."""
    if not len(first):
        return np.zeros(0, np.uint64)
    begin = int(first[0])
    part = part[begin:]
    place = np.arange(len(part), dtype=np.int32) - np.repeat((first - begin).astype(np.int32), np.diff(np.append(first - begin, len(part))))
    names = _TABLE[(np.minimum(place, _PLACES - 1) << 8) + part]
    late = np.flatnonzero(place >= _PLACES)
    if len(late):
        names[late] = _byte_names(place[late], part[late])
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(names, out=total[1:])
    return mix(total[last - begin] - total[first - begin] + (last - first).astype(np.uint64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _segments(raw: np.ndarray, offs: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SEGMENT bytes that never end inside a word."""
    at, end = 0, int(offs[-1])
    while at < end:
        stop = min(at + SEGMENT, end)
        if stop < end:
            text_end = int(offs[np.searchsorted(offs, stop, "right") - 1])
            if text_end > at:
                stop = text_end
            else:
                gap = np.flatnonzero(~word[raw[at:stop]])
                if len(gap):
                    stop = at + int(gap[-1]) + 1
                else:
                    while stop < end and word[raw[stop]] and stop not in offs:
                        stop += 1
        yield at, stop
        at = stop


def word_hashes(raw: np.ndarray, offs: np.ndarray, word: np.ndarray = BLANK_PARTED, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, byte where it starts, for each text the index of its first word; one more at the end)."""
    hashes, begins = [], []
    inner = offs[1:-1]
    for a, b in _segments(raw, offs, word):
        part = raw[a:b]
        is_word = word[part]
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:]
        cuts = inner[np.searchsorted(inner, a, "right") : np.searchsorted(inner, b, "left")] - a
        if len(cuts):
            starts[cuts] = is_word[cuts]
            ends[cuts - 1] = is_word[cuts - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        hashes.append(span_hashes(fold[part], first, last))
        begins.append(first + a)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return found, where, np.searchsorted(where, offs, "left")


_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, for each text the index of its first shingle; one more at the end).

    A text of fewer than k words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * _WEIGHTS[j]
        keep = np.zeros(len(words) + 1, np.int32)
        long_texts = counts >= k
        np.add.at(keep, bounds[:-1][long_texts], 1)
        np.add.at(keep, bounds[1:][long_texts] - k + 1, -1)
        kept = rolled[np.cumsum(keep[: len(rolled)]) > 0]
        slots = np.repeat(long_texts, n)
        out[slots] = mix(kept)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[bounds[i] : bounds[i + 1]]
        with np.errstate(over="ignore"):
            out[out_bounds[i]] = mix(np.array([(own * _WEIGHTS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, out_bounds


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives free memory back to the system when its task ends: a Python worker lives on through all stages of a pipeline."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors see; where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "quarry-checkpoints")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, of: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df to a table in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing.

    The table stays until discard(); what a result still reads goes with the folder, which belongs to the application.

    of: settled tables whose bytes say how large df is, about.  Its last stage then has as many tasks as these bytes need, but
    two for each core, if it had more: a small table is not written as a file for each shuffle partition.  Where the folder is a
    local file system, an executor starts three processes (chmod) for each file, and each counts as much memory as the executor
    until it runs.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if of := list(of):
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-sum(map(settled_bytes, of)) // PART_BYTES)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _settled_in(df: DataFrame) -> tuple:
    """(file system, path) of a settled table."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._settled_at)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def settled_bytes(df: DataFrame) -> int:
    files, path = _settled_in(df)
    return files.getContentSummary(path).getLength()


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        files, path = _settled_in(df)
        files.delete(path, True)
