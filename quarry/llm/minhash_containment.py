"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents may be long, so resemblance of whole sets says
nothing; what counts is containment, the share of an item's word shingles that
a document holds.  Items are partitioned by the size of their shingle sets.  In
a partition whose largest set has n shingles, every item's sketch is its
bottom-m MinHash, m = n - ceil(threshold * n) + 1: a document that contains at
least the threshold's share of an item misses fewer than m of its shingles and
so holds one of the m smallest.  A document is a candidate where one of its
shingles is in a sketch; candidates are verified by exact containment.

The items are the queries: they are taken in blocks of at most ``BLOCK`` items and
``BLOCK_BYTES`` of text, but one item at least (what is broadcast), each block
against all documents, however many there are.

Shingles are of five words (0-9, a-z after folding A-Z, and characters beyond
ASCII); an item of fewer words is one shingle, and is found in documents of
exactly these words.  Defined results: null and empty texts and items hold
nothing and match nothing; repeated rows on either side are kept as they come,
and so are null ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALPHANUMERIC, LOWER, lean, shingle_hashes, string_buffers, word_hashes

WORDS = 5
THRESHOLD = 0.8
BLOCK = 20_000
BLOCK_BYTES = 16 << 20
#: Largest size of each partition: the next is half as large again.
GROWTH = 1.5
_FILTER_BITS = 22


def shingle_sets(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = string_buffers(column)
    words, _, bounds = word_hashes(raw, offs, ALPHANUMERIC, LOWER)
    return shingle_hashes(words, bounds, k)


def partition_of(size: int) -> int:
    """The size partition of a set: partition p holds the sizes up to GROWTH**p."""
    return max(0, math.ceil(math.log(size) / math.log(GROWTH) - 1e-9)) if size else 0


class ItemSketches:
    """Sketches and shingle sets of one block of items."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD):
        shingles, bounds = shingle_sets(pa.array(texts, pa.large_string()))
        self.ids, self.threshold = [], threshold
        self.sets: list[np.ndarray] = []
        entries: list[tuple[int, int]] = []
        for i, item in enumerate(ids):
            own = np.unique(shingles[bounds[i] : bounds[i + 1]])
            if not len(own):
                continue
            most = max(len(own), math.floor(GROWTH ** partition_of(len(own))))
            m = min(len(own), most - math.ceil(threshold * most - 1e-9) + 1)
            entries += [(int(h), len(self.ids)) for h in own[:m]]
            self.ids.append(item)
            self.sets.append(own)
        entries.sort()
        self.keys = np.array([h for h, _ in entries], np.uint64)
        self.items = np.array([i for _, i in entries], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def search(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shingles shared) of every document and item that meet the threshold."""
        shingles, bounds = shingle_sets(column)
        out: list[tuple[int, int, int]] = []
        maybe = np.flatnonzero(self.filter[shingles >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe) or not len(self.keys):
            return out
        own = shingles[maybe]
        lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        hit = np.flatnonzero(hi > lo)
        rows = np.searchsorted(bounds, maybe[hit], "right") - 1
        pairs: dict[int, set[int]] = {}
        for r, a, b in zip(rows.tolist(), lo[hit].tolist(), hi[hit].tolist()):
            pairs.setdefault(r, set()).update(self.items[a:b].tolist())
        for r, items in pairs.items():
            doc = np.unique(shingles[bounds[r] : bounds[r + 1]])
            for i in sorted(items):
                item = self.sets[i]
                at = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
                shared = int((doc[at] == item).sum())
                if shared >= math.ceil(self.threshold * len(item) - 1e-9):
                    out.append((r, i, shared))
        return out


def item_blocks(items: DataFrame, item_id: str, item_text: str, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded rows and bytes, one after the other on the driver; an item beyond the bytes is a block of its own."""
    ids: list = []
    texts: list = []
    size = 0
    for item, text in items.select(F.col(item_id), F.col(item_text)).toLocalIterator():
        own = len(text.encode()) if text else 0
        if ids and (len(ids) == block or size + own > block_bytes):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += own
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every document that holds the threshold's share of an item's shingles."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    doc_kind, item_kind = picked.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"doc_id {doc_kind}, item_id {item_kind.simpleString()}, n_shared long, n_item long, containment double"
    found = None
    for ids, texts in item_blocks(items, item_id, item_text, block):
        sketches = spark.sparkContext.broadcast(ItemSketches(ids, texts, threshold))

        def run(batches: Iterator[pa.RecordBatch], sketches=sketches) -> Iterator[pa.RecordBatch]:
            own = sketches.value
            for batch in batches:
                hits = own.search(batch.column(1))
                rows = pa.array([r for r, _, _ in hits], pa.int64())
                sizes = [len(own.sets[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([own.ids[i] for _, i, _ in hits]).cast(_arrow(item_kind)), pa.array([s for *_, s in hits], pa.int64()), pa.array(sizes, pa.int64()), pa.array([s / n for (*_, s), n in zip(hits, sizes)], pa.float64())],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        part = picked.mapInArrow(lean(run), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The documents that hold none of the items, all columns; every row is decided where it is read, so its id may be null or repeated."""
    at = docs.columns.index(text_col)
    out = docs
    for ids, texts in item_blocks(items, item_id, item_text, block):
        sketches = docs.sparkSession.sparkContext.broadcast(ItemSketches(ids, texts, threshold))

        def run(batches: Iterator[pa.RecordBatch], sketches=sketches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in sketches.value.search(batch.column(at).cast(pa.string()))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
