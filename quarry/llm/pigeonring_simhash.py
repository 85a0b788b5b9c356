"""SimHash near duplicates with pigeonring filtering.

A fingerprint has 64 bits; bit k is set where more than half of the XXH64
hashes of a text's shingles have it set.  Two fingerprints link where they
differ in at most ``DISTANCE`` bits.

The 64 bits are cut into ``SEGMENTS`` segments that stand in a ring.  If the
differences of two fingerprints add up to at most d, there is a segment from
which on every chain of l consecutive segments differs in at most l*d/SEGMENTS
bits (were it not so, the chains that break their budget would together go
round the ring with more than d).  With 5 segments and d = 2 the budgets are 0,
0, 1, 1, 2, so linked fingerprints meet, for one of the five starts, in a block
that shares the first two segments of the chain (26 bits).  A block with more
than ``LIMIT`` fingerprints is cut further by the next budget: its pairs share
the first four segments but for one bit, so every fingerprint goes to one cell
for each bit that may differ; as fingerprints are distinct, such a cell holds
2**13 of them at most, however many there are.  Inside a block or cell the
chain's budgets are checked one after the other before all bits are counted.

Only distinct fingerprints are joined, cells are dealt to tasks by the number
of rows, and a task gives links that connect what it found to be linked, never
all pairs.  Hash, fingerprint and pairs are computed in numpy over Arrow
batches; long texts are read piece by piece.

Defined results: null texts, empty texts and texts without words have
fingerprint zero and link as any other; a text of fewer words than a shingle is
one shingle; rows that repeat under one id count each; a row without an id has
a fingerprint and passes links on, but names no component (its component has
the smallest id there is, null if there is none); an empty table gives no rows;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernel import discard, lean, settle, string_buffers

WORDS, SEED, BITS = 3, 42, 64
DISTANCE, SEGMENTS = 2, 5
#: Fingerprints of a block that is not cut further, and rows dealt to a task.
LIMIT, TASK_ROWS = 4096, 1 << 15
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, piece by piece; pieces end between words."""
    at = 0
    while at < len(raw):
        stop = at + piece
        if stop < len(raw):
            blank = _BLANK.search(raw, stop)
            stop = blank.start() if blank else len(raw)
        yield raw[at:stop].lower().split()
        at = stop


def _set_bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have bit k set, for every k."""
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(raw: bytes, k: int = WORDS, seed: int = SEED, piece: int = PIECE) -> tuple[int, int]:
    """(fingerprint, shingles) of a text's UTF-8 bytes."""
    digest, counts, n, words = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []
    for more in word_pieces(raw, piece):
        words += more
        if len(words) < k:
            continue
        text = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        hashes = [digest(text[a:b], seed) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
        counts += _set_bits(hashes)
        n += len(hashes)
        words = words[len(words) - k + 1 :]
    if not n and words:
        counts, n = _set_bits([digest(b" ".join(words), seed)]), 1
    return int(((2 * counts > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum()), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """id, fp (the fingerprint as a signed long), n_shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = string_buffers(batch.column(1))
            at = offs.tolist()
            made = [fingerprint(raw[a:b].tobytes(), k) for a, b in zip(at, at[1:])]
            fps = np.array([fp for fp, _ in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([n for _, n in made], pa.int64())], names=["id", "fp", "n_shingles"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long, n_shingles long")


class Ring:
    """Segments, chain budgets and the masks of chains."""

    def __init__(self, distance: int = DISTANCE, segments: int = SEGMENTS, bits: int = BITS):
        if not 0 <= distance < segments <= bits:
            raise ValueError("a ring needs more segments than bits may differ")
        self.distance, self.segments = distance, segments
        cuts = [bits * s // segments for s in range(segments + 1)]
        self.own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
        self.budgets = [length * distance // segments for length in range(1, segments + 1)]

    def chain(self, start: int, length: int) -> int:
        """The bits of so many consecutive segments."""
        return sum(self.own[(start + j) % self.segments] for j in range(length))

    def block_masks(self) -> list[int]:
        """For each start, the bits that must be equal: the longest chain without a budget."""
        return [self.chain(s, self.budgets.count(0)) for s in range(self.segments)]

    def cell_masks(self) -> list[list[int]]:
        """For each start, the longest chain with a budget of at most one, without each of its bits that may differ."""
        length = sum(b <= 1 for b in self.budgets)
        free = [self.chain(s, length) & ~block for s, block in enumerate(self.block_masks())]
        return [[self.chain(s, length) & ~(1 << k) for k in range(BITS) if f >> k & 1] or [self.chain(s, length)] for s, f in enumerate(free)]

    def within(self, differing: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the chain from start keeps every budget and all bits the distance."""
        keep = np.arange(len(differing))
        for length in range(1, self.segments + 1):
            masks = np.array([self.chain(s, length) for s in range(self.segments)], np.uint64)
            keep = keep[np.bitwise_count(differing[keep] & masks[start[keep]]) <= self.budgets[length - 1]]
        return keep


def linked_in_cells(start: np.ndarray, cell: np.ndarray, fps: np.ndarray, ring: Ring, narrow: int = 32, rows: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs; rows of one cell stand together."""
    n = len(fps)
    ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(ends, prepend=0))  # of each row's cell
    place = np.arange(n)

    def told(i: np.ndarray, j: np.ndarray):
        keep = ring.within(fps[i] ^ fps[j], start[i])
        return i[keep], j[keep]

    for step in range(1, narrow):
        i = place[place + step < end]
        if not len(i):
            return
        yield told(i, i + step)
    for first, last in zip(ends - np.diff(ends, prepend=0), ends):  # wide cells: a few rows at a time against all later ones
        for a in range(int(first), int(last) - narrow, max(1, rows // int(last - first))):
            b = min(a + max(1, rows // int(last - first)), int(last) - narrow)
            i, j = np.meshgrid(np.arange(a, b), np.arange(a + narrow, last), indexing="ij")
            far = (j - i) >= narrow
            yield told(i[far], j[far])


def connecting(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place it is connected with."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root != root[root]).any():
                root = root[root]
    return root


def fingerprint_links(distinct: DataFrame, ring: Ring, limit: int = LIMIT) -> DataFrame:
    """a, b: links that connect the fingerprints (column fp, each once) as all links within the distance would."""
    signed = lambda mask: F.lit(mask - (1 << 64) if mask >> 63 else mask)
    whole = F.array(*[F.struct(F.lit(s).alias("start"), signed(m).alias("mask")) for s, m in enumerate(ring.block_masks())])
    blocks = distinct.select("fp", F.explode(whole).alias("c")).select("fp", "c.start", "c.mask", F.col("fp").bitwiseAND(F.col("c.mask")).alias("value"))
    sizes = blocks.groupBy("start", "mask", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = settle(blocks.join(sizes, ["start", "mask", "value"]), "blocks")
    finer = F.array(*[F.array(*map(signed, masks)) for masks in ring.cell_masks()])
    cut = met.where(F.col("size") > limit).select("fp", "start", F.explode(F.element_at(finer, F.col("start") + 1)).alias("mask")).select("fp", "start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    rows = settle(met.where(F.col("size") <= limit).select("fp", "start", "mask", "value").unionByName(cut), "cells")
    tasks = max(1, -(-rows.count() // TASK_ROWS))

    def run(part: pa.Table) -> pa.Table:
        start, mask, value, fps = (part[c].to_numpy() for c in ("start", "mask", "value", "fp"))
        order = np.lexsort((fps, value, mask, start))
        start, mask, value, fps = start[order], mask[order], value[order], fps[order].view(np.uint64)
        fresh = np.append(True, (start[1:] != start[:-1]) | (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))[: len(fps)]
        root = connecting(len(fps), linked_in_cells(start, np.cumsum(fresh), fps, ring))
        own = np.flatnonzero(root != np.arange(len(fps)))
        links = fps.view(np.int64)
        return pa.table({"a": links[own], "b": links[root[own]]})

    dealt = rows.withColumn("task", F.pmod(F.xxhash64("start", "mask", "value"), F.lit(tasks)))
    links = settle(dealt.groupBy("task").applyInArrow(run, "a long, b long"), "near")
    discard(met, rows)
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, distance: int = DISTANCE, segments: int = SEGMENTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links), n_shingles, n_same (documents with this fingerprint)."""
    rows = settle(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_same")), "distinct")
    links = fingerprint_links(distinct.select("fp"), Ring(distance, segments), limit)
    roots = connected_components(links, of=[links])
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n_same", F.coalesce("root", "fp").alias("root"))
    named = settle(placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "n_same", "component_id"), "named")
    discard(distinct, links, roots)
    return rows.join(named, "fp", "left").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_shingles", "n_same")
