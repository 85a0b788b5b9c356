"""BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side in no vocabulary token can never be merged,
so the place between them is a certain cut.  A text falls apart at these cuts,
each fragment is encoded on its own (and remembered, as most fragments are
words that come again), and the token lists are concatenated.

The splitting pattern that runs before the merges looks at more than two bytes
in two cases only, and there no cut is made: after white space (the pattern
looks ahead of a run of blanks) and beside an apostrophe (contractions).  Added
tokens count as vocabulary, so none of them is ever cut.  Fragments end between
characters.

Defined results: a null text counts as empty and has no tokens; the null id and
repeated rows are kept as they come; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SEGMENT, lean, string_buffers

#: Fragments that a worker remembers; then it starts anew, so memory stays bounded.
REMEMBERED = 200_000
#: Longer fragments are not worth remembering.
REMEMBERED_BYTES = 64
_EMPTY = hashlib.sha256().hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabularies of byte-level tokenizers: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class BoundaryBpe:
    """Encoder and decoder for one tokenizer file; made once in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.no_truncation()
        self._own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()} | added
        mergeable = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            b = np.frombuffer(token, np.uint8)
            mergeable[b[:-1], b[1:]] = True
        #: forced[256 * a + b]: a certain cut lies between the bytes a and b.
        forced = ~mergeable
        forced[[*range(9, 14), *range(0x1C, 0x21), ord("'")]] = False
        forced[:, 0x80:0xC0] = False
        forced[:, ord("'")] = False
        self.forced = forced.reshape(-1)
        self._known: dict[bytes, tuple[int, bytes, bytes]] = {}

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Ends of the fragments of a text, given as an array of its bytes, but for the last."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.forced[(b[:-1].astype(np.uint16) << np.uint16(8)) | b[1:]])
        wide = at[b[at] >= 0x80]
        if len(wide):
            lead, lead3 = b[np.maximum(wide - 1, 0)], b[np.maximum(wide - 2, 0)]
            blank = (lead == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3))  # might end a blank beyond ASCII
            if blank.any():
                at = np.setdiff1d(at, wide[blank], assume_unique=True)
        return at + 1

    def _learn(self, pieces: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """For each fragment (number of tokens, ids in decimal with a comma after each, bytes that they decode to)."""
        found = list(map(self._known.get, pieces))
        missing = [p for p, f in zip(pieces, found) if f is None]
        if missing:
            if len(self._known) + len(missing) > REMEMBERED:
                self._known.clear()
            made = {}
            for p, e in zip(missing, self._own.encode_batch_fast([p.decode("utf-8", "replace") for p in missing], add_special_tokens=False)):
                ids = e.ids
                made[p] = (len(ids), b"%d," * len(ids) % tuple(ids), b"".join(map(self.bytes_of.__getitem__, ids)))
            self._known.update((p, m) for p, m in made.items() if len(p) <= REMEMBERED_BYTES)
            found = [f if f is not None else made[p] for p, f in zip(pieces, found)]
        return found

    def encode(self, text: str) -> list[int]:
        whole = text.encode("utf-8", "surrogatepass")
        ends = [*self.cuts(np.frombuffer(whole, np.uint8)).tolist(), len(whole)]
        return [int(i) for _, ids, _ in self._learn([whole[a:b] for a, b in zip([0, *ends], ends) if b > a]) for i in ids.split(b",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def pieces(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, memoryview, memoryview]]:
        """(text, at, tokens, ids in decimal with a comma after each, decoded bytes) of consecutive parts of the texts of a batch; at: the byte where the part ends.

        The fragments of about SEGMENT bytes at a time are told apart by their bytes, each different one is encoded once, and the results are laid out in the order of the text.
        """
        a, end = 0, int(offs[-1])
        while a < end:
            b = min(a + SEGMENT, end)
            while True:
                part = raw[a:b]
                inner = offs[np.searchsorted(offs, a, "right") : np.searchsorted(offs, b, "left")] - a
                ends = np.unique(np.concatenate([self.cuts(part), inner]))
                if b == end or len(ends):
                    break
                b = min(2 * b - a, end)
            if b == end:
                ends = np.append(ends[ends < len(part)], len(part))
            part = part[: ends[-1]]
            starts = np.concatenate([[0], ends[:-1]])
            slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(starts, ends[-1])), pa.py_buffer(part)])
            coded = slices.dictionary_encode()
            which = coded.indices.to_numpy()
            entries = self._learn(coded.dictionary.to_pylist())
            tokens = np.array([e[0] for e in entries])[which]
            take = pa.array(which, pa.int32())
            ids, ids_at = _laid_out(pa.array([e[1] for e in entries], pa.large_binary()).take(take))
            text, text_at = _laid_out(pa.array([e[2] for e in entries], pa.large_binary()).take(take))
            bounds = np.searchsorted(ends, np.append(inner[inner < ends[-1]], ends[-1]), "left") + 1
            doc = int(np.searchsorted(offs, a, "right")) - 1
            total = np.concatenate([[0], np.cumsum(tokens)])
            i = 0
            for j in np.unique(bounds).tolist():
                at = a + int(ends[j - 1])
                while offs[doc + 1] < at:
                    doc += 1
                yield doc, at, int(total[j] - total[i]), ids[ids_at[i] : ids_at[j]], text[text_at[i] : text_at[j]]
                i = j
            a += int(ends[-1])


@lru_cache(2)
def worker_bpe(path: str) -> BoundaryBpe:
    """One for all tasks of a Python worker, so that what it remembers lasts."""
    return BoundaryBpe(path)


def _laid_out(column: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    raw, offs = string_buffers(column)
    return memoryview(raw), offs


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids array<int>: every whole text as tokens; decode_documents gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            raw, offs = string_buffers(batch.column(1))
            ids: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for doc, _, _, decimal, _ in bpe.pieces(raw, offs):
                ids[doc].append(np.array(bytes(decimal[:-1]).split(b","), dtype="S10").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.concatenate(x) if x else np.zeros(0, np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, token_ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: token lists back to texts; null lists give empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    picked = encoded.select("doc_id", "token_ids")
    return picked.mapInArrow(lean(run), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what encoding and then decoding gives, without moving the token lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            raw, offs = string_buffers(batch.column(1))
            n = batch.num_rows
            counts = [0] * n
            ids_sha, text_sha = [_EMPTY] * n, [_EMPTY] * n
            open_doc, ids_hash, text_hash = -1, None, None
            for doc, at, tokens, decimal, text in bpe.pieces(raw, offs):
                if doc != open_doc:
                    open_doc, ids_hash, text_hash = doc, hashlib.sha256(), hashlib.sha256()
                counts[doc] += tokens
                over = at == offs[doc + 1]
                ids_hash.update(decimal[:-1] if over else decimal)
                text_hash.update(text)
                if over:
                    ids_sha[doc], text_sha[doc] = ids_hash.hexdigest(), text_hash.hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
