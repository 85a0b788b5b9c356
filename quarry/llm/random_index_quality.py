"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse random index vector that follows from its hash.  The
vector of a word is the sum of the index vectors of the words near it in the
sample, normalised; words outside the vocabulary keep their index vector.  A
text is the mean of its word vectors, with the length of that mean (repetition
makes it long), the share of vocabulary words and the log of the word count.
Each word also counts by its shape (case, digits, marks), whose vectors are
pooled beside the others.  A two-layer numpy network scores the pooled vector;
a temperature fitted on rows kept out of training calibrates the probability.

Words are parted by blanks and taken as they stand.  Vectors and network are
fitted on a bounded sample of labelled rows (``SAMPLE``, those whose hashed id
is smallest); whole texts of all rows are scored.

Defined results: null and empty texts pool to zeros and get the score that the
network gives zeros; with nothing to learn from, every score is 0.5; null
labels are not learnt from; repeated labelled ids count once, with the smaller
label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import BLANK_PARTED, SAME, lean, mix, string_buffers, trim, word_hashes

DIMS = 64
VOCABULARY = 16_384
SAMPLE = 6_000
SAMPLE_BYTES = 64 << 20
HIDDEN = 32
_SPIKES = 4
_CHUNK = 1 << 17

#: a-z, A-Z, digits, other ASCII marks and bytes beyond ASCII as a, A, 9, themselves and u.
_SHAPE = np.array([97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256)], dtype=np.uint8)


def index_vectors(words: np.ndarray) -> np.ndarray:
    """Random index vectors: _SPIKES entries of +-0.5 at places that the word's hash gives."""
    out = np.zeros((len(words), DIMS), np.float32)
    rows = np.arange(len(words))
    h = mix(words + np.uint64(0x5851F42D4C957F2D))
    for _ in range(_SPIKES):
        h = mix(h + np.uint64(1))
        out[rows, (h & np.uint64(DIMS - 1)).astype(np.int64)] += np.where((h >> np.uint64(32)) & np.uint64(1), np.float32(0.5), np.float32(-0.5))
    return out


def shapes(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A small number for the shape of each word: the classes of its first, second and last three bytes."""
    n = len(raw)
    cls = _SHAPE[raw] if n else raw
    if not len(where):
        return np.zeros(0, np.uint64)
    word = BLANK_PARTED[raw]
    ends = np.flatnonzero(word & ~np.append(word[1:], False))
    last = ends[np.minimum(np.searchsorted(ends, where), len(ends) - 1)]
    get = lambda at: np.where((at >= where) & (at <= last), cls[np.clip(at, 0, n - 1)], 0).astype(np.uint64)
    code = get(where)
    for at in (where + 1, last - 2, last - 1, last):
        code = code * np.uint64(256) + get(at)
    return mix(code)


class WordVectors:
    """The vocabulary as sorted hashes with a vector each, and one more row per bucket of words outside it."""

    OUTSIDE = 4096

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        found, counts = np.unique(words, return_counts=True)
        keep = np.sort(found[np.lexsort((found, -counts))[:VOCABULARY]])
        self.keys = keep
        at = self.rows(words)
        n = len(keep) + self.OUTSIDE
        texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        base = index_vectors(np.concatenate([keep, np.arange(self.OUTSIDE, dtype=np.uint64)]))
        summed = np.zeros((n, DIMS), np.float32)
        for step in (1, 2):
            if len(at) > step:
                same = texts[:-step] == texts[step:]
                a, b = at[:-step][same], at[step:][same]
                for d in range(DIMS):
                    column = base[:, d]
                    summed[:, d] += np.bincount(a, weights=column[b], minlength=n) + np.bincount(b, weights=column[a], minlength=n)
        norm = np.linalg.norm(summed, axis=1, keepdims=True)
        self.vectors = np.where(norm > 0, 0.5 * summed / np.maximum(norm, 1e-9) + 0.5 * base, base).astype(np.float32)
        self.vectors[len(keep) :] = base[len(keep) :]

    def rows(self, words: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return (words % np.uint64(self.OUTSIDE)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, at, len(self.keys) + (words % np.uint64(self.OUTSIDE)).astype(np.int64))

    def pool(self, column: pa.Array) -> np.ndarray:
        """One row of features per text."""
        raw, offs = string_buffers(column)
        words, where, bounds = word_hashes(raw, offs, BLANK_PARTED, SAME)
        shape = shapes(raw, where)
        n = len(bounds) - 1
        counts = np.diff(bounds)
        mean, form = np.zeros((n, DIMS)), np.zeros((n, DIMS))
        inside = np.zeros(n)
        kinds, kind_at = np.unique(shape, return_inverse=True)
        kind_vectors = index_vectors(kinds)
        for a in range(0, len(words), _CHUNK):
            b = min(a + _CHUNK, len(words))
            at = self.rows(words[a:b])
            i = int(np.searchsorted(bounds, a, "right")) - 1
            j = int(np.searchsorted(bounds, b, "left"))
            cuts = np.maximum(bounds[i:j], a) - a
            full = cuts < np.append(cuts[1:], b - a)
            texts = np.arange(i, j)[full]
            mean[texts] += np.add.reduceat(self.vectors[at], cuts[full], axis=0)
            form[texts] += np.add.reduceat(kind_vectors[kind_at[a:b]], cuts[full], axis=0)
            inside[texts] += np.add.reduceat((at < len(self.keys)).astype(float), cuts[full])
        size = np.maximum(counts, 1)[:, None]
        mean, form = mean / size, form / size
        more = np.stack([np.linalg.norm(mean, axis=1), np.linalg.norm(form, axis=1), inside / size[:, 0], np.log1p(counts) / 8, (counts > 0).astype(float)], axis=1)
        return np.concatenate([mean * 4, form * 2, more], axis=1)


class TwoLayerNet:
    """tanh hidden layer, logistic output, Adam; deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4):
        rng = np.random.default_rng(7)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 128):
                i = order[a : a + 128]
                h = np.tanh(z[i] @ params[0] + params[1])
                g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(g, params[2]) * (1 - h**2)
                grads = [z[i].T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
                step += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.params = params
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x) and 0 < y.mean() < 1:
            logits = self.logits(x)
            loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - y * logits / t))
            self.temperature = min((loss(t), t) for t in np.geomspace(0.5, 8, 25))[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class QualityModel:
    def __init__(self, texts: list[str], labels: np.ndarray):
        self.net = None
        column = pa.array(texts, pa.large_string())
        raw, offs = string_buffers(column)
        words, _, bounds = word_hashes(raw, offs, BLANK_PARTED, SAME)
        self.vectors = WordVectors(words, bounds)
        if len(labels):
            x = self.vectors.pool(column)
            apart = np.arange(len(x)) % 6 == 5
            self.net = TwoLayerNet(x[~apart], labels[~apart])
            self.net.calibrate(x[apart], labels[apart])

    def score(self, column: pa.Array) -> np.ndarray:
        return self.net.score(self.vectors.pool(column)) if self.net else np.full(len(column), 0.5)


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """At most SAMPLE whole texts of SAMPLE_BYTES in all with their labels: of learnable documents with a label those with the smallest hashed ids; of rows with one id the least text.

    Labels without a document are not drawn, and a text that would go beyond the bytes is passed over, not the texts after it.

    Sizes are looked at first, so no more than the sample comes to the driver.
    """
    few = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learnable)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("double").alias("label"))
        .join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        .withColumn("h", F.xxhash64("id", F.lit(29)))
        .orderBy("h", "id")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.min(F.octet_length("text")).alias("size"), F.first("label").alias("label"), F.first("h").alias("h"))
    ids, used = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["h"], str(r["id"]))):
        if used + r["size"] > SAMPLE_BYTES:
            continue
        used += r["size"]
        ids.append((r["id"], r["size"], r["label"], r["h"]))
    if not ids:
        return [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame(ids, f"id {texts.schema['id'].dataType.simpleString()}, size long, label double, h long")
    rows = texts.join(F.broadcast(chosen), "id").where(F.octet_length("text") == F.col("size")).groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("h").alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r["h"], str(r["id"])))
    trim()
    return [r["text"] for r in rows], np.array([r["label"] for r in rows])


def held_out(id_col: str) -> Column:
    """The crc32 of the id in decimal, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learnable: Column | None = None) -> DataFrame:
    """doc_id, score: the calibrated probability of label 1 for every whole text."""
    learnable = ~held_out(id_col) if learnable is None else learnable
    model = docs.sparkSession.sparkContext.broadcast(QualityModel(*labelled_sample(docs, labels, learnable, id_col, text_col, label_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
