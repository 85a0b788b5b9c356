"""Language identification by interpolated Kneser-Ney character models.

One character model of order ``ORDER`` per language, absolute discounting with
continuation counts below the highest order.  All languages share one sorted
array of 64-bit n-gram hashes per order; beside each hash stand, per language,
the interpolated log-probability of the n-gram and the back-off weight of its
use as a context.  A text is scored in numpy passes: hash every n-gram, look it
up (the top bits of a hash index into the sorted array, then a short probe),
and fall back by the context's weight where a language has not seen it.  The
lowest cross-entropy per character wins.

Calibration on a fold of the sample that was not counted gives the temperature
of the reported probability and, for each language, the cross-entropy beyond
which a text is rejected as none of the languages (the fold's largest, less what
chance adds to short texts, and a margin).

The models are fitted on a bounded sample of labelled rows (``SAMPLE`` texts a
language at most, those whose hashed id is smallest, and at most
``SAMPLE_BYTES`` of text in all, of which each language has the same share; the
text that passes the share is cut there); every text is scored whole.  Which texts
and how much of each is settled from their sizes, so no more comes to the driver.

Defined results: a null text, or one without any letter, is ``und`` with score
0 and rejected; texts are scored as they are, in lower case; rows without a
label are never learnt from; if nothing can be learnt, every row is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import lean, mix

ORDER = 4
SAMPLE = 400
SAMPLE_BYTES = 24 << 20
LANGUAGES = 200
DISCOUNT = 0.75
CHUNK = 1 << 18
#: Texts that are Python strings at a time.
ROWS = 1000
#: How far beyond the calibration texts of its language a cross-entropy must lie to be rejected, in bits a character:
#: so much, and SHORT / sqrt(characters) that chance may add to a text.
REJECT_MARGIN = 1.75
SHORT = 4.0
_GAP = 0x110000  # stands before and after each text


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _ngram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """hashes[k-1][i] names the k characters that end at i; characters before the start count as the gap."""
    x = mix(codes.astype(np.uint64) + np.uint64(1))
    out = [mix(x)]
    rolled = x.copy()
    gap = mix(np.array([_GAP + 1], np.uint64))[0]
    for k in range(1, ORDER):
        factor = np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64))
        before = np.full(len(x), gap, np.uint64)
        before[k:] = x[:-k] if k < len(x) else x[:0]
        rolled = rolled + before * factor
        out.append(mix(rolled + np.uint64(k)))
    return out


class SortedHashes:
    """Sorted 64-bit keys, indexed by their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(math.log2(max(16, len(keys)))) + 1)
        self.shift = np.uint64(64 - self.bits)
        edges = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        edges = edges[:-1] << self.shift
        self.first = np.append(np.searchsorted(keys, edges), len(keys)).astype(np.int32)
        self.probes = int(np.diff(self.first).max(initial=0))
        self.padded = np.append(keys, np.uint64(0))

    def find(self, query: np.ndarray) -> np.ndarray:
        """Index of each queried key, -1 where there is none."""
        at = self.first[query >> self.shift]
        out = np.full(len(query), -1, np.int32)
        open_ = np.arange(len(query))
        for _ in range(self.probes):
            here = self.padded[at]
            wanted = query[open_]
            hit = here == wanted
            out[open_[hit]] = at[hit]
            go = here < wanted
            go &= at < len(self.keys)
            open_, at = open_[go], at[go] + 1
            if not len(open_):
                break
        return out


class _Counts:
    """The different n-grams of one language by order: (n-grams, counts, tails, heads), and its contexts."""

    def __init__(self, texts: list[str]):
        self.grams = [[np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64)] for _ in range(ORDER)]
        self.contexts = [np.zeros(0, np.uint64) for _ in range(ORDER)]
        self._new: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        pad, held = np.full(ORDER - 1, _GAP, np.uint32), 0
        for t in texts:
            codes = np.concatenate([pad, _codes(t)])
            for a in range(ORDER - 1, len(codes), CHUNK):
                before = min(a, ORDER)
                hashes = _ngram_hashes(codes[a - before : a + CHUNK])
                self._new.append(([h[before:] for h in hashes], [h[before - 1 : -1] for h in hashes]))
                held += len(hashes[0])
                if held >= CHUNK:
                    self._merge()
                    held = 0
        self._merge()

    def _merge(self) -> None:
        for k in range(ORDER if self._new else 0):
            here, ahead = ([x[side][k] for x in self._new] for side in (0, 1))
            low = [[x[side][k - 1] if k else x[side][0] for x in self._new] for side in (0, 1)]
            keys, counts, tails, heads = self.grams[k]
            found, first, of = np.unique(np.concatenate([keys, *here]), return_index=True, return_inverse=True)
            weights = np.concatenate([counts, np.ones(sum(map(len, here)))])
            self.grams[k] = [found, np.bincount(of, weights, len(found)), np.concatenate([tails, *low[0]])[first], np.concatenate([heads, *low[1]])[first]]
            self.contexts[k] = np.unique(np.concatenate([self.contexts[k], *ahead]))
        self._new = []


class CharacterModels:
    """The models of all languages; plain arrays, so it is broadcast as it is."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self._fit([_Counts(texts[lang]) for lang in self.languages])

    def _fit(self, found: list[_Counts]) -> None:
        """Tables of float32, filled one language at a time."""
        n_lang = len(self.languages)
        self.index: list[SortedHashes] = []
        self.logp: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        # what each n-gram's tail (one character less of history) and context (one character less at the end) are
        joint = []
        for k in range(ORDER):
            keys = np.unique(np.concatenate([x for f in found for x in (f.grams[k][0], f.contexts[k])])) if n_lang else np.zeros(0, np.uint64)
            joint.append(keys)
            self.index.append(SortedHashes(keys))
        counts: list[np.ndarray] = []
        tails: list[np.ndarray] = []
        heads: list[np.ndarray] = []
        for k in range(ORDER):
            own = np.zeros((len(joint[k]), n_lang), np.float32)
            tail = np.zeros(len(joint[k]), np.int64)
            head = np.zeros(len(joint[k]), np.int64)
            for j, f in enumerate(found):
                keys, times, tail_keys, head_keys = f.grams[k]
                at = np.searchsorted(joint[k], keys)
                own[at, j] = times
                if k:
                    tail[at] = np.searchsorted(joint[k - 1], tail_keys)
                    head[at] = np.searchsorted(joint[k - 1], head_keys)
            counts.append(own)
            tails.append(tail)
            heads.append(head)
        # below the highest order, a count is the number of different characters seen before
        for k in range(ORDER - 1):
            for j in range(n_lang):
                counts[k][:, j] = np.bincount(tails[k + 1], counts[k + 1][:, j] > 0, len(joint[k]))
        size = max(1, int((counts[0] > 0).any(1).sum()))
        self.floor = np.zeros(n_lang, np.float32)
        probs = np.zeros((0, n_lang), np.float32)
        for k in range(ORDER):
            lower, probs = probs, np.zeros((len(joint[k]), n_lang), np.float32)
            if k:
                self.weight.append(np.zeros((len(joint[k - 1]), n_lang), np.float32))
            for j in range(n_lang):
                c = counts[k][:, j].astype(np.float64)
                if k == 0:
                    total = c.sum()
                    lam = DISCOUNT * (c > 0).sum() / max(total, 1) if total > 0 else 1.0
                    p = np.maximum(c - DISCOUNT, 0) / max(total, 1) + lam / (size + 1)
                    self.floor[j] = np.log2(lam / (size + 1))
                else:
                    total = np.bincount(heads[k], c, len(joint[k - 1]))
                    kinds = np.bincount(heads[k], c > 0, len(joint[k - 1]))
                    lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                    self.weight[k - 1][:, j] = np.log2(lam)
                    p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[heads[k]], 1) + lam[heads[k]] * lower[tails[k], j]
                probs[:, j] = p
            counts[k] = np.zeros((0, n_lang), np.float32)
            self.logp.append(np.log2(probs))

    def _chunk_logp(self, codes: np.ndarray) -> np.ndarray:
        """log2 of each character's probability, per language."""
        hashes = _ngram_hashes(codes)
        n = len(codes)
        at = self.index[ORDER - 1].find(hashes[ORDER - 1])
        out = self.logp[ORDER - 1][at]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            total = np.zeros((len(todo), len(self.languages)), np.float32)
            live = np.arange(len(todo))
            for k in range(ORDER - 2, -1, -1):
                where = todo[live]
                before = where - 1
                context = np.where(before >= 0, hashes[k][np.maximum(before, 0)], np.uint64(0))
                ctx = self.index[k].find(context)
                has = ctx >= 0
                total[live[has]] += self.weight[k][ctx[has]]
                low = self.index[k].find(hashes[k][where])
                got = low >= 0
                total[live[got]] += self.logp[k][low[got]]
                live = live[~got]
                if not len(live):
                    break
            total[live] += self.floor
            out[todo] = total
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a character, per text and language; texts are joined with gaps and walked in chunks."""
        out = np.zeros((len(texts), len(self.languages)))
        lengths = np.zeros(len(texts))
        pad = np.full(ORDER - 1, _GAP, np.uint32)
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                codes = np.concatenate([x for _, c in group for x in (pad, c)])
                logp = self._chunk_logp(codes)
                begins = np.cumsum([0] + [len(c) + len(pad) for _, c in group])
                for (i, c), b in zip(group, begins.tolist()):
                    out[i] -= logp[b + len(pad) : b + len(pad) + len(c)].sum(0, dtype=np.float64)
            group, held = [], 0

        for i, text in enumerate(texts):
            codes = _codes(text)
            lengths[i] = len(codes)
            for a in range(0, len(codes), CHUNK):
                part = codes[a : a + CHUNK]
                if a:  # the history of a part's first characters is in the part before
                    logp = self._chunk_logp(codes[a - ORDER + 1 : a + CHUNK])
                    out[i] -= logp[ORDER - 1 :].sum(0, dtype=np.float64)
                    continue
                group.append((i, part))
                held += len(part)
                if held >= CHUNK:
                    flush()
        flush()
        return out / np.maximum(lengths, 1)[:, None]


class LanguageIdentifier:
    """Models, temperature and rejection limit."""

    def __init__(self, sample: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        held: list[tuple[str, str]] = []
        seen: dict[str, int] = {}
        for lang, text in sample:  # an eighth of each language calibrates, its first seven texts are counted
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] % 8 == 0:
                held.append((lang, text))
            else:
                by.setdefault(lang, []).append(text)
        self.models = CharacterModels(by)
        self.temperature, self.limits = 1.0, np.full(len(self.models.languages), math.inf)
        held = [(lang, t) for lang, t in held if lang in by and t]
        if held and len(by) > 1:
            bits = self.models.cross_entropies([t for _, t in held])
            right = np.array([self.models.languages.index(lang) for lang, _ in held])
            losses = []
            for t in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
                p = self._softmax(bits, t)[np.arange(len(right)), right]
                losses.append((-np.log(np.maximum(p, 1e-12)).mean(), t))
            self.temperature = min(losses)[1]
        if held:
            bits = self.models.cross_entropies([t for _, t in held])
            best = bits.argmin(1)
            beyond = bits.min(1) - SHORT / np.sqrt([len(t) for _, t in held])
            for j in range(len(self.limits)):
                own = beyond[best == j] if (best == j).any() else beyond
                self.limits[j] = float(own.max()) + REJECT_MARGIN + 2 / math.sqrt(len(own))  # few texts say less

    @staticmethod
    def _softmax(bits: np.ndarray, temperature: float) -> np.ndarray:
        z = -(bits - bits.min(1, keepdims=True)) * temperature
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, probability of it, rejected?) for each text."""
        names = self.models.languages
        fit = [i for i, t in enumerate(texts) if t and names and any(map(str.isalpha, t))]
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if fit:
            bits = self.models.cross_entropies([texts[i] for i in fit])
            best = bits.argmin(1)
            p = self._softmax(bits, self.temperature)[np.arange(len(best)), best]
            for i, b, s, h in zip(fit, best.tolist(), p.tolist(), bits.min(1).tolist()):
                lang[i], score[i], rejected[i] = names[b], s, h > self.limits[b] + SHORT / math.sqrt(len(texts[i]))
        return lang, score, rejected


def training_sample(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most SAMPLE whole texts of each of at most LANGUAGES languages, those with the smallest hashed ids; rows without an id are not learnt."""
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.lit(17)).alias("h"), F.octet_length(text_col).alias("bytes")
    )
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "bytes"))).where(F.col("r") <= SAMPLE)
    chosen = ranked.orderBy("r", "lang", "id").limit(SAMPLE * LANGUAGES).collect()
    share = max(1, SAMPLE_BYTES // max(1, len({row["lang"] for row in chosen})))
    left = {row["lang"]: share for row in chosen}
    parts: dict[tuple, tuple] = {}
    for row in chosen:
        most = min(left[row["lang"]], row["bytes"])
        if most > 0 and (row["id"], row["lang"]) not in parts:
            left[row["lang"]] -= most
            parts[row["id"], row["lang"]] = (row["id"], row["lang"], row["bytes"], most)
    if not parts:
        return []
    kind = rows.schema["id"].dataType.simpleString()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(parts.values()), f"id {kind}, lang string, bytes int, most int"))
    texts = docs.where(learnable).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.octet_length(text_col).alias("bytes"), F.col(text_col).cast("string").alias("text"))
    cut = F.substring("text", F.lit(1), F.col("most"))  # as many characters as bytes at most
    found = texts.join(wanted, ["id", "lang", "bytes"]).groupBy("id", "lang", "most").agg(F.min(cut).alias("text")).collect()
    out = [(r["lang"], r["text"].encode("utf-8", "surrogatepass")[: r["most"]].decode("utf-8", "ignore")) for r in found]
    return sorted(out, key=lambda x: (hash_order(x[1]), x))


def hash_order(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learnable: Column | None = None) -> DataFrame:
    """All columns of docs, and lang_pred, lang_score, lang_rejected (which replace columns of these names).

    learnable: rows whose label may be learnt from; those whose crc32 of the id modulo 4 is not 2 unless given.
    """
    learnable = ~held_out(id_col) if learnable is None else learnable
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(LanguageIdentifier(training_sample(docs, learnable, id_col, text_col, lang_col)))
    made = {"lang_pred": "string", "lang_score": "double", "lang_rejected": "boolean"}
    docs = docs.drop(*made)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = [model.value.predict(texts.slice(a, ROWS).to_pylist()) for a in range(0, len(texts), ROWS)]
            lang, score, rejected = ([x for f in found for x in f[k]] for k in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, *made])

    for name, kind in made.items():
        schema = type(schema)([*schema.fields]).add(name, kind)
    return docs.mapInArrow(lean(run), schema)


def held_out(id_col: str) -> Column:
    """The crc32 of the id in decimal, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
