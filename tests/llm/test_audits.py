"""The filter audit, the fingerprints' join and the source audit against plain versions, and on odd rows."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import filter_audit, pigeonring_simhash, source_divergence

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty and blank texts, repeated rows and texts, a very long text, a null id, null parts.
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "", None), (4, "one two", "en", "b"), (4, "one two", "en", "b"), (5, "one two", "de", "b"),
    (6, "Word " * 60_000, "en", None), (None, "lost id text here", "en", "a"), (None, "one two", "en", "a"), (7, "x" * 300_000, None, None), (8, "Ünï ¿cödé? 한글 😀", "fr", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("id", "part", "mask", "n", "fp", "term", "p0", "first", "value", "item")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 11 filters


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    smallest = {}
    for d, t, *_ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    rows = collections.defaultdict(list)
    for d, t, lang, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and smallest[t] < d]
        rows[lang or ""].append(({c for c, f in zip("ABCDE", fails) if f}, d in good, d in toxic))
    out = set()
    for part, own in rows.items():
        told = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                here = [r for r in own if c in r[0] and not r[0] & set(order[:k])]
                kept = sum(not r[0] & set(order[: k + 1]) for r in own)
                told.append((part, order, k + 1, kept, len(here), sum(bool(c in r[0] and r[0] & set(order[:k])) for r in own), sum(r[0] == {c} for r in own), sum(r[1] for r in here), sum(r[2] for r in here)))
        total = collections.Counter()
        for t in told:
            total[t[1][t[2] - 1]] += t[4]
        out |= {(*t, total[t[1][t[2] - 1]]) for t in told}
    return out


def test_filter_audit(spark, none):
    rng = random.Random(3)
    docs = list(ODD)
    for k in range(20, 120):
        words = [rng.choice(["alpha", "beta", "Gamma", "d#", "e"]) + str(rng.randrange(rng.choice([2, 500]))) for _ in range(rng.choice([5, 190, 230, 400]))]
        docs.append((k, " ".join(words) if rng.random() > 0.2 else docs[-1][1], rng.choice(["en", "de", None]), "s"))
    labels = [(k, rng.randrange(2), rng.choice([0, 1, None])) for k in range(0, 100, 2)] + [(20, 1, 0), (20, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(clashing(spark.createDataFrame(docs, SCHEMA)).repartition(5), table.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_audit(docs, labels)
    bare = filter_audit.audit_filters(spark.createDataFrame(docs, SCHEMA), table.where("false"))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert filter_audit.audit_filters(none, table).count() == 0


def test_incidence_matrices():
    by = filter_audit.IncidenceMatrices()
    assert by.kept.shape == (32, 600) and len(by.orders) == len(set(by.orders)) == 120
    assert ((by.removed + by.redundant) == [[mask >> f & 1 for f in by.filter] for mask in range(32)]).all()
    # after the last step a document is kept only if it fails nothing, and is removed once in every order if it fails anything
    assert by.kept[:, 4::5].sum() == 120 and (by.removed.reshape(32, 120, 5).sum(2)[1:] == 1).all()


# -- 12 fingerprints


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [4096, 3])
def test_simhash_components(spark, none, limit):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    docs = [(d, t) for d, t, *_ in ODD]
    for k in range(20, 120):
        own = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        if k % 2:
            own = docs[rng.randrange(len(ODD), len(docs))][1].split() if len(docs) > len(ODD) else own
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((k, " ".join(own)))
    base = " ".join(rng.choice(words) for _ in range(2000))
    docs += [(k, f"{base} {rng.choice(words)} {rng.choice(words)}") for k in range(200, 260)]  # many fingerprints in a few blocks
    fps = [plain_fingerprint(t) for _, t in docs]
    up = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2 and up[i] != up[j]:
            a, b = up[i], up[j]
            up = [a if u == b else u for u in up]
    smallest = {u: min(d for (d, _), v in zip(docs, up) if v == u and d is not None) if any(d is not None for (d, _), v in zip(docs, up) if v == u) else None for u in set(up)}
    want = collections.Counter((d, f"{fp:016x}", smallest[u]) for (d, _), fp, u in zip(docs, fps, up))
    assert len(smallest) < len(set(fps))  # different fingerprints link
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    got = pigeonring_simhash.simhash_components(df, limit=limit)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    assert pigeonring_simhash.simhash_components(none, limit=limit).count() == 0


@pytest.mark.parametrize("distance, segments", [(2, 5), (2, 9), (0, 3), (3, 7)])
def test_links_of_fingerprints(spark, distance, segments):
    """Clusters so dense that blocks are cut: links connect as all pairs would."""
    rng = random.Random(distance + segments)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            for k in rng.sample(range(64), rng.randrange(4)):
                base ^= 1 << k
            fps.add(base)
    fps = sorted(fps)
    near = {(a, b) for a, b in itertools.combinations(fps, 2) if bin(a ^ b).count("1") <= distance}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for limit in (4096, 2):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in pigeonring_simhash.fingerprint_links(table, pigeonring_simhash.Ring(distance, segments), limit).collect()]
        assert parts(fps, links) == parts(fps, near)


def parts(nodes, links):
    up = {n: n for n in nodes}
    find = lambda n: n if up[n] == n else find(up[n])
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_ring():
    ring = pigeonring_simhash.Ring()
    rng = random.Random(1)
    assert ring.budgets == [0, 0, 1, 1, 2]
    for d in range(6):
        for _ in range(100):
            x = sum(1 << k for k in rng.sample(range(64), d))
            assert any(len(ring.within(np.array([x], np.uint64), np.array([s]))) for s in range(5)) == (d <= 2)
    with pytest.raises(ValueError):
        pigeonring_simhash.Ring(5, 5)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_fingerprint_by_pieces(piece):
    rng = random.Random(9)
    for _ in range(40):
        text = "".join(rng.choice("abC é\n\t x") for _ in range(rng.choice([0, 1, 5, 300])))
        assert pigeonring_simhash.fingerprint(text.encode(), piece=piece)[0] == plain_fingerprint(text)


# -- 13 sources


def plain_divergence(docs, least):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    counts, held, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in docs:
        groups.add((lang or "", source or ""))
        for term in (own := cut(text)):
            counts[lang or "", source or "", term] += 1
        held.update((lang or "", term) for term in set(own))
    rows = []
    for lang, source in groups:
        kept = sorted(term for (own, term), n in held.items() if own == lang and n >= least)
        part = lambda sources, term: 1 + 10**9 * (sum(counts[lang, s, term] for s in sources) + 2) // (sum(counts[lang, s, t] for s in sources for t in kept) + 2 * len(kept))  # noqa: B023, E731
        others = [s for own, s in groups if own == lang]
        mine = {t: part([source], t) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        pairs = [(sum(f(mine[t], part([s], t)) for t in kept), s) for s in others if s != source]
        whole = {t: part(others, t) for t in kept}
        terms = [(f(mine[t], whole[t]), t) for t in kept if counts[lang, source, t] and mine[t] > whole[t]]
        for name, found, most in (("pair", pairs, None), ("term", terms, 10)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            rows += [(lang, source, name, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return collections.Counter(rows)


@pytest.mark.parametrize("least", [10, 2, 1])
def test_source_divergence(spark, none, least):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdéÉZ" for b in "xyzü"]
    docs = [r if r[0] != 7 else (7, "x" * 3000, None, None) for r in ODD]
    for k in range(20, 150):
        source = rng.choice("pqrs") if k < 140 else "empty"
        own = [rng.choice(words[: rng.choice([3, 10, 28])]) + rng.choice(["", "1", "-", " "]) for _ in range(rng.choice([0, 3, 50]))] if source != "empty" else []
        docs.append((k, " ".join(own), rng.choice(["en", "de"]), source))
    got = source_divergence.audit_sources(clashing(spark.createDataFrame(docs, SCHEMA)).repartition(4), least=least)
    assert collections.Counter(map(tuple, got.collect())) == plain_divergence(docs, least)
    assert source_divergence.audit_sources(none).count() == 0


def test_terms_of_long_texts():
    rng = random.Random(6)
    text = "".join(rng.choice("abC é1\n ") for _ in range(5000))
    group, terms, n, texts = source_divergence.count_terms(np.array([3]), pa.array([text]), chunk=100)
    want = collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(ASCII_LOWER)))
    assert dict(zip([t.decode() for t in terms.to_pylist()], n.tolist())) == want and set(group) == {3} and set(texts) == {1}


def test_shares_beyond_a_long(spark):
    row = spark.sql("SELECT 123456789012345678L AS n, 234567890123456789L AS total, 1000000007L AS v")
    assert row.select(source_divergence.share("n", "total", "v")).first()[0] == 1 + 10**9 * (123456789012345678 + 2) // (234567890123456789 + 2 * 1000000007)


# -- samples of 5 and 7


def test_labels_without_documents_are_not_drawn(spark, monkeypatch):
    from quarry.llm import random_index_quality

    monkeypatch.setattr(random_index_quality, "SAMPLE", 100)
    docs = spark.createDataFrame([(k, ("good fine words " if k % 2 else "bad junk noise ") * 20 + str(k)) for k in range(200)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    texts, y = random_index_quality.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "quality")
    assert len(texts) == len(y) == 100 and 0 < y.mean() < 1


def test_a_text_beyond_the_bytes_is_passed_over(spark, monkeypatch):
    from quarry.llm import random_index_quality

    monkeypatch.setattr(random_index_quality, "SAMPLE_BYTES", 5_000)
    docs = spark.createDataFrame([(k, "x" * 6_000 if k % 3 == 0 else f"words {k}") for k in range(30)], "doc_id long, text string")
    labels = spark.range(30).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    texts, _ = random_index_quality.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "quality")
    assert sorted(texts) == sorted(f"words {k}" for k in range(30) if k % 3)


@pytest.mark.parametrize("place", range(16))
def test_every_language_is_learnt(place):
    from quarry.llm import kneser_ney

    sample = [("en", f"the cat number {k} sat on the mat and the dog ran") for k in range(15)]
    sample.insert(place, ("fi", "hyvää päivää kaikille ystäville täällä tänään"))
    model = kneser_ney.LanguageIdentifier(sample)
    assert model.models.languages == ["en", "fi"]
    assert model.predict(["hyvää päivää ystäville", "the dog sat on the cat"])[0] == ["fi", "en"]
