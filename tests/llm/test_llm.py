"""The ten operators against plain versions, round trips and held-out accuracy, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import os
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import boundary_bpe, chat_snapshots, components, feistel_pii, kernel, kmeans_tree, kneser_ney, license_join, minhash_containment, queries, random_index_quality, trie_join, url_rules

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty and blank texts, a repeated row, ties, a very long text, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (6, "word " * 60_000), (None, "lost id text here"), (7, "x" * 300_000), (8, "Ünï ¿cödé? 한글 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "id": F.lit("clash"), "n": F.lit(1), "cold": F.lit("clash"), "score": F.lit("clash")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# -- kernels


@pytest.mark.parametrize("segment", [1 << 20, 64, 7])
def test_words_and_shingles(monkeypatch, segment):
    import pyarrow as pa

    monkeypatch.setattr(kernel, "SEGMENT", segment)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abC é\n\t x") for _ in range(rng.choice([0, 1, 5, 200]))) for _ in range(60)] + [None]
    raw, offs = kernel.string_buffers(pa.array(texts))
    hashes, where, bounds = kernel.word_hashes(raw, offs)
    names: dict[int, str] = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        own = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(words)
        for h, w in zip(own, words):
            assert names.setdefault(h, w) == w
        grams, at = kernel.shingle_hashes(hashes, bounds, 4)
        want = [tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        mine = grams[at[i] : at[i + 1]].tolist()
        assert len(mine) == len(want) and len(set(mine)) == len(set(want))
    assert len(set(names.values())) == len(names)


def thue_morse(n):
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse(spark):
    from tokenizers import Tokenizer

    a, b = thue_morse(2048)
    df = spark.createDataFrame([(1, f"{a} same"), (2, f"{b} same"), (3, a), (4, b)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in trie_join.ngram_components(df).collect()} == {(i, i) for i in range(1, 5)}
    plain = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r.ids_sha256 for r in boundary_bpe.round_trip_digests(df, queries.tokenizer_path()).collect()}
    for r in df.collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, plain.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2060)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}


def test_small_tables_have_few_files(spark, monkeypatch):
    """Files follow the bytes, not the number of shuffle partitions: an executor forks for each file it writes."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        files = collections.defaultdict(list)

        def counted(df, name, *of):
            made = kernel.settle(df, name, *of)
            files[name].append(len(made.inputFiles()))
            return made

        monkeypatch.setattr(components, "settle", counted)
        found = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(0, 600, 2)], "a long, b long"))
        assert {(r.node, r.root) for r in found.collect()} == {(k, k - k % 2) for k in range(600)}
        assert files["hooks"] and max(files["hooks"]) <= 2 * spark.sparkContext.defaultParallelism
        wide = kernel.settle(spark.range(1000).repartition(64), "wide")
        many = kernel.settle(wide.repartition(64), "many", [wide])
        assert many.count() == 1000 and len(many.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        monkeypatch.setattr(kernel, "PART_BYTES", 1 + kernel.settled_bytes(wide) // 20)
        assert len(kernel.settle(wide.repartition(64), "more", [wide]).inputFiles()) > 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# -- 1 chats


def test_a_conversation_of_very_many_turns(spark):
    long = spark.range(100_000).select(F.lit(1).alias("conv_id"), "id", F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text")).withColumnRenamed("id", "turn")
    both = long.unionByName(long.where("turn < 60000").withColumn("conv_id", F.lit(2)))
    got = chat_snapshots.collapse_snapshots(both).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(1, 100_000, 1)]


def test_snapshots(spark):
    turns = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    log = turns(1, "a", "b", "c") + turns(2, "a", "b") + turns(3, "a") + turns(4, "a", "b", "c") + turns(5, "a", "x") + turns(6, "ab") + [(7, None, None, None), (7, None, None, None), (None, 0, "user", "a"), (8, 0, "user", "<|im_end|>")]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumn("whole", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_snapshots.collapse_snapshots(df).collect()}
    assert got == {1: (3, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1), 8: (1, 1)}
    forged = chat_snapshots.collapse_snapshots(df).where("conv_id = 8").first().rendered
    assert forged.count("<|im_end|>") == 1
    assert chat_snapshots.collapse_snapshots(df.where("false")).count() == 0


# -- 2 neighbours


@pytest.mark.parametrize("options", [{}, {"leaf": 48}])
def test_neighbours(spark, options):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 16))
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"key": F.lit("clash"), "v": F.lit(1)})
    got = collections.defaultdict(list)
    for r in kmeans_tree.nearest_neighbours(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 900, 20):
        s = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:20]
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert all(abs(score - s[i]) < 1e-9 for i, score in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len(set(want) & set(dict(got[q])))
        total += 20
    assert set(got) == set(range(0, 900, 20)) and hits / total >= 0.9
    assert [i for i, _ in got[120]][:19] == [i for i in range(100, 120)][:19]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kmeans_tree.nearest_neighbours(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0)]
    assert kmeans_tree.nearest_neighbours(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# -- 3 pseudonyms


def test_neighbours_of_repeated_rows(spark):
    rng = random.Random(8)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, same) for i in range(60)] + [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60, 200)]
    df = spark.createDataFrame(2 * rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in kmeans_tree.nearest_neighbours(df, F.col("vec_id") < 3).collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 1, 2} and all(sorted(found) == [i for i in range(21) if i != q] for q, found in got.items())


def feistel(key, tweak, left, right, a, b):
    h = lambda i, side, value, m: int(hashlib.sha256(f"{key}|{tweak}|{i}|{side}|{value}".encode()).hexdigest()[:15], 16) % m
    for i in range(feistel_pii.ROUNDS):
        left = (left + h(i, "l", right, a)) % a
        right = (right + h(i, "r", left, b)) % b
    return left, right


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_feistel_is_a_keyed_permutation(spark):
    rows = spark.range(7 * 11).select((F.col("id") % 7).alias("l"), F.floor(F.col("id") / 7).alias("r"))
    out = rows.select("l", "r", feistel_pii.feistel(F.lit("k"), "t", F.col("l"), F.col("r"), F.lit(7), F.lit(11)).alias("p"))
    back = out.select("l", "r", "p", feistel_pii.feistel(F.lit("k"), "t", F.col("p.l"), F.col("p.r"), F.lit(7), F.lit(11), inverse=True).alias("q")).collect()
    assert len({(x.p.l, x.p.r) for x in back}) == 77
    assert all((x.q.l, x.q.r) == (x.l, x.r) for x in back)
    assert all((x.p.l, x.p.r) == feistel("k", "t", x.l, x.r, 7, 11) for x in back)


def test_pseudonyms(spark, odd):
    text = "mail Joe.b@x.example.com, card 4111 1111 1111 1111 or 4111111111111111 not 4111111111111112; IBAN DE89 3704 0044 0532 0130 00; SSN 078-05-1120 not 666-12-1234; +1 (415) 555-2671; ip 37.233.206.12. v 300.1.1.1; 1987-02-28, 01.12.1999 not 31/02/2000"
    df = spark.createDataFrame([(1, text), (2, "again joe.b@x.example.com 4111111111111111")], "doc_id long, text string")
    out = feistel_pii.pseudonymise(df, key="k", found_col="found")
    a, b = out.orderBy("doc_id").collect()
    assert a.found == ["email", "card", "card", "iban", "ssn", "phone", "ip", "date", "date"]
    for gone in ("Joe.b", "4111 1111 1111 1111", "4111111111111111 ", "DE89 3704", "078-05-1120", "555-2671", "37.233.206.12", "1987-02-28", "01.12.1999"):
        assert gone not in a.text
    for kept in ("4111111111111112", "666-12-1234", "300.1.1.1", "31/02/2000", "+1 ("):
        assert kept in a.text
    cards = re.findall(r"\d{16}", a.text)
    assert luhn(cards[0]) and cards[0] in b.text and cards[0] in a.text.replace(" ", "")
    assert re.search(r"u[0-9a-f]{16}@mail\.invalid", a.text)[0] in b.text
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", a.text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    back = feistel_pii.pseudonymise(out, key="k", inverse=True).orderBy("doc_id").first().text
    assert back.split(", card")[1] == text.split(", card")[1]
    same = feistel_pii.pseudonymise(odd, key="k", found_col="found").select("text").collect()
    assert collections.Counter(r.text for r in same) == collections.Counter(t for _, t in ODD)


def test_pseudonyms_need_a_key(spark, odd):
    with pytest.raises(ValueError, match="need a key"):
        feistel_pii.pseudonymise(odd)
    with pytest.warns(UserWarning, match="public key"):
        assert queries.pii_key(spark) == queries.EVALUATION_KEY
    spark.conf.set("spark.quarry.pii.key", "own")
    try:
        assert queries.pii_key(spark) == "own"
        df = spark.createDataFrame([(1, "a 078-05-1120")], "doc_id long, text string")
        given, named = (feistel_pii.pseudonymise(df, **k).first().text for k in ({}, {"key": "own"}))
        assert given == named != feistel_pii.pseudonymise(df, key="other").first().text
    finally:
        spark.conf.unset("spark.quarry.pii.key")


# -- 4 BPE


def test_valid_values_inside_longer_candidates(spark):
    card = "4111 1111 1111 1111"
    hidden = {
        f"{card} 10/27": card, f"{card} 123": card, f"12 {card}.": card, f"0002 {card} 99": card, f"{card} 555-123-4567": card, "4111111111111111 10/27": "4111111111111111",
        "pay AT61 1904 3002 3457 3201 BIC": "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332 PAID": "ES91 2100 0418 4502 0005 1332", "AT611904300234573201 PAYMENT": "AT611904300234573201",
        "Call 555-123-4567.": "555-123-4567", "Call 555-123-4567. 8 men": "555-123-4567", "born 05/23/1980, 1": "05/23/1980", "born 23/05/1980": "23/05/1980",
    }
    kept = ["4111 1111 1111 1112", "05/32/1980", "13/23/1980", "555-123-4567.8", "41111111111111119"]
    df = spark.createDataFrame(list(enumerate([*hidden, *kept])), "doc_id long, text string")
    out = feistel_pii.pseudonymise(df, key="k", found_col="found")
    got = {r.doc_id: r for r in out.collect()}
    for i, (text, value) in enumerate(hidden.items()):
        assert value not in got[i].text and len(got[i].text) == len(text), text
        at = text.index(value)
        if "555-123-4567" not in text or value != card:
            assert got[i].text[:at] == text[:at] and got[i].text[at + len(value) :] == text[at + len(value) :]
            assert len(got[i].found) == 1
    assert got[4].found == ["card", "phone"] and "555-123-4567" not in got[4].text
    assert [got[len(hidden) + i].text for i in range(len(kept))] == kept
    fresh = got[list(hidden.values()).index("05/23/1980")].text
    assert int(fresh[5:7]) <= 12 < int(fresh[8:10])
    back = {r.doc_id: r.text for r in feistel_pii.pseudonymise(out.drop("found"), key="k", inverse=True).collect()}
    assert all(back[i] == text for i, text in enumerate(hidden) if "/1980" in text or "Call" in text)


def test_bpe_as_the_library_does(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    rng = random.Random(2)
    alphabet = list("abcXYZ059 \n\t'\"!?.,-_éñßü’“…\u00a0\u2003\x1c\x85한中😀\U0001d7d9|<>s t'd'll've're")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 24, 400]))) for _ in range(300)] + ["a  <|endoftext|>  b", "end  ", "\n\n\nx", "don't ”'s !'s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = df.collect()
    ids = collections.Counter()
    for r in rows:
        got = plain.encode(r.text or "", add_special_tokens=False).ids
        ids[(r.doc_id, len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(plain.decode(got, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in boundary_bpe.round_trip_digests(df, path).collect()) == ids
    few = df.where("doc_id < 40")
    encoded = boundary_bpe.encode_documents(few, path)
    assert {(r.doc_id, tuple(r.token_ids)) for r in encoded.collect()} == {(r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in few.collect()}
    assert {tuple(r) for r in boundary_bpe.decode_documents(encoded, path).collect()} == {(r.doc_id, r.text or "") for r in few.collect()}
    assert boundary_bpe.round_trip_digests(none, path).count() == 0


# -- 5 languages


def test_kneser_ney_by_hand():
    """Interpolated probabilities of every character after a context sum to one, and agree with a dictionary version."""
    texts = {"x": ["abracadabra", "abc abd"]}
    models = kneser_ney.CharacterModels(texts)
    order, d = kneser_ney.ORDER, kneser_ney.DISCOUNT
    counts = [collections.Counter() for _ in range(order)]
    for t in texts["x"]:
        padded = ["^"] * (order - 1) + list(t)
        for i in range(order - 1, len(padded)):
            for k in range(order):
                counts[k][tuple(padded[i - k : i + 1])] += 1
    for k in range(order - 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def prob(gram):
        if len(gram) == 1:
            total, kinds = sum(counts[0].values()), len(counts[0])
            return max(counts[0][gram] - d, 0) / total + d * kinds / total / (len(counts[0]) + 1)
        follow = {g: c for g, c in counts[len(gram) - 1].items() if g[:-1] == gram[:-1]}
        total = sum(follow.values())
        if not total:
            return prob(gram[1:])
        return max(follow.get(gram, 0) - d, 0) / total + d * len(follow) / total * prob(gram[1:])

    for text in ("abracadabra", "cab", "zebra", "dabc"):
        padded = ["^"] * (order - 1) + list(text)
        want = -sum(np.log2(prob(tuple(padded[i - order + 1 : i + 1]))) for i in range(order - 1, len(padded))) / len(text)
        assert models.cross_entropies([text])[0, 0] == pytest.approx(want, rel=1e-4)


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = kneser_ney.identify_languages(docs).where(kneser_ney.held_out("doc_id")).collect()
    assert out and sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.95
    assert all(0 <= r.lang_score <= 1 for r in out)
    held = {r.doc_id for r in out}
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == (i in held) for i in range(200))
    got = {(r.doc_id, r.lang_pred) for r in kneser_ney.identify_languages(odd).collect()}
    assert {x for _, x in got} == {"und"} and kneser_ney.identify_languages(none).count() == 0
    mixed = docs.select("doc_id", "text", "lang").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang"))
    by = {(r.doc_id, r.text): r for r in kneser_ney.identify_languages(mixed).where("doc_id > 9999").collect()}
    assert by[(10_001, None)].lang_pred == by[(10_002, "")].lang_pred == by[(10_003, " \n\t ")].lang_pred == "und"
    assert by[(10_004, "one two")].lang_pred in {"en", "fr", "de", "es"} and by[(10_007, "x" * 300_000)].lang_rejected


def test_unseen_languages_are_rejected(spark):
    strange = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.", "Все люди рождаются свободными и равными в своём достоинстве и правах.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są obdarzeni rozumem i sumieniem."]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").withColumn("lang_pred", F.lit("clash"))
    more = spark.createDataFrame([(90_000 + i, t, None, "clash") for i, t in enumerate(strange)], "doc_id long, text string, lang string, lang_pred string")
    out = kneser_ney.identify_languages(docs.unionByName(more)).collect()
    assert all(r.lang_rejected for r in out if r.doc_id >= 90_000) and sum(r.lang_rejected for r in out if r.doc_id < 90_000) <= 1
    assert {r.lang_pred for r in out if r.doc_id < 90_000} <= {"en", "fr", "de", "es"}


def test_every_language_has_its_share(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SAMPLE_BYTES", 4000)
    rows = [(i, lang * 2000, lang) for i, lang in enumerate("abcd" * 10)] + [(90, "\u00e9" * 9000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = collections.Counter()
    for lang, text in kneser_ney.training_sample(docs, F.lit(True), "doc_id", "text", "lang"):
        size[lang] += len(text.encode())
    assert size == dict.fromkeys("abcde", 800)


# -- 6 Jaccard join


def plain_components(rows, k=4, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return collections.Counter((doc, len(s), least.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("options", [{}, {"hot_from": 2, "cell": 2000}, {"hot_from": 1, "hot_limit": 5, "cell": 600}])
def test_ngram_components(spark, odd, options):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = [w if rng.random() > rng.choice([0, 0.005, 0.02]) else rng.choice(words) for w in base]
            rows.append((100 + len(rows), " ".join(own) + (" " + passage if k % 3 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in trie_join.ngram_components(df, **options).collect())
    assert got == plain_components(rows + ODD)


def test_item_blocks_are_bounded_by_rows_and_bytes(spark):
    texts = ["a" * 10, None, "\u00e9" * 10, "b" * 100, "", "c" * 15, "d" * 15, "e", "f", "g", "h"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1)
    blocks = list(minhash_containment.item_blocks(items, "item_id", "text", block=4, block_bytes=30))
    assert [ids for ids, _ in blocks] == [[0, 1, 2], [3], [4, 5, 6], [7, 8, 9, 10]]
    assert [t for _, own in blocks for t in own] == texts and all(len(own) <= 4 and (len(own) == 1 or sum(len((t or "").encode()) for t in own) <= 30) for _, own in blocks)
    assert list(minhash_containment.item_blocks(items.where("false"), "item_id", "text")) == []


def test_leaks_of_nameless_documents(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog tonight")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "so the quick brown fox jumps over the lazy dog tonight again"), (None, "clean"), (2, None), (3, "clean"), (3, "clean")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    kept = minhash_containment.without_leaks(docs, items).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == {(None, "clean"): 1, (2, None): 1, (3, "clean"): 2}
    assert minhash_containment.without_leaks(docs.where("false"), items).count() == 0 and minhash_containment.without_leaks(docs, items.where("false")).count() == 5


def test_quality_of_named_documents(spark):
    docs = spark.createDataFrame([(f"d{i}", "good text " * (1 + i % 3) if i % 2 else "BAD!! text!! " * 3) for i in range(60)] * 2, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    out = random_index_quality.score_quality(docs, labels, learnable=F.lit(True)).collect()
    assert len(out) == 120 and np.mean([r.score for r in out if int(r.doc_id[1:]) % 2]) > np.mean([r.score for r in out if int(r.doc_id[1:]) % 2 == 0]) + 0.3


def test_stragglers_meet_a_family_once(spark):
    rows = [(f"{c:03}-{i}".encode(), 100, b"f", 92, f"c{c:03}", b"big" if i else f"{c:03}-0".encode()) for c in range(300) for i in range(6)]
    rows += [(f"g{i}".encode(), 100, b"g", 92, f"d{i % 2}", b"one") for i in range(4)]
    large = spark.createDataFrame(rows, "sid binary, n long, family binary, band long, cell string, known binary")
    dealt = trie_join.with_stragglers(large, 1 << 18).cache()
    assert dealt.count() == len(rows) and dealt.where("straggler").count() == 300
    own = {r.cell for r in dealt.where("straggler").select("cell").distinct().collect()}
    pairs = {(r.x, r.y) for r in trie_join.cell_pairs(dealt, 5, 85).collect()}
    assert len(own) == 1 and pairs == {(x, y) for x in own for y in {f"c{c:03}" for c in range(300)} | own}
    # without links every set but one is a straggler, and every two cells meet once
    lone = trie_join.with_stragglers(large.where("family = X'66'").withColumn("known", F.col("sid")), 1 << 18)
    names = sorted(r.cell for r in lone.where("straggler").select("cell").distinct().collect())
    pairs = [(r.x, r.y) for r in trie_join.cell_pairs(lone, 5, 85).collect()]
    assert len(names) > 1 and sorted(p for p in pairs if p[1] in names) == [(x, y) for x in names for y in names if x <= y] and len(pairs) == len(names) * (len(names) + 3) // 2


def test_stragglers_of_a_large_family(spark):
    rng = random.Random(12)
    core = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(90):  # one template: most copies link, some are a chain beside it, some stand alone
        edits = rng.choice([0, 1, 1, 4, 5, 6, 12])
        own = list(core)
        for at in rng.sample(range(60), edits):
            own[at] = f"x{rng.randrange(2000)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (600, 4000):
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in trie_join.ngram_components(df, cell=cell).collect())
        assert got == plain_components(rows)
    assert 3 < len({c for _, _, c in plain_components(rows)}) < 80


def test_ngram_components_of_nothing(none):
    assert trie_join.ngram_components(none).count() == 0


# -- 7 quality


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = random_index_quality.score_quality(docs, labels).join(labels, "doc_id").where(random_index_quality.held_out("doc_id")).collect()
    good = [r.score for r in out if r.quality == 1]
    bad = [r.score for r in out if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins >= 0.85 and all(0 <= r.score <= 1 for r in out)
    assert random_index_quality.score_quality(odd, labels.where("false")).where("score = 0.5").count() == len(ODD)
    assert random_index_quality.score_quality(odd, labels).count() == len(ODD)
    assert random_index_quality.score_quality(none, labels).count() == 0


# -- 8 licences


def test_licenses(spark, odd, none):
    texts = ["The MIT License; mit  LICENSE", "Licensed under the Apache License, Version 2.0.", "x\nlicensed under cc by nc 4\ny", "GNU General\nPublic License", "permit license limit licensee", "Released under\nthe MIT\nLicense.", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_join.scan_licenses(df).collect()}
    assert [got[i].places for i in range(7)] == [[1, 3], [3], [], [1], [], [3], []]
    assert got[2].blocks[0].label == "cc-by-nc" and not got[4].blocks
    index = license_join.TemplateIndex()
    vocabulary = index.vocabulary
    rng = random.Random(1)
    for _ in range(300):
        block = {rng.choice(vocabulary) for _ in range(rng.randint(1, 40))}
        for t, (_, order, _) in enumerate(index.templates):
            if rng.random() < 0.3:
                block |= {vocabulary[i] for i in order[: rng.randint(0, len(order))]}
        own = {vocabulary.index(w) for w in block}
        want = [t for t, (_, order, _) in enumerate(index.templates) if len(own & set(order)) >= (license_join.THRESHOLD if len(order) >= license_join.SHORT else 1) * len(order) - 1e-9]
        assert sorted(t for t, _ in index.matches(own, len(own))) == want
    assert license_join.scan_licenses(odd).count() == len(ODD) and license_join.scan_licenses(none).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "mpl": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed",
    "cc-by": "REM This work is licensed under\nREM a Creative Commons Attribution\nREM 4.0 International License",
}


def test_wrapped_licenses(spark):
    texts = [*WRAPPED.values(), "\n\n".join(WRAPPED.values()), "of this software and associated documentation files", "\n".join(2 * [WRAPPED["mit"]]), WRAPPED["bsd"].replace("\n#", "") + "\n" + WRAPPED["bsd"]]
    texts += [WRAPPED["mit"].split("\n")[0], WRAPPED["mit"].split("\n")[1]]  # halves in two texts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [(b.first_word, b.label, b.containment) for b in r.blocks] for r in license_join.scan_licenses(df).collect()}
    for i, label in enumerate(WRAPPED):
        assert {x for _, x, _ in got[i]} - {"cc-by-nc"} == {label} and (label == "cc-by" or got[i] == [(0, label, 1.0)])
    assert {x for _, x, _ in got[4]} >= set(WRAPPED) and got[5] == [] and [b[1] for b in got[6]] == ["mit", "mit"]
    assert [(b[1], b[2]) for b in got[7]] == [("bsd", 1.0), ("bsd", 1.0)] and got[8] == got[9] == []


def test_licenses_told_apart(spark):
    texts = ["The book was released under the license of its publisher.", "Released under the MIT License.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "This work is licensed under a Creative Commons Attribution 4.0 International License"]
    texts += ["x\n" + texts[2] + "\n" + "word " * 60 + "\n" + texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [b.label for b in r.blocks] for r in license_join.scan_licenses(df).collect()}
    assert got == {0: [], 1: ["mit"], 2: ["cc-by-nc"], 3: ["cc-by"], 4: ["cc-by-nc", "cc-by"]}


def test_licenses_by_tags_and_clauses(spark):
    rest = license_join.TEMPLATES["bsd"]
    texts = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: EUPL-1.2", "Mozilla Public License Version 2.0", "GNU General Public License Version 2.0", "SPDX-License-Identifier: CC-BY-NC-4.0"]
    texts += ["* " + "\n* ".join(textwrap.wrap(clause, 50)) for clause in rest[1:]] + ["SPDX License", "x SPDX-License-Identifier: BSD-3-Clause\ny SPDX-License-Identifier: Apache-2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [sorted({b.label for b in r.blocks}) for r in license_join.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [["mit"], [], ["mpl"], [], ["cc-by-nc"]] + 4 * [["bsd"]] + [[], ["apache", "bsd"]]
    own = license_join.scan_licenses(df, templates={"own": ["you may read this text on sundays and holidays only", ""]}, tags={}, phrases={"Mozilla Public": "m"})
    assert [(r.places, r.blocks) for r in own.where("doc_id = 2").collect()] == [([0], [])]
    here = spark.createDataFrame([(1, "you may read\nthis text on sundays\nand holidays only")], "doc_id long, text string")
    assert [b.label for b in license_join.scan_licenses(here, templates={"own": ["you may read this text on sundays and holidays only"]}, tags={}, phrases={}).first().blocks] == ["own"]
    assert license_join.scan_licenses(df, templates={}, tags={}, phrases={}).where("size(blocks) > 0 or size(places) > 0").count() == 0


def test_stretches_of_licenses():
    rng = random.Random(9)
    index = license_join.TemplateIndex(tags=license_join.TAGS)
    for _ in range(60):
        chosen = [rng.choice(index.templates)[1] for _ in range(3)]
        words = [rng.choice(rng.choice(chosen) + [-1] * 8) for _ in range(rng.randint(0, 400))]
        if rng.random() < 0.7:
            words[50:50] = rng.choice(chosen)
        at = np.array([i for i, w in enumerate(words) if w >= 0], np.int64)
        own = np.array([words[i] for i in at], np.int64)
        ends = np.where(at < 100, 100, len(words))  # two texts
        near = {t: index.wrapped(t, at[m], own[m], ends[m]) for t, m in index.stretches(at, own)}
        for t, (_, order, _) in enumerate(index.templates):
            m = np.isin(own, order)
            assert near.get(t, []) == index.wrapped(t, at[m], own[m], ends[m])


def test_templates_without_a_hit_cost_nothing():
    rng = random.Random(3)
    many = {f"l{i}": [" ".join(f"u{rng.randrange(20_000)}" for _ in range(60))] for i in range(500)}
    few = {k: many[k] for k in list(many)[:10]}
    words = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)) + " " + few["l3"][0] + " end"
    looked = []
    for templates in (few, many):
        index = license_join.TemplateIndex(None, templates)
        numbers = license_join._located(index, pa.array([words]))[0]
        known = np.flatnonzero(numbers >= 0)
        found = [(t, len(m)) for t, m in index.stretches(known, numbers[known])]
        assert (3, 60) in found or (3, len(set(few["l3"][0].split()))) in found
        looked.append(sum(n for _, n in found))
    assert looked[1] <= 2 * looked[0]


def test_base_columns_of_licenses(spark):
    sql = """
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM '/root/testdata/sf0.01/documents.parquet'),
        p AS (SELECT doc_id, i - 1 AS place, CASE WHEN words[i] = 'mit' THEN 'mit' WHEN words[i] = 'apache' THEN 'apache' ELSE 'gpl' END AS label
              FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
              WHERE (words[i] IN ('mit', 'apache') AND words[i + 1] = 'license') OR (words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license'))
        SELECT w.doc_id, len(words), count(place), min(place), max(place), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
        FROM w LEFT JOIN p USING (doc_id) GROUP BY ALL"""
    want = collections.Counter(duckdb.sql(sql).fetchall())
    got = queries.op8_license_join(spark, "/root/testdata/sf0.01").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert collections.Counter(tuple(r) for r in got.collect()) == want and sum(n for *_, n, _, _, _ in want) > 0


def test_windows_of_licenses():
    index = license_join.TemplateIndex()
    rng = random.Random(5)
    for t, (_, order, need) in enumerate(index.templates):
        for _ in range(40):
            words = [rng.choice(order + [-1]) for _ in range(rng.randint(0, 150))]
            at = np.array([i for i, w in enumerate(words) if w in order], np.int64)
            found = index.wrapped(t, at, np.array([words[i] for i in at], np.int64), np.full(len(at), len(words)))
            width = index.widths[t]
            counts = [len({w for w in words[i : i + width] if w >= 0}) for i in range(len(words))]
            assert bool(found) == (max(counts, default=0) >= need)
            assert all(counts[i] == round(c * len(order)) >= need for i, c in found)
            # every window that meets the template overlaps one that is given
            assert all(any(abs(i - j) <= 2 * width for j, _ in found) for i, c in enumerate(counts) if c >= need)


# -- 9 decontamination


@pytest.mark.parametrize("block", [20_000, 3])
def test_leaks(spark, odd, none, block):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 12, 40])))) for k in range(12)] + [(50, None), (51, ""), (3, "again same id five six seven")]
    docs = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([0, 10, 300]))]
        if k % 3 == 0:
            inside = [w if rng.random() > 0.03 else "z" for w in items[rng.randrange(12)][1].split()]
            body[len(body) // 2 : len(body) // 2] = inside
        docs.append((k, " ".join(body)))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := cut(t)) else set()
    want = collections.Counter()
    for d, text in docs + ODD:
        for i, item in items:
            if (g := grams(item)) and len(g & grams(text)) >= 0.8 * len(g) - 1e-9:
                want[(d, i, len(g & grams(text)), len(g))] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = minhash_containment.find_leaks(df, table, block=block)
    assert collections.Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()) == want and want
    assert minhash_containment.find_leaks(none, table).count() == 0 and minhash_containment.find_leaks(df, table.where("false")).count() == 0
    left = minhash_containment.without_leaks(df, table)
    leaks = lambda text: any(len(g & grams(text)) >= 0.8 * len(g) - 1e-9 for _, item in items if (g := grams(item)))
    assert collections.Counter(map(tuple, left.collect())) == collections.Counter((d, t) for d, t in docs + ODD if not leaks(t))


# -- 10 URLs


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/de", "example.net", "/de", "net/", "block"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("ftp://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        ("http://x.net?q", "x.net", "", None, "allow"),
        ("http://x.com/a://b/c", "x.com", "/a://b/c", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    row = url_rules.judge_urls(pages, pages.select("url", F.lit(None).cast("boolean").alias("bad"))).first()
    assert (row.host, row.path, row["rule"], row.verdict) == (host, path, rule, verdict)


def written_out(rules):
    """Every choice of one token of each group, the surest rule first."""
    return sorted(((sorted(t), c, n) for groups, c, n in rules for t in itertools.product(*groups)), key=lambda k: (-k[1], -k[2], k[0]))


def mined(*args, **kwargs):
    return written_out(url_rules.mine_rules(*args, **kwargs))


def test_rules_of_groups(spark):
    """Segments that always come together make one rule of groups, not a rule for every choice; any member matches."""
    left, right = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    path = lambda *parts: "http://x.io/" + "/".join(p for part in parts for p in part)
    known = spark.createDataFrame([(path(left, right), True)] * 20 + [(path(left), False)] * 20 + [(path(right), False)] * 20, "url string, bad boolean")
    limits = {"support": 0.05, "confidence": 0.9, "least": 1, "sure": 0}
    rules = url_rules.mine_rules(known, "url", "bad", **limits)
    assert [[len(g) for g in groups] for groups, _, _ in rules] == [[60, 60]]
    urls = [path([a], [b]) for a, b in (("a0", "b59"), ("b3", "a7"), ("a1", "a2"), ("b1", "c1"))] + [path(left, right), "http://x.io/"]
    got = url_rules.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), known, **limits)
    assert [r.verdict for r in got.collect()] == ["block", "block", "allow", "allow", "block", "allow"]
    assert got.where("verdict = 'block'").select("mined_rule").distinct().count() == 1


def test_fired_rules_against_every_choice(spark):
    rng = random.Random(12)
    tokens = [f"t{k}" for k in range(12)]
    rules = [([rng.sample(tokens, rng.randint(1, 4)) for _ in range(rng.randint(1, 3))], 1.0, 1.0) for _ in range(25)]
    held = [rng.sample(tokens, rng.randint(0, 8)) for _ in range(60)]
    got = spark.createDataFrame([(k, h) for k, h in enumerate(held)], "k int, t array<string>").select("k", url_rules._fired(F.col("t"), rules).alias("f")).collect()
    assert {r.k: r.f for r in got} == {k: [i for i, (groups, _, _) in enumerate(rules) if any(set(c) <= set(h) for c in itertools.product(*groups))] for k, h in enumerate(held)}


def test_base_columns_of_pages(spark):
    """Host, path, rule and the rules' own verdicts of the whole table, against SQL."""
    sf = SF
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p in sorted(url_rules.RULES, key=lambda r: -len(r[0] + r[1])))
    sql = f"""WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM '{sf}/pages.parquet'),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
    SELECT page_id, host, path, CASE {fits} END AS rule FROM u"""
    rows = queries.op10_url_rules(spark, sf).collect()
    assert sorted(((r.page_id, r.host, r.path, r["rule"]) for r in rows), key=str) == sorted(duckdb.sql(sql).fetchall(), key=str)
    named = {h + p: v for (h, p), v in url_rules.RULES.items()}
    assert all(r.verdict == named[r["rule"]] for r in rows if r["rule"]) and any(r["rule"] for r in rows)


def test_mined_rules(spark):
    rows = [(f"http://spam.x.com/{k}", True) for k in range(30)] + [(f"http://good.x.com/win/{k}", False) for k in range(30)] + [(f"http://mixed{k % 3}.com/win/?buy={k}", True) for k in range(30)] + [(f"http://mixed{k % 3}.com/", False) for k in range(30)]
    known = spark.createDataFrame(rows, "url string, bad boolean")
    rules = mined(known, "url", "bad", support=0.05, confidence=0.9, least=1, sure=0)
    kept = [t for t, _, _ in rules]
    assert ["h:spam"] in kept and ["q:buy"] in kept and not any(len(t) > 1 and set(k) < set(t) for t in kept for k in kept)
    pages = spark.createDataFrame([("http://spam.x.com/new",), ("http://good.x.com/win/1",), ("http://other.com/win?buy=1",)], "url string")
    assert [r.verdict for r in url_rules.judge_urls(pages, known, support=0.05, confidence=0.9, least=1, sure=0).collect()] == ["block", "allow", "block"]


def test_chance_makes_no_rules(spark):
    rng = random.Random(6)
    rows = [(f"http://h{rng.randrange(9)}.com/{rng.choice('abcdefgh')}/{rng.randrange(1000)}?{rng.choice('xyz')}=1", rng.random() < 0.26) for _ in range(1500)]
    known = spark.createDataFrame(rows + [("http://ads.io/1", True)] * 30, "url string, bad boolean")
    assert [t for t, _, _ in mined(known, "url", "bad")] == [["h:ads"], ["h:io"], ["p:1"]] or [t for t, _, _ in mined(known, "url", "bad")] == [["h:ads"], ["h:io"]]
    odd = spark.createDataFrame([(None, "was"), ("http://ads.io/" + "x/" * 50_000, "was")], "url string, host string")
    assert [(r.host, r.verdict) for r in url_rules.judge_urls(odd, known).collect()] == [("", "allow"), ("ads.io", "block")]
    assert url_rules.judge_urls(odd.where("false"), known.where("false")).count() == 0


def test_all_tokens_are_mined_and_matched(spark):
    deep = "/".join(f"s{i}" for i in range(30))
    urls = [(f"http://x.com/{deep}?buy=1", True)] * 10 + [(f"http://x.com/{deep}", False)] * 10 + [("http://x.com/?k=1", False)] * 5
    # four tokens together are bad, any three of them as often not
    four = ["a", "b", "c", "d"]
    urls += [("http://y.org/" + "/".join(four), True)] * 12 + [("http://y.org/" + "/".join(x for x in four if x != out), False) for out in four for _ in range(12)]
    known = spark.createDataFrame(urls, "url string, bad boolean")
    rules = [t for t, _, _ in mined(known, "url", "bad", support=0.05, confidence=0.9, least=1, sure=0)]
    assert rules == [["p:a", "p:b", "p:c", "p:d"], ["q:buy"]]
    many = "/".join(f"z{i}" for i in range(20))
    pages = spark.createDataFrame([(f"http://v.edu/{many}?{'&'.join(f'k{i}=1' for i in range(20))}&buy=1",), (f"http://v.edu/{many}/d/c/b/a",), (f"http://v.edu/{many}/d/c/b",)], "url string")
    assert [r.verdict for r in url_rules.judge_urls(pages, known, support=0.05, confidence=0.9, least=1, sure=0).collect()] == ["block", "block", "allow"]


def test_tokens_always_together(spark):
    known = spark.createDataFrame([("http://x.io/p/q/r", True)] * 5 + [("http://x.io/p/q/s", False)] * 5 + [("http://u.io/r", False)] * 5, "url string, bad boolean")
    rules = [(t, c) for t, c, _ in mined(known, "url", "bad", support=0.05, confidence=0.9, least=1, sure=0)]
    assert rules == [(["h:x", "p:r"], 1.0), (["p:p", "p:r"], 1.0), (["p:q", "p:r"], 1.0)]


# -- pipeline


def test_near_duplicates_of_five_words(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:82])), (3, " ".join(base[:60]))]  # 78/96 of five words, 79/97 of four; 56/78
    for k in range(30):
        words = [f"{k}b{i}" for i in range(120)]
        rows.append((100 + 2 * k, " ".join(words)))
        for i in rng.sample(range(120), rng.randint(1, 4)):
            words[i] = "changed"
        rows.append((101 + 2 * k, " ".join(words)))
    shingles = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    linked = lambda a, b: 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    want = {d for d, _ in rows if not any(linked(d, e) for e, _ in rows if e < d)}
    df = spark.createDataFrame([(*r, "en", "test", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == want and 2 not in want and 3 in want



def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rejected = {r.doc_id for r in kneser_ney.identify_languages(spark.read.parquet(f"{SF}/documents.parquet")).where("lang_rejected").collect()}
    own = [(d.doc_id, d.text) for d in docs if d.doc_id not in rejected]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(ASCII_LOWER))
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := cut(t)) else set()
    tests = [g for g in map(grams, items) if g]
    leaked = {d for d, t in own if any(len(g & grams(t)) >= 0.8 * len(g) for g in tests)}
    firsts = {d for d, _, c in plain_components(own, 5, 80) if d == c}
    assert {r.doc_id for r in rows} == firsts - leaked and len(rejected) <= 2 and all(r.n_tokens > 0 for r in rows)


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows and clashing names pass every stage; so does an empty table."""
    import corpus_pipeline

    extra = {"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "lang_pred": F.lit("clash"), "sid": F.lit(b"clash"), "item_id": F.lit(0)}
    docs = odd.withColumns(extra).unionByName(odd.withColumns(extra))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.where("false"), SF)
        if name != "bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert none.count() == 0
        left = collections.Counter((r.doc_id, r.text) for r in out.collect()) if name != "bpe" else None
        if name == "language_id":
            assert not left  # nothing was learnt
        elif name == "ngram_jaccard_join":  # of one component the smallest id, with all its rows; a null id stays
            assert {d for d, _ in left} == {1, 2, 3, 4, 6, 7, 8, None} and left[(4, "one two")] == 4
        elif name == "decontamination":
            assert left == collections.Counter(2 * ODD)
        elif name == "bpe":
            assert out.count() == 2 * len(ODD)
