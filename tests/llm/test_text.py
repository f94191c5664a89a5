"""Quality, personal data, tokens, near-duplicates, mixing: small cases and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from headcount.llm import bpe, components, minhash, mixing, pii, quality, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
LONG = "word " * 40_000 + "x" * 50_000


def rows(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_broadcast_depends_on_rows_and_bytes(spark, monkeypatch):
    def hinted(df, *limit):
        return "ResolvedHint" in shared.by_size(df, *limit)._jdf.queryExecution().analyzed().toString()

    narrow = spark.range(100)
    wide = spark.range(3).selectExpr("id", "repeat('x', 1000) AS text", "array(named_struct('b', CAST('y' AS BINARY))) AS a")
    assert hinted(narrow) and hinted(wide) and not hinted(narrow, 99)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 2000)
    assert not hinted(wide) and hinted(narrow)
    assert not hinted(wide.limit(2)) and hinted(wide.limit(1))


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def expected_digest(reference, text):
    ids = reference.encode_ordinary(text or "")
    line = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_tokens_equal_the_reference_library(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = bpe.op5_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected_digest(reference, texts[r["doc_id"]])


def test_tokens_of_odd_texts(spark, reference):
    texts = [None, "", " ", "\n\n \t x", "<unk> ▁▁ <s> <|endoftext|>", "ĀĠhello", "日本語 🎉👩‍👩‍👧\x00\x7f", "a" * 30_000, " " * 9_000, LONG]
    texts += texts[5:7]
    got = {r[0]: r for r in bpe.digests(rows(spark, texts), *bpe.public_vocabulary()).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][1:]) == expected_digest(reference, t)
    assert bpe.digests(empty(spark), *bpe.public_vocabulary()).count() == 0


def test_encode_then_decode_keeps_other_columns(spark):
    docs = rows(spark, ["It's 42 times", None, ""]).withColumn("ids", F.lit("clash")).withColumn("data", F.lit(1))
    path, pattern = bpe.public_vocabulary()
    back = bpe.decode(bpe.encode(docs, path, pattern), path)
    assert back.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "data"]
    assert [bytes(r["data"]) for r in back.orderBy("doc_id").collect()] == [b"It's 42 times", b"", b""]


def test_model_scores_are_negative_ranks():
    import sentencepiece

    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.model_bytes(pieces))
    assert [model.get_score(i) for i in (0, 256, 257)] == [0.0, -256.0, -257.0]
    assert model.encode("abcab") == [257, 256]


# MinHash near-duplicates


def word_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(texts, percent=85):
    sets = word_sets(texts)
    label = {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def check_near(spark, df, texts, percent=85):
    got = {r["id"]: r for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == brute_components(texts, percent)
    assert all(r["kept"] == (i is None or r["component_id"] == i) for i, r in got.items())


def near_copies(seed, groups=12, members=8):
    """Texts and copies with a few words changed, whose similarity lies around the threshold."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for _ in range(groups):
        base = pick.choices(words, k=pick.randrange(30, 160))
        for _ in range(members):
            copy = base[:]
            for _ in range(pick.randrange(0, 4)):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = near_copies(seed)
    texts |= {len(texts) + i: t for i, t in enumerate([None, "", " \n", "One two", "one  TWO", "a b c d e", LONG, LONG + " y", "É é", "é É"])}
    check_near(spark, rows(spark, texts.values()), texts)


def test_near_duplicates_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_near(spark, docs, {r["doc_id"]: r["text"] for r in docs.collect()})


def test_large_buckets_and_families(spark, monkeypatch):
    for name in ("SIGNATURES", "SETS", "SMALL"):
        monkeypatch.setattr(minhash, name, 8)
    texts = near_copies(5, groups=2, members=60)
    check_near(spark, rows(spark, texts.values()), texts)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    texts = ["a b c d e f", "a b c d e f", None]
    docs = rows(spark, texts).unionByName(rows(spark, texts)).withColumn("id", F.lit("x")).withColumn("sig", F.lit(1))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (2, True), None: (None, True)}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {0: 2, 2: 2, None: 1}


SIMILARITIES = (70, 80, 85, 95)


@pytest.mark.parametrize("percent", SIMILARITIES)
def test_pigeonhole_keys_meet_within_the_distance(percent):
    pick, own = np.random.default_rng(3), minhash.scheme(percent)
    for _ in range(200):
        a = pick.integers(0, 1 << 16, own.symbols).astype(np.uint16)
        b = a.copy()
        b[pick.choice(own.symbols, own.distance, replace=False)] += 1
        keys = minhash.chunk_keys(np.stack([a, b]), own)
        assert np.intersect1d(keys[0], keys[1]).size


@pytest.mark.parametrize("percent", SIMILARITIES)
def test_few_pairs_are_missed_right_at_the_threshold(percent):
    """Sets whose similarity is the threshold exactly: less than one in a thousand lies beyond the distance."""
    pick, own = np.random.default_rng(percent), minhash.scheme(percent)
    assert own.miss(percent) <= minhash.MISS and own.symbols <= minhash.SYMBOLS
    pairs, missed = 6000, 0
    for _ in range(pairs):
        both = pick.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
        common, rest = both[: 2 * percent], both[2 * percent :]
        half = len(rest) // 2
        a, b = (minhash.signature(np.concatenate([common, x]), own.symbols) for x in (rest[:half], rest[half:]))
        missed += (a != b).sum() > own.distance
    assert missed < pairs / 1000


def test_schemes():
    assert (minhash.scheme(85).chunk, minhash.scheme(85).chunks, minhash.scheme(85).distance) == (6, 11, 21)
    assert minhash.scheme(100).symbols < minhash.scheme(90).symbols < minhash.scheme(85).symbols
    for percent in (0, 2, 101):
        with pytest.raises(ValueError):
            minhash.scheme(percent)


@pytest.mark.parametrize("percent", [70, 80])
def test_lower_similarities_equal_brute_force(spark, percent):
    texts = near_copies(7, groups=10, members=10)
    check_near(spark, rows(spark, texts.values()), texts, percent)
    kept = {r["doc_id"] for r in minhash.keep_one(rows(spark, texts.values()), percent=percent).collect()}
    assert kept == {i for i, (_, first) in brute_components(texts, percent).items() if i == first}


def test_shingles_do_not_depend_on_their_neighbours():
    texts = ["a b c d e f a b c d e", None, " A  b\x0bc D e f ", "", "x" * 200_000, "one two", *near_copies(3).values()]
    alone = [next(minhash.shingle_sets([t])) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(alone, minhash.shingle_sets(texts)))
    assert [len(s) for s in alone[:6]] == [6, 0, 2, 0, 1, 1]
    assert [len(s) for s in alone[6:]] == [len(s) for s in word_sets(near_copies(3)).values()]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(300, 340))}


# Personal data


def brute_spans(text):
    """The contract's patterns as written, applied from left to right."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            digits = [int(c) for c in re.findall("[0-9]", m[0])]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 16 <= len(digits) <= 19 and doubled % 10 == 0,  # noqa: B023
                "phone": lambda: 8 <= len(digits) <= 15,  # noqa: B023
            }
            if fits[kind]():
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    pick = random.Random(4)
    cases = ["a@b.c@d.e", "x.@y-.z..w", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111 1111 1111-0", "+1 (234) 555-6789  ", "é@a.b ü+12-345 678 90"]
    alphabets = ["ab.@-+1", "0123456789 -.", "+(). 0123", "a@.b c", "0147 258-36.9+@x"]
    for _ in range(4000):
        cases.append("".join(pick.choices(pick.choice(alphabets), k=pick.randrange(1, 60))))
    for text in cases:
        assert pii.base_spans(text) == brute_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("x " + "0" * 5000 + "1.2.3.4 " + "0" * 9000 + ".0.00.256", "a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" + "-" * 300_000, "a.b" * 100_000 + "@", "@" * 200_000):
        pii.base_spans(text)


def test_zeros_before_an_address_are_no_matter():
    assert pii.base_spans("x " + "0" * 5000 + "1.2.3.4 y") == [("ip", 2, 5009)]
    assert pii.base_spans("1.2.3." + "0" * 5000 + "256 0.0.0.0") == [("ip", 5010, 5017)]


def test_terms_of_the_table_equal_brute_force(spark, sf_dir):
    """The disclosing spans of whole documents, against every pair of an entity and a word."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_terms(texts, pii.THRESHOLD, pii.CONTEXTS)
    for r in pii.op4_pii(spark, sf_dir).collect():
        terms = [s for s in r["spans"].split(",") if s.startswith("term:")]
        assert terms == [f"term:{a}:{b}" for a, b in want[r["doc_id"]]]


def shared_address(spark, n):
    """One address in a third of n texts, each with words of its own and of others."""
    pick = random.Random(n)
    texts = []
    for i in range(n):
        words = [f"own{i}x{k}" for k in range(20)] + pick.choices([f"c{k}" for k in range(200)], k=30)
        texts.append(" ".join(words[:25] + (["desk", "sales@mail.example"] if i % 3 == 0 else []) + words[25:]))
    return texts


def test_work_on_a_shared_address_is_in_proportion(spark, monkeypatch):
    rows_made = []
    for n in (300, 1200):
        seen = []
        keep = pii.cut
        monkeypatch.setattr(pii, "cut", lambda df: (out := keep(df), seen.append(out.count()))[0])
        texts = shared_address(spark, n)
        got = {r["id"]: r["terms"] for r in pii.find(rows(spark, texts)).collect()}
        monkeypatch.setattr(pii, "cut", keep)
        rows_made.append(sum(seen))
        want = brute_terms(dict(enumerate(texts)), pii.THRESHOLD, pii.CONTEXTS)
        assert {i: [tuple(map(int, x.split(":")[1:])) for x in t.split(",") if x] for i, t in got.items()} == want
        assert any(want.values())
    assert rows_made[1] < 5 * rows_made[0]


def test_small_chunks_and_many_entities(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 200)
    pick = random.Random(12)
    mails = [f"m{i}@mail.example" for i in range(12)]
    texts = {}
    for i in range(90):
        own = pick.sample(range(12), pick.randrange(0, 4))
        texts[i] = " ".join([*(f"w{k % 5} {mails[k]} z{k}" for k in own), *pick.choices([f"c{k}" for k in range(25)], k=12)])
    texts[90] = texts[91] = texts[0]
    want = brute_terms(texts, pii.THRESHOLD, pii.CONTEXTS)
    got = {r["id"]: r["terms"] for r in pii.find(rows(spark, texts.values()).repartition(4)).collect()}
    assert {i: [tuple(map(int, x.split(":")[1:])) for x in t.split(",") if x] for i, t in got.items()} == want


def test_null_and_repeated_ids_are_sanitised_by_their_text(spark):
    texts = [f"desk{i} q@mail.example z{i % 2}" for i in range(6)] + ["plain"] * 30
    df = spark.createDataFrame([(None if i % 2 else 7, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    clean = [r["text"] for r in pii.sanitise(df).collect()]
    assert len(clean) == 36 and clean.count("plain") == 30 and all("@" not in t for t in clean)


def test_pii_of_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op4_pii(spark, sf_dir).collect():
        want = brute_spans(texts[r["doc_id"]] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == [s for s in line.split(",") if s]


def near_words(text):
    """(entity, word, start, end, text) of each entity and each word outside every span."""
    spans = pii.base_spans(text)
    entities = {pii._entity(kind, text[a:b]) for kind, a, b in spans}
    return [(e, w, x, y, text) for e in entities for w, x, y in pii.free_words(text, spans)]


def brute_terms(texts, threshold, contexts):
    near = {i: near_words(t or "") for i, t in texts.items()}
    n_term = Counter(w for t in texts.values() for w in set(re.findall(r"[^\W_]+", (t or "").lower())))
    around, both, entity = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, found in near.items():
        for e, w, _, _, a in found:
            around[e, w].add(a)
            both[e, w].add(i)
            entity[e].add(i)
    total = len(texts)

    def discloses(e, w):
        content = np.log(total / len(entity[e]))
        pmi = np.log(total * len(both[e, w]) / (n_term[w] * len(entity[e])))
        return len(around[e, w]) >= contexts and content > 0 and pmi >= threshold * content

    return {i: sorted({(a, b) for e, w, a, b, _ in found if discloses(e, w)}) for i, found in near.items()}


def test_terms_that_disclose(spark):
    pick = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    texts = {}
    for i in range(60):
        line = pick.choices(common, k=30)
        if i % 6 == 0:
            line[10:10] = ["Zorbax", pick.choice(common), "zed@mail.example", pick.choice(common)]
        if i % 6 == 1:
            line[10:10] = ["c1", "10.1.2.3"]
        texts[i] = " ".join(line)
    got = {r["id"]: r["terms"] for r in pii.find(rows(spark, texts.values())).collect()}
    want = brute_terms(texts, pii.THRESHOLD, pii.CONTEXTS)
    assert {i: [tuple(map(int, x.split(":")[1:])) for x in t.split(",") if x] for i, t in got.items()} == want
    assert all(texts[0][a:b] == "Zorbax" for a, b in want[0]) and want[0]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(rows(spark, texts.values())).collect()}
    assert "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and "Zorbax" not in clean[0]
    assert "10.1.2.3" not in clean[1] and "c1" in clean[1]
    assert clean[2] == texts[2]


def test_copies_are_one_context(spark):
    texts = ["rare words near zed@mail.example stay here"] * 20 + ["plain"] * 20 + [None, "", LONG]
    found = pii.find(rows(spark, texts).withColumn("id", F.lit(1)).withColumn("mark", F.lit("x")))
    assert {r["terms"] for r in found.collect()} == {""}
    assert found.count() == len(texts)
    clean = pii.sanitise(rows(spark, texts).withColumn("id", F.lit(1))).orderBy("doc_id").collect()
    assert [clean[i]["text"] for i in (0, 20, 40, 41)] == ["rare words near [EMAIL] stay here", "plain", None, ""]
    assert pii.find(empty(spark)).count() == 0 and pii.sanitise(empty(spark)).count() == 0


def test_terms_far_from_the_entity_are_found_and_replaced(spark):
    pick = random.Random(8)
    filler = [f"c{i}" for i in range(30)]
    texts = [" ".join(["Zorbax", *pick.choices(filler, k=20), "zed@mail.example", *pick.choices(filler, k=40), "zorbax"]) for _ in range(5)]
    texts += [" ".join(pick.choices(filler, k=60)) for _ in range(55)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(rows(spark, texts)).collect()}
    assert all("orbax" not in clean[i] and clean[i].count("[TERM]") == 2 for i in range(5))
    assert clean[9] == texts[9]


def test_a_signature_in_different_texts_discloses(spark):
    pick = random.Random(9)
    filler = [f"c{i}" for i in range(30)]
    texts = [" ".join([*pick.choices(filler, k=20), "Kind regards Jane Doe jane@x.example"]) for _ in range(5)]
    texts += [" ".join(pick.choices(filler, k=60)) for _ in range(55)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(rows(spark, texts)).collect()}
    assert not any("Jane" in clean[i] for i in range(5)) and clean[9] == texts[9]


def test_overlapping_spans_are_replaced_once():
    text = "+1 (234) 4111111111111111 x"
    assert pii.replaced(text, [("card", 9, 25), ("phone", 0, 20)]) == "[PHONE] x"


# Quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("half", F.abs(F.xxhash64("doc_id", F.lit(99))) % 2)
    judged = quality.judge(docs, labels.where("half = 0").drop("half"))
    assert judged.count() == docs.count()
    test = judged.join(labels.where("half = 1"), F.col("id") == F.col("doc_id"))
    r = test.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert r[0] > 0.99 and r[1] > 0.995


def test_posteriors_equal_a_plain_calculation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality.op2_quality(spark, sf_dir).withColumnRenamed("doc_id", "id").join(docs.withColumnRenamed("doc_id", "id"), "id").toPandas()
    rate = (got.evidence.sum() + 1) / (len(got) + 2)

    def strength(n, r, prior):
        share = ((n * (r - prior) ** 2).sum() - (prior * (1 - prior)).sum()) / ((n - 1) * prior * (1 - prior)).sum()
        return min(1e6, max(1, 1 / share - 1)) if share > 0 else 1e6

    host = got.groupby("source").evidence.agg(["size", "sum"])
    w = strength(host["size"], host["sum"] / host["size"], 0 * host["size"] + rate)
    host["rate"] = (host["sum"] + w * rate) / (host["size"] + w)
    path = got.groupby(["source", "lang"]).evidence.agg(["size", "sum"])
    prior = path.index.get_level_values(0).map(host["rate"])
    prior = path["size"] * 0 + np.array(prior)
    w = strength(path["size"], path["sum"] / path["size"], prior)
    path["rate"] = (path["sum"] + w * prior) / (path["size"] + w)
    want = np.array([path.loc[(s, x), "rate"] for s, x in zip(got.source, got.lang)])
    assert np.allclose(got.path_rate, want) and np.allclose(got.host_rate, got.source.map(host["rate"]))
    odds = np.log(got.evidence / (1 - got.evidence)) + np.log(want / (1 - want)) - np.log(rate / (1 - rate))
    assert np.allclose(got.posterior, 1 / (1 + np.exp(-odds))) and (got.kept == (got.posterior >= 0.5)).all()


def test_a_sparse_site_moves_less(spark):
    spread = [(i, "a" if i < 400 else f"b{i}", "x", 2.0 if i % 10 else -4.0) for i in range(800)] + [(900 + i, "bad", "x", -4.0) for i in range(300)]
    spread += [(2000, "one", "x", -4.0)]
    r = spark.createDataFrame(spread, "id long, __host string, __path string, __odds double")
    got = {x["__host"]: x["path_rate"] for x in quality.site_posteriors(r).collect()}
    assert got["bad"] < got["one"] < got["a"]


def test_quality_of_odd_tables(spark):
    texts = [None, "", "Plain words in a row.", "Plain words in a row.", LONG, "A | B | C"]
    docs = rows(spark, texts).withColumn("source", F.when(F.col("doc_id") > 1, F.col("source"))).withColumn("evidence", F.lit(1))
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (5, 0, None), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == len(texts)
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.judge(docs, labels.limit(0))
    assert none.count() == len(texts) and none.where("kept").count() == len(texts)
    assert quality.judge(empty(spark), labels).count() == 0 and quality.keep_good(empty(spark), labels).count() == 0


# Mixing


def earliest_deadline_first(parts):
    frame, taken, order = sum(parts), [0] * len(parts), []
    for t in range(frame):
        free = [(-(-(j + 1) * frame // a), i) for i, (j, a) in enumerate(zip(taken, parts)) if j * frame // a <= t]
        order.append(min(free)[1])
        taken[order[-1]] += 1
    return order


def test_schedule_is_earliest_deadline_first(spark):
    for parts in ([1], [9, 1], [50, 10, 10, 10, 10, 10], [7, 5, 3, 2, 1, 1], [1] * 13):
        packed = spark.createDataFrame([(parts, sum(parts))], "parts array<long>, frame long")
        got = [r["i"] for r in mixing.schedule(packed).orderBy("at").collect()]
        assert got == earliest_deadline_first(parts)


def test_shares_hold_to_less_than_a_block(spark):
    sizes = {"a": 900, "b": 300, "c": 240, "d": 60}
    docs = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(docs, "doc_id long, source string")
    targets = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.5), ("d", 0.5)], "source string, weight double")
    got = mixing.mix(df, targets, block=4, frame=20).toPandas()
    assert len(got) == len(docs) and got.groupby("doc_id").size().max() == 1
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    inside = got[got.mixed].sort_values(["slot", "place"])
    assert len(inside) == 4 * (inside.slot.max() + 1) > 0
    for s, share in {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}.items():
        seen = (inside.source == s).to_numpy()[::-1].cumsum()[::-1]
        first = (inside.source == s).cumsum().to_numpy()
        n = np.arange(1, len(inside) + 1)
        assert (np.abs(first - share * n)[3::4] < 4).all() and seen[0] == first[-1]


def test_mixing_has_no_python(spark, sf_dir):
    plan = mixing.op9_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_mixing_of_odd_tables(spark):
    texts = [None, "", "x", "x", LONG]
    docs = rows(spark, texts)
    docs = docs.unionByName(docs).withColumn("source", F.when(F.col("doc_id") != 1, F.col("source")))
    docs = docs.withColumn("slot", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("i", F.lit(2)).withColumn("parts", F.lit(3))
    assert mixing.mix(docs, most=1).count() == 10
    ordered = mixing.in_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == 10
    assert mixing.mix(empty(spark)).count() == 0 and mixing.in_order(empty(spark)).count() == 0


def test_many_groups_give_the_ranks_of_one(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    one = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "GROUP", 4)
    assert {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(df).collect()} == one


def off_target(got, weights, block):
    """The largest difference of a source's blocks from its exact share, after each slot before the mixed rows end."""
    inside = got[got.mixed]
    slots = inside.drop_duplicates(["source", "block"]).sort_values("slot")
    assert (slots.slot.to_numpy() == np.arange(len(slots))).all() and len(inside) == block * len(slots)
    n = np.arange(1, len(slots) + 1)
    return {s: np.abs((slots.source == s).cumsum().to_numpy() - w / sum(weights.values()) * n).max() for s, w in weights.items()}


def test_no_drift_from_weights_that_do_not_divide_the_frame(spark):
    weights = {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3 - 0.0001, "d": 0.0001} | {f"e{i}": 0.0003 for i in range(5)}
    df = spark.range(84_000).selectExpr("id AS doc_id", "CASE WHEN id < 81000 THEN array('a', 'b', 'c')[id % 3] WHEN id < 81500 THEN 'd' ELSE concat('e', id % 5) END AS source")
    got = mixing.mix(df, spark.createDataFrame(list(weights.items()), "source string, weight double"), block=2).toPandas()
    assert len(got) == 84_000 and ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    assert got.groupby("slot").size().max() == 2 and got[got.mixed].slot.max() > 30_000
    assert max(off_target(got, weights, 2).values()) < 2


def test_small_sources_keep_weights_of_their_own(spark):
    weights = {f"s{i:02}": 1.0 + i % 4 for i in range(60)}
    df = spark.range(60 * 90).selectExpr("id AS doc_id", "format_string('s%02d', id % 60) AS source")
    targets = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = mixing.mix(df, targets, block=1, most=4).toPandas()
    assert len(got) == got.doc_id.nunique() == got.slot.nunique() == 60 * 90
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    assert max(off_target(got, weights, 1).values()) < 3
    equal = mixing.mix(df, block=1, most=4).toPandas()
    assert max(off_target(equal, dict.fromkeys(weights, 1.0), 1).values()) < 3


def test_targets_are_one_positive_weight_for_each_source(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS STRING) AS source")
    schema = "source string, weight double"
    for bad in ([("0", 1.0), ("0", 1.0)], [("0", 0.0), ("1", 1.0)], [("0", -1.0)], [("0", None)], [(None, 1.0)], [("0", float("nan"))]):
        with pytest.raises(ValueError):
            mixing.mix(docs, spark.createDataFrame(bad, schema))
    assert mixing.mix(docs, spark.createDataFrame([("0", 1.0), ("9", 2.0)], schema), block=4).count() == 40


def test_the_fit_collects_one_row_for_each_labelled_document(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id % 400 AS doc_id", "concat('word ', id, ' more words of it') AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    sizes = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (found := collect(df), sizes.append(len(found)))[0])
    whole = quality.fit(docs, labels)
    some = quality.fit(docs, labels, most=200)
    assert sizes[0] == 400 and 80 < sizes[1] <= 200 and len(whole) == len(some)
    assert (quality.fit(docs, labels, most=200) == some).all()
