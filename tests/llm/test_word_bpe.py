"""BPE with word ends, against the tokenizers library and against merging step by step."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headcount.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t ", "Hello WORLD's it's 'tis", "a<|endoftext|>b <|startoftext|> C\x00 ÀÉ ŒΣΣ <|endoftext", "x" * 20_000, "ab" * 3000,
    "日本語 🎉👩‍👩‍👧\x00\x7f", "é ́x à́ İ", "\x1c\x85a b　c", "word " * 20_000 + "y" * 9_000, "</w> i</w>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    text = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def merged(merges, symbols, word):
    """Merges applied one by one: the first in their order, the leftmost place first."""
    rank = {p: i for i, p in enumerate(merges)}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]
        if not found:
            return word
        r, i = min(found)
        word = [*word[:i], symbols + r, *word[i + 2 :]]


def test_any_order_of_merges_is_exact():
    """Small random vocabularies, among them merges whose tokens the merges themselves never make."""
    pick = random.Random(3)
    unreachable = 0
    for _ in range(150):
        symbols, merges = 3, []
        spelt = [(i,) for i in range(symbols)]
        for _ in range(pick.randrange(1, 14)):
            p = (pick.randrange(len(spelt)), pick.randrange(len(spelt)))
            if (joined := spelt[p[0]] + spelt[p[1]]) not in spelt:
                merges.append(p)
                spelt.append(joined)
        own = word_bpe.Merges(symbols, merges)
        unreachable += len(spelt) - len(own.automaton)
        for _ in range(40):
            word = [pick.randrange(symbols) for _ in range(pick.randrange(1, 25))]
            assert own.encode("".join(map(chr, word))) == merged(merges, symbols, word), (merges, word)
    assert unreachable


def test_time_is_linear_in_the_word():
    own = word_bpe.codec(PATH).merges
    steps = []
    own_fit = word_bpe.Merges.fit
    for n in (2_000, 20_000):
        own.compatible.clear()
        count = [0]
        own.fit = lambda a, b, c=count: (c.__setitem__(0, c[0] + 1), own_fit(own, a, b))[1]
        ids = own.encode("ab" * n)
        steps.append(len(ids))
        assert count[0] < 5_000  # pairs are looked up in the table
    del own.fit
    assert abs(steps[1] - 10 * steps[0]) < 100


def test_odd_texts_equal_the_library(spark, library):
    schema = "doc_id long, text string, n_tokens string"
    df = spark.createDataFrame([*((i, t, "clash") for i, t in enumerate(ODD)), (None, "a b", ""), (4, ODD[4], "")], schema)
    rows = word_bpe.digests(df, PATH).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert tuple(r[1:]) == expected(library, "a b" if r[0] is None else ODD[r[0]])
    assert word_bpe.digests(df.limit(0), PATH).count() == 0


def test_every_code_point_equals_the_library(library):
    own = word_bpe.codec(PATH)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(letters), 1009):
        text = "a".join(letters[i : i + 1009])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for i in range(0x3000):
        text = f"x{chr(i)}{chr(i)} {chr(i)}9"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = word_bpe.op12_word_bpe(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[1:]) == expected(library, texts[r[0]])


def test_memory_is_bounded_and_encode_decode_keep_columns(spark, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    own = word_bpe.Codec(PATH)
    for text in ("one two three four five", "six seven", "one two"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 3 + 5
    df = spark.createDataFrame([(1, "It's 42", "x"), (2, None, "y")], "id long, text string, ids string").withColumn("decoded", F.lit(0))
    back = word_bpe.decode(word_bpe.encode(df, PATH), PATH)
    assert back.columns == ["id", "text", "ids", "decoded"]
    assert [r["decoded"] for r in back.orderBy("id").collect()] == [library.decode(library.encode("It's 42", add_special_tokens=False).ids), ""]
    with pytest.raises(ValueError):
        own.decode(np.array([60_000]))
