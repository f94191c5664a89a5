"""Cross-tokenizer alignment: sparse products against dense ones, links and counts against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headcount.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, a string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_tokens(libraries, text):
    """(id, end) of both sides, or nothing."""
    if not text:
        return [], []
    byte, (a, b) = byte_of(), libraries
    one = a.encode(" " + text, add_special_tokens=False)
    x = [(t, bytes(byte[c] for c in s)) for t, s in zip(one.ids, one.tokens)]
    y = []
    for t in b.encode(text):
        piece = b.id_to_piece(t)
        y.append((t, bytes([int(piece[3:5], 16)]) if b.is_byte(t) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(s for _, s in side) != whole for side in (x, y)):
        return [], []
    ends = [np.cumsum([len(s) for _, s in side]).tolist() for side in (x, y)]
    return [[(t, e) for (t, _), e in zip(side, end)] for side, end in zip((x, y), ends)]


def brute(libraries, texts):
    """The contract's rows, link by link."""
    made, count = [], Counter()
    for text in texts:
        a, b = brute_tokens(libraries, text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        of = [{e: next(c for c in cuts if c >= e) for _, e in side} for side in (a, b)] if a else [{}, {}]
        sides = []
        for side, group in zip((a, b), of):
            got = defaultdict(list)
            for t, e in side:
                got[group[e]].append(t)
            sides.append(got)
        links = [(x, y) for c in cuts for x in sides[0][c] for y in sides[1][c]]
        count.update(set(links))
        line = ";".join(",".join(map(str, sides[0][c])) + "|" + ",".join(map(str, sides[1][c])) for c in cuts)
        made.append((len(a), len(b), len(cuts), links, hashlib.sha256(line.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest)
        for na, nb, ng, links, digest in made
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    pick = random.Random(5)
    words = ["the", "naïve", "日本", "🎉", "foo\tbar", "x\n\n y", "  two", "<s>", "<|endoftext|>", "it's", "0x0A", "<0x0A>", "\x00", "\x1c b"]
    texts = [" ".join(pick.choices(words, k=pick.randrange(1, 12))) for _ in range(30)]
    return texts + ["", " ", "  ", "a ", "\n", "▁x", "a ▁ b", "x" * 3000, "ab" * 400, "é" * 300, "🎉" * 50, "don't  stop \n", "the the the"]


def test_products_equal_dense_ones(monkeypatch):
    pick = np.random.default_rng(1)
    for piece in (1, 7, 1_000_000):
        monkeypatch.setattr(align, "PIECE", piece)
        for n, k, m in ((5, 6, 4), (1, 1, 1), (8, 3, 9), (0, 3, 2)):
            dense = [pick.integers(0, 3, (n, k)), pick.integers(0, 3, (k, m))]
            rows = [align.compressed(*np.nonzero(d), d[np.nonzero(d)], *d.shape) for d in dense]
            made = align.product(*rows)
            back = np.zeros((n, m), int)
            back[made.row, made.at] = made.value
            assert (back == dense[0] @ dense[1]).all()
            assert (made.dot(np.arange(m)) == back @ np.arange(m)).all()


def test_segments_are_the_text_and_encode_as_it_does(libraries):
    own = align.tokenizers(A, B)
    for text in odd_texts():
        parts = align.segments(text)
        assert "".join(parts) == (" " + text if text else "")
        a, n_a, b, n_b, same = own.encode(parts)
        assert len(n_a) == len(n_b) == len(same) == len(parts) and (n_a.sum(), n_b.sum()) == (len(a), len(b))
        if same.all() and text:
            assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == libraries[1].encode(text)


def test_overlaps_and_groups_of_a_text(spark, libraries):
    texts = ["The naïve 日本 fox", None, "▁ is changed", "xyzzy" * 20]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS).withColumn("overlaps", F.lit(1))
    out = {r["doc_id"]: r for r in align.align(df, A, B).collect()}
    for i, text in enumerate(texts):
        a, b = brute_tokens(libraries, text)
        r = out[i]
        assert [(t["id"], t["end"]) for t in r["a"]] == a and [(t["id"], t["end"]) for t in r["b"]] == b
        starts = [[0, *[e for _, e in side]] for side in (a, b)]
        links = [
            (i, j, min(e, f) - max(s, t))
            for i, (s, (_, e)) in enumerate(zip(starts[0], a))
            for j, (t, (_, f)) in enumerate(zip(starts[1], b))
            if min(e, f) > max(s, t)
        ]
        assert [tuple(x) for x in r["overlaps"]] == links
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        for side in ("a", "b"):
            assert [t["group"] for t in r[side]] == [sum(c < t["end"] for c in cuts) for t in r[side]]
    assert align.align(df.limit(0), A, B).count() == 0


def test_odd_texts_equal_plain_loops(spark, libraries, monkeypatch):
    texts = odd_texts() + [None, "the the the", "the naïve"]
    ids = [*range(len(texts) - 2), None, 7]
    df = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], DOCS)
    want = brute(libraries, texts)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for parts in (1, 5):
        rows = align.linked(df.repartition(parts), A, B).collect()
        assert sorted(((r["id"], tuple(r[c] for c in COLUMNS)) for r in rows), key=key) == sorted(zip(ids, want), key=key)
    assert align.linked(df.limit(0), A, B).count() == 0


def test_chunks_do_not_change_figures(monkeypatch):
    own = align.tokenizers(A, B)
    texts = odd_texts()
    whole, found = align._chunk(texts, own)
    monkeypatch.setattr(align, "PIECE", 50)
    again, other = align._chunk(texts, own)
    assert whole == again and all((found[c] == other[c]).all() for c in ("a", "b", "docs"))


def test_query_equals_plain_loops(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute(libraries, [r["text"] for r in docs])))
    out = align.op11_alignment(spark, sf_dir)
    assert out.columns == ["doc_id", *COLUMNS]
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert rows == want


def test_plain_letters_are_cut_alike_by_both_libraries(libraries):
    own = align.tokenizers(A, B)
    every = [f" a{chr(i)}{chr(i)} {chr(i)}9 {chr(i)}" for i in range(0x260)] + [" don't 's 'S <|endoftext|> \x1c\x1d", " x" * 3000]
    for text, ids in zip(every, own._a(every)):
        assert ids == libraries[0].encode(text, add_special_tokens=False).ids


def test_bytes_that_a_tokenizer_changes_are_seen():
    table = align.Table([b"ab", b"c", b" "])
    raw = np.frombuffer(b"ab cxabc", np.uint8)
    same = table.spells(np.array([0, 2, 1, 1, 0, 1]), np.array([2, 2, 0, 2]), raw, np.array([3, 2, 0, 3]))
    assert same.tolist() == [True, False, True, True]
