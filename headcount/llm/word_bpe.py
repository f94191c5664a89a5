"""BPE with word ends: a backtracking encoder over longest matches, a decoder over an offset table.

An Aho-Corasick automaton of the vocabulary finds the longest token at each place of a word. A token
may follow another only if the merges, applied to the two together, would leave them as they are; so
a sequence of compatible neighbours is the one that the merges make. The encoder takes the longest
token that is compatible with the last one, tries shorter prefixes else, and steps back if none is,
never to a place that it has left before: time is linear in the length of the word.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.bpe import byte_letters
from headcount.llm.shared import table, with_field

#: Pieces of text, and pairs of tokens, that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 300_000
#: Longer pieces are encoded each time.
REMEMBERED_LENGTH = 64
#: Below it no letter is changed by composition, and all Unicode versions class the letters alike.
PLAIN = "\u0250"


class Merges:
    """The tables of an ordered list of merges over symbols 0 to ``symbols`` - 1; token = symbols + place of its merge."""

    def __init__(self, symbols: int, merges: list[tuple[int, int]]):
        import ahocorasick

        self.symbols = symbols
        self.pair = {p: symbols + i for i, p in enumerate(merges)}
        self.halves = [(t, t) for t in range(symbols)] + list(merges)
        spelt = [chr(t) for t in range(symbols)]
        for a, b in merges:
            spelt.append(spelt[a] + spelt[b])
        self.length = [len(s) for s in spelt]
        self.compatible: dict[tuple[int, int], bool] = {}
        # A token that the merges never make of its own spelling is not in the automaton.
        made = [True] * symbols
        for t, (a, b) in enumerate(merges, symbols):
            made.append(made[a] and made[b] and self._stay(a, b, t))
        number = {s: t for t, s in enumerate(spelt) if made[t]}
        self.automaton = ahocorasick.Automaton()
        for s, t in number.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        self.shorter = [
            next((number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in number), -1) for s in spelt
        ]

    def _stay(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before ``limit`` joins the two sides anywhere across their border.

        The last merge of either side is undone, the later one first, until symbols face each other.
        A pair that merges across the border before the border's neighbours were made would have won.
        """
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left >= right and left >= self.symbols:
                # Made after the right one: before it, its right half stood at the border.
                limit, left = min(limit, left), self.halves[left][1]
            elif right >= self.symbols:
                # Of equal merges the left one goes first, so a merge across the border may be equal to it.
                limit, right = min(limit, right + 1), self.halves[right][0]
            else:
                return True

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand behind ``left``; remembered in the pair-compatibility table."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > REMEMBERED:
                self.compatible.clear()
            known = self.compatible[left, right] = self._stay(left, right, len(self.halves))
        return known

    def encode(self, word: str) -> list[int]:
        """The tokens of a word given as symbols (code points below ``symbols``)."""
        longest = [0] * len(word)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, token in self.automaton.iter(word):
            longest[end - length[token] + 1] = token  # ends rise, so the last one is the longest
        open_ = bytearray(b"\1") * (len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if word else 0
        while at < len(word):
            last = out[-1] if out else None
            while token >= 0:
                end = at + length[token]
                if open_[end]:
                    fits = last is None or compatible.get((last, token))
                    if fits or (fits is None and self.fit(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(word) else 0
            else:
                # Nothing goes on from here: never come here again, and take a shorter token before.
                if last is None:
                    raise ValueError("the merges reach no split of the word")
                open_[at] = 0
                at -= length[out.pop()]
                token = shorter[last]
        return out


class Codec:
    """Encodes and decodes whole texts as the vocabulary file says. One per worker and file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, merges, end = model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"]
        if model["decoder"] is not None or model["post_processor"] is not None or not end:
            raise ValueError(f"{path} is not a vocabulary with word ends and without a decoder")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        parts = model["pre_tokenizer"]["pretokenizers"]
        self.find = regex.compile(parts[0]["pattern"]["Regex"]).findall
        # Symbols: the 256 bytes, then the 256 bytes that end a word.
        letters = byte_letters()
        ids = [vocabulary[x] for x in (*letters, *(x + end for x in letters))]
        symbol = {t: i for i, t in enumerate(ids)}
        pairs = []
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((symbol[vocabulary[a]], symbol[vocabulary[b]]))
            ids.append(vocabulary[a + b])
            symbol[ids[-1]] = len(ids) - 1
        self.ids = np.array(ids, "<u4")
        self.merges = Merges(2 * len(letters), pairs)
        self.byte = {ord(x): i for i, x in enumerate(letters)}
        self.end = [chr(i + len(letters)) for i in range(len(letters))]
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        # The offset table: each token behind a space; the first space of a text is left out.
        names = {t: s for s, t in vocabulary.items()} | {t: s for s, t in special.items()}
        spelt = [(" " + names.get(t, "")).encode() for t in range(max(names) + 1)]
        self.valid = np.array([t in names for t in range(len(spelt))])
        self.sizes = np.array([len(s) for s in spelt])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(spelt), np.uint8)

    def _words(self, text: str) -> Iterator[str]:
        """The words of a text without special strings, a letter per byte below U+0100."""
        if max(text, default="") < PLAIN:
            for word in self.find(text.lower()):
                yield word if word.isascii() else word.encode().decode("latin-1")
        else:
            for word, _ in self.split(self.normalize(text)):
                yield word.translate(self.byte)

    def _piece(self, piece: str) -> bytes:
        """Ids of a run of text between spaces, as little-endian bytes."""
        out = []
        for part in self.cut.split(piece) if self.cut and "<" in piece else (piece,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            for word in self._words(part):
                ids = self.known_words.get(word)
                if ids is None:
                    ids = self.ids[self.merges.encode(word[:-1] + self.end[ord(word[-1])])].tobytes()
                    if len(word) <= REMEMBERED_LENGTH:
                        self.known_words[word] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers.

        No token, special string, contraction or composed letter reaches over a space, so the runs
        between spaces are encoded by themselves.
        """
        pieces, known = text.split(" "), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            for memory in (known, self.known_words):
                if len(memory) > REMEMBERED:
                    memory.clear()
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= REMEMBERED_LENGTH:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names with a space between two; an id outside the vocabulary raises."""
        if not len(ids):
            return b""
        if ids.max() >= len(self.valid) or not self.valid[ids].all():
            raise ValueError("token id outside the vocabulary")
        out, block = [], 1 << 20
        for i in range(0, len(ids), block):
            part = ids[i : i + block]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.joined[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[1:]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, source: str, kept: list[str], made: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    """``kept`` columns of df with the columns ``made`` of row(value of ``source``)."""
    types = [t for _, t in made.values()]
    schema = with_field(df.select(*[F.col(f"`{c}`") for c in kept]), *[(n, kind) for n, (kind, _) in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(v) for v in batch.column(0).to_pylist()]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], *made])

    return df.select(F.col(f"`{source}`").alias("__in"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the text's token ids in an array column ``ids``, which replaces a column of that name.

    A null or empty text has no ids; every text is read whole; rows that repeat are encoded alike;
    an empty table stays empty. Strings of special tokens in a text are those tokens, as the file says.
    """
    return _mapped(
        df, text, [c for c in df.columns if c != ids], {ids: ("array<int>", pa.list_(pa.int32()))},
        lambda v: (np.frombuffer(codec(path).encode(v or ""), "<u4"),),
    )


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its token ids in ``text``, which replaces a column of that name.

    A null or empty list gives an empty text; an id outside the vocabulary, or a null one, raises.
    """
    return _mapped(
        df, ids, [c for c in df.columns if c != text], {text: ("string", pa.string())},
        lambda v: (codec(path).decode(np.array(v or [], np.int64)).decode(),),
    )


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of tokens, SHA-256 of the ids (as 32-bit integers) and of the text they decode to."""

    def row(v):
        ids = codec(path).encode(v or "")
        back = codec(path).decode(np.frombuffer(ids, "<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    made = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _mapped(df, text, [key], made, row)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
