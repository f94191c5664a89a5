"""Byte-level BPE with a sentencepiece model written from a rank file, and its inverse."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import lean, slices, table, with_field

#: Pre-tokens whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: Longer pre-tokens are encoded each time, so that the memory stays small.
REMEMBERED_LENGTH = 64


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself if printable in Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in rank order; ranks have to run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces: list[bytes] = [b""] * len(pairs)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    if not all(pieces):
        raise ValueError(f"the ranks in {path} have gaps")
    return pieces


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: length-delimited bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: byte-mapped pieces, score = -rank, id = rank.

    Normalisation is the identity: no prefix, no white space changes. The unknown piece that the
    format asks for comes after the last rank and is never produced, since all bytes are pieces.
    """
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(letters[b] for b in piece).encode()
        out += _field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    no_control = (1 << 64) - 1  # -1
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    trainer += b"".join(_field(n, no_control) for n in (41, 42, 43))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes whole texts. Made in each worker from the rank file and the pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.letters = [*byte_letters()]
        # Bytes read as Latin-1 letters, then mapped to the model's letters.
        self.to_letters = {b: letter for b, letter in enumerate(self.letters)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        self.sizes = np.array([len(p) for p in self.pieces])
        self.joined = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        tokens = self.find(text)
        if not tokens:
            return np.zeros(0, np.int32)
        known = self.known
        if missing := {t for t in tokens if t not in known}:
            if len(known) > REMEMBERED:
                known.clear()
                missing = set(tokens)
            missing = list(missing)
            mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_letters) for t in missing]
            for t, ids in zip(missing, self.processor.encode(mapped, num_threads=1)):
                known[t] = np.array(ids, np.int32).tobytes()
        out = np.frombuffer(b"".join([known[t] for t in tokens]), np.int32)
        for t in missing:
            if len(t) > REMEMBERED_LENGTH:
                del known[t]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.joined[at].tobytes()


def _columns(batches: Iterator[pa.RecordBatch], names: dict[str, pa.DataType], row) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [row(text or "") for text in batch.column(0).to_pylist()]
        made = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), names.values())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], *names])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with an array column ``ids`` of the text's tokens; a null text is an empty one.

    ``ids`` replaces a column of that name. Every pre-token is encoded by itself; the text is read
    whole, in one pass without a shuffle.
    """
    kept = [c for c in df.columns if c != ids]
    schema = with_field(df.select(*[F.col(f"`{c}`") for c in kept]), (ids, "array<int>"))

    def run(batches):
        codec = Codec(path, pattern)
        yield from _columns(batches, {ids: pa.list_(pa.int32())}, lambda t: (codec.encode(t),))

    return df.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """df with the bytes of its token ids in ``data``, which replaces a column of that name.

    A null list gives empty bytes; an id outside the vocabulary raises.
    """
    kept = [c for c in df.columns if c != data]
    schema = with_field(df.select(*[F.col(f"`{c}`") for c in kept]), (data, "binary"))

    def run(batches):
        pieces = read_ranks(path)
        yield from _columns(batches, {data: pa.binary()}, lambda x: (b"".join(pieces[i] for i in x or ()),))

    return df.select(F.col(f"`{ids}`").alias("__ids"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(lean(run), schema)


def digests(
    df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: key, number of tokens, SHA-256 of the ids and of the bytes they decode to, columns to keep."""

    def run(batches):
        codec = Codec(path, pattern)

        def row(t):
            ids = codec.encode(t)
            line = " ".join(map(str, ids.tolist()))
            return (
                len(ids),
                hashlib.sha256(line.encode()).hexdigest(),
                hashlib.sha256(codec.decode(ids)).hexdigest(),
            )

        yield from _columns(
            batches, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, row
        )

    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    schema = with_field(df.select(key, *keep), *made)
    out = df.select(F.col(f"`{text}`").alias("__text"), key, *keep).mapInArrow(lean(run), schema)
    return out.select(key, *[name for name, _ in made], *keep)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
