"""Cross-tokenizer alignment by sparse products of incidence matrices.

Two tokenizers cut the same bytes. With A the matrix of the first one's tokens by bytes and B that of
the second one's, the rows of A B' hold the bytes that two tokens share: overlap links. Where a pair
ends at one byte the text falls into groups; with the matrices of tokens by groups the same product
gives the links of tokens that share a group. Matrices are compressed sparse rows (CSR) made here,
products go row by row as Gustavson's do.

Both tokenizers cut at a space behind something else than white space, so a text is a list of
segments whose alignment depends on nothing else. Each different segment of a chunk of texts is
aligned once, and a text's figures are rows of the product of texts by segments and segments by
pairs. How many texts hold a pair is counted over the corpus by pair; what goes back to a chunk is
the counts of its own pairs.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.bpe import byte_letters
from headcount.llm.shared import cut, table, with_field
from headcount.llm.word_bpe import PLAIN

#: Code points of text whose segments are aligned together; a longer text is a chunk by itself.
CHUNK = 4_000_000
#: Products are expanded in pieces of about this many entries.
PIECE = 1_000_000
#: Segments given to the tokenizers at once.
TOGETHER = 2_000
#: A space behind something that is white space to nobody, with all up to the next one.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


@dataclass(frozen=True)
class Rows:
    """A sparse matrix in compressed rows: row i has the columns ``at[start[i]:start[i + 1]]`` with their values."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def dot(self, x: np.ndarray) -> np.ndarray:
        """Product with a vector."""
        sums = np.concatenate([[0], np.cumsum(self.value * x[self.at])])
        return sums[self.start[1:]] - sums[self.start[:-1]]


def compressed(row: np.ndarray, at: np.ndarray, value: np.ndarray, height: int, width: int) -> Rows:
    """Rows from entries in any order; entries of one place are added."""
    key = row.astype(np.int64) * width + at
    if len(key) > 1 and not (key[1:] > key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, value = key[first], np.add.reduceat(value, first)
    row, at = np.divmod(key, max(width, 1))
    return Rows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=height))]), at, value, width)


def transposed(m: Rows) -> Rows:
    return compressed(m.at, m.row, m.value, m.width, len(m))


def product(a: Rows, b: Rows) -> Rows:
    """a b, Gustavson's way: row i is the sum of b's rows at the columns of a's row i, times their values.

    Rows are taken in pieces of about PIECE expanded entries, so memory follows the result.
    """
    sizes = np.diff(b.start)
    grown = np.concatenate([[0], np.cumsum(sizes[a.at])])[a.start]
    parts, row = [], 0
    while row < len(a):
        end = max(int(np.searchsorted(grown, grown[row] + PIECE, "right")) - 1, row + 1)
        entries = np.arange(a.start[row], a.start[end])
        n = sizes[a.at[entries]]
        of = np.repeat(entries, n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = b.start[a.at[of]] + inside
        own = np.repeat(np.arange(end - row), np.diff(a.start[row : end + 1]))
        parts.append(compressed(np.repeat(own, n), b.at[place], a.value[of] * b.value[place], end - row, b.width))
        row = end
    if not parts:
        return Rows(np.zeros(len(a) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b.width)
    starts = np.cumsum([0] + [len(p.at) for p in parts])
    start = np.concatenate([[0], *(p.start[1:] + s for p, s in zip(parts, starts))])
    return Rows(start, np.concatenate([p.at for p in parts]), np.concatenate([p.value for p in parts]), b.width)


def by_bytes(sizes: np.ndarray) -> Rows:
    """Tokens of these sizes, in order, by the bytes that they cover."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    return Rows(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))


def groups(overlap: Rows, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, from the overlap links.

    The last link of a row is the token that holds the row's last byte; if both end there a group does.
    """
    last = overlap.at[overlap.start[1:] - 1]
    closes = ends_a == ends_b[last]
    of_a = np.cumsum(closes) - closes
    closes_b = np.zeros(len(ends_b), np.int64)
    closes_b[last[closes]] = 1
    return of_a, np.cumsum(closes_b) - closes_b


def incidence(ids: np.ndarray, group: np.ndarray, n_groups: int, width: int) -> Rows:
    """Groups by token ids, with the number of occurrences."""
    return compressed(group, ids, np.ones(len(ids), np.int64), n_groups, width)


class Table:
    """The bytes of each token behind one another, and where they are."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these tokens."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.joined[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def spells(self, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of segments with n tokens each and ``sizes`` bytes of raw, whether the tokens' bytes are those."""
        made = np.diff(np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(n)])])
        same = made == sizes
        wrong = np.cumsum(np.concatenate([[0], self.text(ids[np.repeat(same, n)]) != raw[np.repeat(same, sizes)]]))
        ends = np.cumsum(sizes[same])
        same[same] = wrong[ends] == wrong[ends - sizes[same]]
        return same


class Tokenizers:
    """The two tokenizers, with the bytes of each token. One per worker and pair of files."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = {ord(x): i for i, x in enumerate(byte_letters())}
        ranks = {s.translate(byte).encode("latin-1"): t for s, t in vocabulary.items()}
        # The same vocabulary in a faster library, for letters that both class alike.
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        of = {t: s for s, t in ranks.items()}
        self.table_a = Table([of.get(t, b"") for t in range(max(of) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(t) for t in range(self.b.get_piece_size())]
        self.table_b = Table(
            [bytes([int(s[3:5], 16)]) if self.b.is_byte(t) else s.replace("▁", " ").encode() for t, s in enumerate(pieces)]
        )
        self.space = self.b.piece_to_id("▁")
        self.sizes_a, self.sizes_b = self.table_a.sizes, self.table_b.sizes

    def _a(self, segments: list[str]) -> list[list[int]]:
        plain = self.plain.encode_ordinary
        return [plain(s) if max(s) < PLAIN else self.a.encode(s, add_special_tokens=False).ids for s in segments]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and number of tokens of A, those of B, for segments that start with a space; whether both have its bytes."""
        parts = [[np.zeros(0, np.int64)] for _ in range(5)]
        for i in range(0, len(segments), TOGETHER):
            some = segments[i : i + TOGETHER]
            raw = [s.encode() for s in some]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            raw, same = np.frombuffer(b"".join(raw), np.uint8), True
            # B adds the first space itself, but not to an empty text.
            sides = self._a(some), [ids or [self.space] for ids in self.b.encode([s[1:] for s in some], num_threads=1)]
            for k, (side, table) in enumerate(zip(sides, (self.table_a, self.table_b))):
                n = np.fromiter(map(len, side), np.int64, len(side))
                ids = np.fromiter(chain.from_iterable(side), np.int64, int(n.sum()))
                same = same & table.spells(ids, n, raw, sizes)
                parts[2 * k].append(ids)
                parts[2 * k + 1].append(n)
            parts[4].append(same)
        return tuple(np.concatenate(x) for x in parts)


@functools.cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def segments(text: str) -> list[str]:
    """The segments of a space and the text; none for an empty text."""
    return SEGMENT.findall(" " + text) if text else []


@dataclass(frozen=True)
class Aligned:
    """Segments one behind the other: their tokens, where each segment's start, and what links them.

    A segment whose bytes one of the tokenizers changes is not ``same`` and has no tokens here.
    """

    ids_a: np.ndarray
    ids_b: np.ndarray
    start_a: np.ndarray
    start_b: np.ndarray
    start_group: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    same: np.ndarray
    overlap: Rows


def align_segments(texts: list[str], own: Tokenizers) -> Aligned:
    """All segments as one block-diagonal product: a segment ends both a token of A and one of B."""
    ids_a, n_a, ids_b, n_b, same = own.encode(texts)
    same = same.astype(bool)
    ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
    start_a, start_b = (np.concatenate([[0], np.cumsum(n * same)]) for n in (n_a, n_b))
    sizes_a, sizes_b = own.sizes_a[ids_a], own.sizes_b[ids_b]
    overlap = product(by_bytes(sizes_a), transposed(by_bytes(sizes_b)))
    if len(ids_a):
        of_a, of_b = groups(overlap, np.cumsum(sizes_a), np.cumsum(sizes_b))
    else:
        of_a = of_b = np.zeros(0, np.int64)
    start_group = np.concatenate([of_a, [of_a[-1] + 1 if len(of_a) else 0]])[start_a]
    return Aligned(ids_a, ids_b, start_a, start_b, start_group, of_a, of_b, same, overlap)


def _pack(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(file.getbuffer())


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as found:
        return dict(found)


class _Numbers(dict):
    """Numbers strings in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _joined(strings: pa.Array, starts: np.ndarray, mark: str) -> pa.Array:
    """Runs of strings, each run joined by a mark."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), strings), pa.scalar(mark, pa.large_string()))


def _spelt(aligned: Aligned) -> pa.Array:
    """Each segment's groups as text: ids of A, a bar, ids of B; groups parted by semicolons."""
    n = int(aligned.start_group[-1])
    parts = []
    for ids, group in ((aligned.ids_a, aligned.group_a), (aligned.ids_b, aligned.group_b)):
        names = pa.array(ids).cast(pa.large_string())
        parts.append(_joined(names, np.searchsorted(group, np.arange(n + 1)), ","))
    whole = pc.binary_join_element_wise(*parts, pa.scalar("|", pa.large_string()))
    return _joined(whole, aligned.start_group, ";")


def _chunk(texts: list[str], own: Tokenizers) -> tuple[list[tuple], dict]:
    """Figures of each text, and the chunk's matrices and pairs.

    ``seg_*`` is segments by pairs with the number of links, ``doc_*`` texts by segments with the
    number of occurrences, ``a``, ``b``, ``docs`` the pairs and the texts that hold them.
    """
    numbers = _Numbers()
    lists = [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) for found in map(segments, texts)]
    aligned = align_segments(list(numbers), own)
    n_a, n_b, n_groups = (np.diff(x) for x in (aligned.start_a, aligned.start_b, aligned.start_group))
    spelt, total = _spelt(aligned), int(aligned.start_group[-1])
    # Ids by groups times groups by ids, per segment: a row is a segment and an id of A.
    wide_a, wide_b = len(own.sizes_a), len(own.sizes_b)
    by_a = incidence(aligned.ids_a, aligned.group_a, total, wide_a)
    by_b = incidence(aligned.ids_b, aligned.group_b, total, wide_b)
    segment = np.repeat(np.arange(len(numbers)), n_groups)
    keys, key_of = np.unique(segment[by_a.row] * wide_a + by_a.at, return_inverse=True)
    linked = product(compressed(key_of, by_a.row, by_a.value, len(keys), total), by_b)
    pair_key = (keys % wide_a)[linked.row] * wide_b + linked.at
    pairs, pair_of = np.unique(pair_key, return_inverse=True)
    links = compressed((keys // wide_a)[linked.row], pair_of, linked.value, len(numbers), max(len(pairs), 1))
    n_links = np.bincount(links.row, links.value, minlength=len(numbers)).astype(np.int64)

    figures, used, times, sizes = [], [], [], []
    for found in lists:
        if not len(found) or not aligned.same[found].all():
            figures.append((0, 0, 0, 0, ""))
            sizes.append(0)
            continue
        line = _joined(spelt.take(pa.array(found)), np.array([0, len(found)]), ";")[0].as_buffer()
        figures.append((*(int(x[found].sum()) for x in (n_a, n_b, n_groups, n_links)), hashlib.sha256(line).hexdigest()))
        different, n = np.unique(found, return_counts=True)
        used.append(different)
        times.append(n)
        sizes.append(len(different))
    start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.concatenate(used).astype(np.int64) if used else np.zeros(0, np.int64)
    docs = Rows(start, at, np.concatenate(times).astype(np.int64) if times else at, len(numbers))
    # A text holds a pair once, however many links it has; texts are taken a few at a time.
    holders = np.zeros(len(pairs), np.int64)
    ones = Rows(links.start, links.at, np.ones(len(links.at), np.int64), links.width)
    grown = np.concatenate([[0], np.cumsum(np.diff(links.start)[docs.at])])[docs.start]
    row = 0
    while row < len(docs):
        end = max(int(np.searchsorted(grown, grown[row] + PIECE, "right")) - 1, row + 1)
        some = slice(docs.start[row], docs.start[end])
        part = Rows(docs.start[row : end + 1] - docs.start[row], docs.at[some], np.ones(some.stop - some.start, np.int64), docs.width)
        holders += np.bincount(product(part, ones).at, minlength=len(pairs))
        row = end
    held = np.flatnonzero(holders)
    place = np.cumsum(holders > 0) - 1
    state = {
        "doc_start": docs.start, "doc_at": docs.at.astype(np.int32), "doc_value": docs.value.astype(np.int32),
        "seg_start": links.start, "seg_at": place[links.at].astype(np.int32), "seg_value": links.value, "pair_held": holders[links.at] > 0,
    }
    return figures, {"state": state, "a": pairs[held] // wide_b, "b": pairs[held] % wide_b, "docs": holders[held]}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in chunks of about CHUNK code points, never across batches."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        first = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield batch.column(0).slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(t)
        if texts:
            yield batch.column(0).slice(first), texts[first:]


def linked(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A pair of ids counts once for each row that links it; ``count_sum`` adds the counts of a row's
    links, ``n_best`` its links whose count is the highest that their A id has in the corpus. A text
    that is null, empty, or whose bytes a tokenizer changes has no tokens: zeros and ''. Rows that
    repeat count each by themselves and a null id stays a row; other columns play no part; an empty
    table stays empty. Whole texts are read once; what is shuffled is a chunk's pairs and its matrices.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType
    own_type = kind.simpleString()

    def read(batches):
        own = tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _parts(batches):
            figures, found = _chunk(texts, own)
            columns = [[f[i] for f in figures] for i in range(5)]
            lists = [ids, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())]
            lists += [pa.array(found[c], pa.int64()) for c in ("a", "b", "docs")]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            packed = pa.array([_pack(**found["state"])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), packed, *arrays], names=names)
            number += 1

    names = ["chunk", "state", "ids", "n_a", "n_b", "n_groups", "n_links", "digest", "a", "b", "docs"]
    longs = ", ".join(f"{n} array<long>" for n in names[3:7])
    schema = f"chunk long, state binary, ids array<{own_type}>, {longs}, digest array<string>, a array<long>, b array<long>, docs array<long>"
    chunks = cut(rows.mapInArrow(read, schema))

    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pos", "p"))
    pairs = pairs.select("chunk", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.docs").alias("docs"))
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("docs").alias("n")))
    # At most one row for each entry of A's vocabulary.
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    told = pairs.select("chunk", "pos", "a", "b").join(counts, ["a", "b"])
    told = told.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("pos", "n", "best")).alias("told"))

    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                of = dict(zip(batch.schema.names, batch.columns))
                state = _unpack(of["state"][i].as_py())
                answer = of["told"][i].values
                n, best = np.zeros(1, np.int64), np.zeros(1, np.int64)
                if answer is not None:
                    pos = answer.field("pos").to_numpy()
                    n, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
                    n[pos] = answer.field("n").to_numpy()
                    best[pos] = answer.field("best").to_numpy(zero_copy_only=False)
                # Pairs of segments that no usable text holds have no count; no row refers to them.
                held = state["pair_held"]
                at, value = np.where(held, state["seg_at"], 0), state["seg_value"] * held
                links = Rows(state["seg_start"], at, value, len(n))
                docs = Rows(state["doc_start"], state["doc_at"], state["doc_value"], len(links))
                made = [docs.dot(links.dot(x)) for x in (best, n)]
                lists = [of[c][i].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*lists, *(pa.array(x, pa.int64()) for x in made), of["digest"][i].values],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    figures = ", ".join(f"{n} long" for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    out = chunks.drop("a", "b", "docs").join(told, F.col("chunk") == F.col("of"), "left").drop("of")
    return out.mapInArrow(sums, f"id {own_type}, {figures}, groups_sha256 string")


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """df with the alignment of each text, its tokens numbered from 0.

    ``a`` and ``b``: arrays of (id, end, group), the end in bytes behind the added space; ``overlaps``:
    array of (a, b, bytes), the links of tokens that share bytes. Tokens of one group are the
    shared-group links. They replace columns of those names. A text that is null, empty, or whose
    bytes a tokenizer changes has empty arrays. Rows that repeat are aligned alike; an empty table stays empty.
    """
    made = {
        "a": pa.list_(pa.struct([("id", pa.int32()), ("end", pa.int64()), ("group", pa.int64())])),
        "overlaps": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())])),
    }
    made = {"a": made["a"], "b": made["a"], "overlaps": made["overlaps"]}
    kept = [c for c in df.columns if c not in made]

    def run(batches):
        own = tokenizers(path_a, path_b)
        for batch in batches:
            out = {c: [] for c in made}
            for t in batch.column(0).to_pylist():
                x = align_segments(segments(t or ""), own)
                empty = not x.same.all()
                for c, ids, group, sizes in (("a", x.ids_a, x.group_a, own.sizes_a), ("b", x.ids_b, x.group_b, own.sizes_b)):
                    rows = zip(ids.tolist(), np.cumsum(sizes[ids]).tolist(), group.tolist())
                    out[c].append([] if empty else [dict(zip(("id", "end", "group"), r)) for r in rows])
                links = zip(x.overlap.row.tolist(), x.overlap.at.tolist(), x.overlap.value.tolist())
                out["overlaps"].append([] if empty else [dict(zip(("a", "b", "bytes"), r)) for r in links])
            arrays = [pa.array(out[c], kind) for c, kind in made.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*batch.schema.names[1:], *made])

    token = "array<struct<id: int, end: bigint, group: bigint>>"
    schema = with_field(
        df.select(*[F.col(f"`{c}`") for c in kept]),
        ("a", token), ("b", token), ("overlaps", "array<struct<a: bigint, b: bigint, bytes: bigint>>"),
    )
    return df.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return linked(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")
