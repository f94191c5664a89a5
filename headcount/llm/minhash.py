"""Near-duplicate texts: MinHash signatures joined within a Hamming distance by several indexes.

A signature has a number of b-bit MinHash values. It is cut into chunks; two signatures that differ
in fewer values than twice the number of chunks differ in at most one value of some chunk
(pigeonhole). With one error allowed in a chunk, the keys that leave one value out each enumerate
every case, so the join finds all pairs under the distance. What these pairs connect is a family;
links are confirmed on the full shingle sets of its members.

Sizes follow from the similarity asked for: as many chunks as keep the share of pairs right at it whose
distance is too large below ``MISS``.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.components import components
from headcount.llm.shared import Forest, by_size, cut, lean, runs, slices, stars, table, tiles, whole_runs

WORDS = 5
#: Share of the pairs at the threshold that may be missed.
MISS = 2e-4
#: Values of a chunk, and of a signature, at most.
CHUNK, SYMBOLS = 6, 96
#: Members of a bucket, or texts of a family, that one task compares with as many others.
SIGNATURES, SETS = 256, 128
#: Runs up to this size are compared many at once.
SMALL = 32

_rng = np.random.default_rng(20240607)


def _odd(*shape: int) -> np.ndarray:
    return _rng.integers(1, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES, _FACTORS, _KEYS = _odd(WORDS), _odd(SYMBOLS), _odd(CHUNK)
#: Tells the keys of a chunk and of its left-out value from the others.
_SALTS = _rng.integers(1, 1 << 63, (SYMBOLS, CHUNK), dtype=np.uint64)
_BYTES = _odd(256)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class Scheme:
    """Signatures of ``chunks`` chunks of ``chunk`` values each, one of which may differ in some chunk."""

    chunk: int
    chunks: int

    @property
    def symbols(self) -> int:
        return self.chunk * self.chunks

    @property
    def distance(self) -> int:
        """The largest distance at which some chunk differs in one value at most."""
        return 2 * self.chunks - 1

    def miss(self, percent: float) -> float:
        """Probability that two sets of this similarity have signatures beyond the distance."""
        n, q = self.symbols, 1 - percent / 100
        return sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(self.distance + 1, n + 1))


@functools.cache
def scheme(percent: int) -> Scheme:
    """The scheme with the longest chunks, whose keys are the rarest, that misses MISS of the pairs at most."""
    if not 0 < percent <= 100:
        raise ValueError("a similarity is a percentage above 0")
    for chunk in range(CHUNK, 1, -1):
        for chunks in range(2, SYMBOLS // chunk + 1):
            if (found := Scheme(chunk, chunks)).miss(percent) <= MISS:
                return found
    raise ValueError(f"no signature of {SYMBOLS} values finds the pairs of a similarity of {percent} %")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of some bytes: a polynomial, the same wherever the word stands.

    Words are runs without ASCII white space. Hashes come from one prefix sum over the bytes.
    """
    while len(_powers[0]) < len(text):
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(len(_powers[k]), base, np.uint64)
            _powers[k] = np.concatenate([_powers[k], _powers[k][-1] * np.cumprod(step, dtype=np.uint64)])
    word = np.zeros(len(text) + 2, bool)
    word[1:-1] = ~_SPACE[text]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * _powers[0][: len(text)], out=sums[1:])
    return starts, (sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64)


def _groups(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts as bytes, A-Z lower-cased, as many together as one prefix sum takes with ease."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size > 1 << 17:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its five-word shingles.

    A text with fewer words is one shingle; one without words, or null, has none.
    """
    for group in _groups(texts):
        borders = np.cumsum([0] + [len(x) + 1 for x in group])
        starts, h = word_hashes(np.frombuffer(b" ".join(group), np.uint8))
        at = np.searchsorted(starts, borders).tolist()
        n = max(0, len(h) - WORDS + 1)
        s = np.zeros(n, np.uint64)
        for i in range(WORDS):
            s += h[i : i + n] * _PLACES[i]
        s = _mixed(s)
        for a, b in zip(at, at[1:]):
            if b - a >= WORDS:
                own = np.sort(s[a : b - WORDS + 1])
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                yield own[new]
            else:
                few = h[a:b]
                yield _mixed((few * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))[: b - a]


def signature(s: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit values of a non-empty set: of the smallest element under each multiplication."""
    factors = _FACTORS[:symbols]
    least = (s[:512, None] * factors).min(axis=0)
    for at in range(512, len(s), 512):
        np.minimum(least, (s[at : at + 512, None] * factors).min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(sigs: np.ndarray, own: Scheme) -> np.ndarray:
    """A key for each value of each signature (row): of its chunk, the values with this one left out."""
    part = (sigs.reshape(-1, own.chunks, own.chunk).astype(np.uint64) + np.uint64(1)) * _KEYS[: own.chunk]
    salts = _SALTS[: own.chunks, : own.chunk]
    return _mixed(part.sum(axis=2, keepdims=True, dtype=np.uint64) - part + salts).reshape(len(sigs), own.symbols)


def _mark(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signatures(column, own: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, own.symbols)


def _sketches(own: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, marks, sigs = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                sizes.append(len(s))
                marks.append(_mark(s))
                sigs.append(signature(s, own.symbols).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(sigs, pa.binary())],
                names=["id", "n", "mark", "sig"],
            )

    return run


def _keys(own: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = chunk_keys(_signatures(part.column(1), own), own).view(np.int64).ravel()
                ids = np.repeat(part.column(0).to_numpy(), own.symbols)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])

    return run


def _near(scheme: Scheme):
    """Pairs of ids that join what signatures within the distance connect in each tile of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for part, starts in whole_runs(batches, ["key", "left", "right"]):
            sigs, ids = _signatures(part.column("sig"), scheme), part.column("id").to_numpy()
            size = np.diff(starts)
            run = np.repeat(np.arange(len(size)), size)
            small = np.repeat(size <= SMALL, size)
            left, right = [], []
            for step in range(1, min(SMALL, size.max())):
                i = np.flatnonzero((run[:-step] == run[step:]) & small[:-step])
                i = i[(sigs[i] != sigs[i + step]).sum(axis=1) <= scheme.distance]
                left.append(ids[i])
                right.append(ids[i + step])
            for r in np.flatnonzero(size > SMALL):
                own = part.column("block").slice(starts[r], size[r]).to_numpy()
                i, j = (starts[r] + np.flatnonzero(own == part.column(c)[starts[r]].as_py()) for c in ("left", "right"))
                a, b = stars(_distances(sigs[i], sigs[j]) <= scheme.distance, ids[i], ids[j])
                left.append(a)
                right.append(b)
            if left:
                yield forest.joining(np.concatenate(left), np.concatenate(right))

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] != b[None, :, k]
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = list(shingle_sets(batch.column("text").to_pylist()))
        marks, data = [_mark(s) for s in sets], [s.tobytes() for s in sets]
        rest = [batch.column(c) for c in ("family", "n", "id")]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(marks, pa.binary()), pa.array(data, pa.binary())], names=["family", "n", "id", "mark", "set"]
        )


def common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of sets with others, each sorted and distinct."""
    both = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(others)), assume_unique=True)
    out = np.zeros((len(sets), len(others)), np.float64)
    for at in range(0, len(both), 8192):
        part = both[at : at + 8192]
        out += _incidence(sets, part) @ _incidence(others, part).T
    return out


def _incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), np.float32)
    for row, s in zip(out, sets):
        s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
        at = np.searchsorted(part, s)
        row[at[part[at] == s]] = 1
    return out


def _confirmed(percent: int):
    """Pairs of ids that join what similar sets connect in each tile of a family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["family", "left", "right"]):
            # An id that repeats stands for the set with the smallest digest, as in its sketch.
            rows = sorted(zip(*(part.column(c).to_pylist() for c in ("id", "mark", "block", "set"))))
            rows = [r for k, r in enumerate(rows) if not k or rows[k - 1][0] != r[0]]
            ids, own = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            i, j = (np.flatnonzero(own == part.column(c)[0].as_py()) for c in ("left", "right"))
            if not len(i) or not len(j):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = common([sets[k] for k in i], [sets[k] for k in j])
            similar = 100 * both >= percent * (size[i][:, None] + size[j][None, :] - both)
            a, b = stars(similar, ids[i], ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, ``kept`` per distinct id of ``df[key]``.

    Links join texts with 100 * intersection >= percent * union of their shingle sets. Texts with
    equal sets are one class from the start, whatever their number; a text without words links with
    nothing. Rows that repeat an id count as one text, the one whose set has the smallest digest.
    A null id takes part in nothing and comes back as its own row, kept, with a null component.

    Of the pairs right at ``percent`` a share of MISS, 0.02 %, is missed at most, of those above it
    fewer. Other columns play no part; an empty table stays empty.

    A bucket or a family of any size is compared in tiles of two blocks, and a tile returns what
    connects its rows, never their pairs.
    """
    own = scheme(percent)
    source = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketch = "id long, n long, mark binary, sig binary"
    one = source.where("id IS NOT NULL").mapInArrow(lean(_sketches(own)), sketch)
    one = cut(one.groupBy("id").agg(F.min(F.struct("mark", "n", "sig")).alias("s")).select("id", "s.*"))
    classes = one.where("mark IS NOT NULL").groupBy("mark").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    classes = cut(classes)

    heads = classes.select("id", "sig")
    keys = heads.mapInArrow(lean(_keys(own)), "key long, id long")
    buckets = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(keys.join(by_size(buckets), "key")).join(heads, "id")
    near = cut(tiles(members, ["key"], "id", SIGNATURES).mapInArrow(lean(_near(own)), "a long, b long").distinct())

    family = cut(components(near).select(F.col("node").alias("id"), F.col("component").alias("family")))
    sizes = cut(family.groupBy("family").agg(F.count(F.lit(1)).alias("n")))
    family = cut(family.join(by_size(sizes), "family"))
    texts = source.join(by_size(family, 200_000), "id").select("family", "n", "id", "text")
    sets = texts.mapInArrow(lean(_sets), "family long, n long, id long, mark binary, set binary")
    links = tiles(sets, ["family"], "id", SETS).mapInArrow(lean(_confirmed(percent)), "a long, b long")
    found = cut(components(cut(links.distinct())).withColumnRenamed("node", "id"))

    named = classes.join(found, "id", "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    out = one.join(by_size(cut(named)), "mark", "left").select(
        "id", "n", F.coalesce("component_id", "id").alias("component_id")
    )
    nameless = source.where("id IS NULL").mapInArrow(lean(_sketches(own)), sketch)
    return out.unionByName(nameless.select("id", "n", F.lit(None).cast("long").alias("component_id"))).select(
        "id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN sizes USING (doc_id)
"""


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of df whose text is the kept one of its group; all columns, rows with a null key too.

    Groups are those of ``near_duplicates`` at ``percent``. An id is one text there, so all rows that
    repeat a kept id stay. An empty table stays empty.
    """
    gone = cut(near_duplicates(df, key, text, percent).where("NOT kept").select("id"))
    return df.join(by_size(gone, 200_000).withColumnRenamed("id", "__gone"), F.col(f"`{key}`") == F.col("__gone"), "left_anti")
