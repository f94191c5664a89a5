"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A table's hash of a vector is made of ``PARTS`` pseudo-random rotations (three rounds of random
signs and a Hadamard transform), each reduced to its largest coordinate and that one's sign. A
vector also probes the next most likely buckets, and all probes of both sides meet. Pairs that
share a bucket are measured in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.components import components
from headcount.llm.shared import Forest, by_size, cut, stars, table, tiles, whole_runs
from headcount.llm.vectors import matrix, vectors

#: Of 20,000 pairs at a cosine of 0.9 in 64 dimensions, these find all.
TABLES, PARTS, PROBES = 8, 3, 8
#: Members of a bucket that one task compares with as many others; runs that are compared many at once.
BLOCK, SMALL = 256, 32
#: Vectors whose keys a task remembers.
REMEMBERED = 100_000
_SEED = 71


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the last axis, in place; its length is a power of two.

    Sums are taken element by element in one order, so a vector has the same transform wherever it
    stands.
    """
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        a, b = y[:, :, 0], y[:, :, 1]
        difference = a - b
        a += b
        b[...] = difference
        h *= 2
    return x


def _signs(size: int) -> np.ndarray:
    """Signs of the rotations: (round, table and part, component)."""
    return np.random.default_rng([_SEED, size]).choice([-1.0, 1.0], (3, TABLES * PARTS, size))


_CHOICES = np.stack(np.meshgrid(*[np.arange(3)] * PARTS, indexing="ij"), -1).reshape(-1, PARTS)


def probes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Keys of the buckets of each row: shape (rows, TABLES, PROBES), the likeliest first.

    A probe replaces the largest coordinate of some parts by the second or third; its cost is the
    sum of the squared gaps to the largest ones, and the cheapest are taken.
    """
    out = np.empty((len(x), TABLES, PROBES), np.int64)
    for at in range(0, len(x), 64):
        out[at : at + 64] = _probes(x[at : at + 64], signs)
    return out


def _probes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    n, size = x.shape
    width = signs.shape[-1]
    y = np.zeros((n, TABLES * PARTS, width))
    y[:, :, :size] = x[:, None, :]
    for r in range(3):
        y *= signs[r]
        hadamard(y)
    rest = np.abs(y)
    best = np.empty((3, n, TABLES * PARTS), np.int64)
    gap = np.empty((3, n, TABLES * PARTS))
    for k in range(3):
        top = rest.argmax(axis=2)
        value = np.take_along_axis(rest, top[:, :, None], axis=2)[:, :, 0]
        best[k] = 2 * top + (np.take_along_axis(y, top[:, :, None], axis=2)[:, :, 0] < 0)
        gap[k] = value if k == 0 else (gap[0] - value) ** 2
        np.put_along_axis(rest, top[:, :, None], -1.0, axis=2)
    gap[0] = 0
    best, gap = best.reshape(3, n, TABLES, PARTS), gap.reshape(3, n, TABLES, PARTS)
    total = sum(gap[_CHOICES[:, p], :, :, p] for p in range(PARTS))  # (choice, row, table)
    order = np.argsort(total, axis=0, kind="stable")[:PROBES]
    key = np.zeros(order.shape, np.int64)
    for p in range(PARTS):
        key = key * (2 * width) + np.take_along_axis(best[:, :, :, p], _CHOICES[order, p], axis=0)
    return np.moveaxis(key * TABLES + np.arange(TABLES), 0, 2)


def _width(size: int) -> int:
    return max(4, 1 << (size - 1).bit_length())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the vectors of each length."""
    data = column.to_pylist()
    sizes = np.array([len(x) for x in data])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _unit(np.stack([np.frombuffer(data[i], np.float64) for i in at]))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [x and hashlib.blake2b(x, digest_size=16).digest() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], names=["id", "vec", "mark"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            ids = part.column(0).to_numpy()
            for at, x in _by_size(part.column(1)):
                signs = _signs(_width(x.shape[1]))
                keys = probes(x, signs).reshape(len(at), -1)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at) * n, x.shape[1], np.int32)), pa.array(keys.ravel()), pa.array(np.repeat(ids[at], n))],
                    names=["size", "key", "id"],
                )


def _first(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first bucket, by table and key, that paired rows of keys share.

    ``a`` and ``b`` have shape (pairs, TABLES, PROBES).
    """
    out = np.ones(len(a), bool)
    own = key % TABLES
    for t in range(TABLES):
        shared = a[:, t, :, None] == b[:, t, None, :]
        before = np.where(own == t, key, np.where(own > t, np.iinfo(np.int64).max, -1))
        out &= ~(shared & (a[:, t] < before[:, None])[:, :, None]).any(axis=(1, 2))
    return out


def _tiles(least: float):
    """Per pair of blocks of a bucket: each member's links, and pairs that join what links connect.

    A pair counts only in the first bucket that it shares, so that sums over buckets are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        known: dict[int, np.ndarray] = {}
        for part, starts in whole_runs(batches, ["size", "key", "left", "right"]):
            sizes = part.column("size").to_numpy()[starts[:-1]]
            for size in np.unique(sizes):  # sorted by it, so its runs stand together
                runs_of = np.flatnonzero(sizes == size)
                a, b = starts[runs_of[0]], starts[runs_of[-1] + 1]
                own = starts[runs_of[0] : runs_of[-1] + 2] - a
                yield from _linked(part.slice(a, b - a), own, least, forest, known)

    return run


def _linked(part: pa.Table, starts: np.ndarray, least: float, forest: Forest, known: dict[int, np.ndarray]):
    ids, copies, key, block, left, right = (
        part.column(c).to_numpy() for c in ("id", "copies", "key", "block", "left", "right")
    )
    x = _unit(matrix(part.column("vec")))
    size = np.diff(starts)
    run = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= SMALL, size)
    pairs = []
    for step in range(1, min(SMALL, size.max())):
        # Two members of one block meet in that block's own tile only.
        here = (left[:-step] == right[:-step]) | (block[:-step] != block[step:])
        i = np.flatnonzero((run[:-step] == run[step:]) & small[:-step] & here)
        i = i[np.einsum("ij,ij->i", x[i], x[i + step]) >= least]
        pairs.append((i, i + step, False))
    for r in np.flatnonzero(size > SMALL):
        own = np.arange(starts[r], starts[r + 1])
        i, j = (own[block[own] == side[own]] for side in (left, right))
        close = x[i] @ x[j].T >= least
        p, q = np.nonzero(np.triu(close, 1) if left[own[0]] == right[own[0]] else close)
        pairs.append((i[p], j[q], True))
    signs = _signs(_width(x.shape[1]))
    n = np.zeros(len(ids), np.int64)
    edges = []
    for i, j, large in pairs:
        for at in range(0, len(i), 16384):
            p, q = i[at : at + 16384], j[at : at + 16384]
            first = _first(_keys_of(p, ids, x, signs, known), _keys_of(q, ids, x, signs, known), key[p])
            p, q = p[first], q[first]
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            if large and len(p):
                # One pair for each row is enough to join what a large run's links do.
                rows, place = np.unique(np.concatenate([p, q]), return_inverse=True)
                linked = np.zeros((len(rows), len(rows)), bool)
                linked[place[: len(p)], place[len(p) :]] = True
                edges.append(stars(linked, ids[rows], ids[rows]))
            else:
                edges.append((ids[p], ids[q]))
    hit = np.flatnonzero(n)
    if not len(hit):
        return
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[hit]), pa.nulls(len(hit), pa.int64()), pa.array(n[hit])], names=["id", "other", "n"]
    )
    joining = forest.joining(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)))
    zeros = pa.array(np.zeros(joining.num_rows, np.int64))
    yield pa.RecordBatch.from_arrays([*joining.columns, zeros], names=["id", "other", "n"])


def _keys_of(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, signs: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """The keys of some rows; a task remembers those of the vectors it has met."""
    if len(known) > REMEMBERED:
        known.clear()
    own, place = np.unique(rows, return_inverse=True)
    new = [r for r in own.tolist() if ids[r] not in known]
    if new:
        for r, keys in zip(new, probes(x[new], signs)):
            known[ids[r]] = keys
    return np.stack([known[i] for i in ids[own].tolist()])[place] if len(own) else np.zeros((0, TABLES, PROBES), np.int64)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` per distinct id, and per row without an id.

    A link joins two vectors of equal length whose cosine, in double precision, is at least
    ``least``. Equal vectors are one class from the start and are counted, never paired. Unusable
    vectors (see ``vectors``) link with nothing. A row with a null id has no component and is kept.
    Other columns play no part; an empty table stays empty.
    """
    nameless = df.where(F.col(f"`{key}`").isNull()).select(
        F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    rows = cut(vectors(df.where(F.col(f"`{key}`").isNotNull()), key, vector).mapInArrow(_marks, "id long, vec binary, mark binary"))
    usable = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    classes = cut(
        usable.groupBy("mark").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    )
    keys = classes.select("id", "vec").mapInArrow(_keys, "size int, key long, id long")
    counts = cut(keys.groupBy("size", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    member = cut(keys.join(by_size(counts), ["size", "key"]))
    found = cut(
        tiles(member.join(classes.select("id", "copies", "vec"), "id"), ["size", "key"], "id", BLOCK).mapInArrow(
            _tiles(least), "id long, other long, n long"
        )
    )
    links = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = (
        classes.select("mark", "id", "copies")
        .join(cut(links), "id", "left")
        .join(cut(joined.withColumnRenamed("node", "id")), "id", "left")
        .select("mark", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("mark")).alias("mark")).join(by_size(cut(named)), "mark", "left")
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    ).unionByName(nameless)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.size * b.size
),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
found AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM found
"""
