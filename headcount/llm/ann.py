"""Exact nearest neighbours of a stated query set: a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks; a task meets one block of queries with a stripe of
candidate blocks, tile by tile. An int8 product gives every score of the tile within a known error.
Only candidates whose upper bound reaches the k-th best lower bound, and the k-th best so far, are
measured again in double precision; a heap for each query merges the tiles, then the stripes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import cut, runs, table, whole_runs
from headcount.llm.vectors import matrix, vectors

#: Rows of a tile, whose products take 8 bytes each, and tiles of a stripe.
QUERIES, CANDIDATES, STRIPE = 512, 2048, 64
#: Queries that a task holds. All candidates are sent once for each such group.
GROUP = 16_384


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers of -127 to 127 and each row's scale; a component is off by half a scale at most."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.maximum(scale, np.finfo(float).tiny)
    return np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8), scale


def bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of rows of x with rows of y by their int8 forms, and the largest error.

    With q the integers and s the scales, |x.y - s s' q.q'| <= s s' (|q|/2 + |q'|/2 + d/4), |.| being
    the sum of absolute values. Products of int8 rows are exact in single precision up to 1,040
    components, in double beyond. A part in 10^9 on top covers rounding.
    """
    (a, s), (b, t) = quantised(x), quantised(y)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    near = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    la, lb = (np.abs(q.astype(np.int32)).sum(axis=1) for q in (a, b))
    scale = s[:, None] * t[None, :]
    near *= scale
    error = scale * (0.5 * la[:, None] + 0.5 * lb[None, :] + 0.25 * x.shape[1])
    error += 1e-9 * (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    return near, error


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _tile(query: np.ndarray, x: np.ndarray, known: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int):
    """(query row, candidate row, score) of all that may be among a query's k best.

    ``known`` is each query's k-th best score so far; nothing below it, or below the tile's own k-th
    lower bound, is measured.
    """
    near, error = bounds(x, y)
    own = query[:, None] == ids[None, :]
    least = known
    if len(ids) > k:
        low = np.where(own, -np.inf, near - error)
        least = np.maximum(least, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
    q, c = np.nonzero((near + error >= least[:, None]) & ~own)
    score = np.concatenate([_exact(x[q[i : i + 65536]], y[c[i : i + 65536]]) for i in range(0, max(len(q), 1), 65536)])
    return q, c, score


class Best:
    """The k best of each query, nearest first, ties by smaller id: a heap for each."""

    def __init__(self, k: int):
        self.k = k
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def push(self, query: int, score: float, vec: int) -> None:
        heap = self.heaps.setdefault(query, [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec))
        elif (score, -vec) > heap[0]:
            heapq.heapreplace(heap, (score, -vec))

    def least(self, queries: np.ndarray) -> np.ndarray:
        """The k-th best score of each query, or minus infinity while there are fewer."""
        heaps = (self.heaps.get(q, ()) for q in queries.tolist())
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in heaps])

    def batch(self) -> pa.RecordBatch:
        rows = [
            (query, rank, -vec, score)
            for query, heap in self.heaps.items()
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), start=1)
        ]
        self.heaps.clear()
        columns = zip(*rows) if rows else [()] * 4
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "rank", "vec_id", "score"]
        )


def _tiles(k: int):
    """A block of queries against the blocks of candidates of its stripe, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, query, x = Best(k), None, np.zeros(0, np.int64), None
        for part in runs(batches, ["size", "left", "stripe", "right"]):
            place = tuple(part.column(c)[0].as_py() for c in ("size", "left", "stripe"))
            if place != last:
                yield best.batch()
                last, query = place, np.zeros(0, np.int64)
            if part.column("right")[0].as_py() < 0:
                query, x = part.column("id").to_numpy(), matrix(part.column("vec"))
            elif len(query):
                ids, y = part.column("id").to_numpy(), matrix(part.column("vec"))
                for at in range(0, len(query), QUERIES):
                    own = query[at : at + QUERIES]
                    q, c, score = _tile(own, x[at : at + QUERIES], best.least(own), ids, y, k)
                    for row in zip(own[q].tolist(), score.tolist(), ids[c].tolist()):
                        best.push(*row)
        yield best.batch()

    return run


def _merged(k: int):
    """The k best of each query from those of its stripes, which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for part, _ in whole_runs(batches, ["query_id"]):
            for row in zip(*(part.column(c).to_pylist() for c in ("query_id", "score", "vec_id"))):
                best.push(*row)
            yield best.batch()

    return run


def nearest(df: DataFrame, queries: str, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k rows with the largest inner product.

    ``queries`` is a condition on ``id``; candidates are all rows but the query's own. The result is
    exact: no candidate is left out, ties go to the smaller id. Vectors of different lengths are not
    compared; unusable ones (see ``vectors``) and null ids take no part; a repeated id is one row.
    Other columns play no part; an empty table finds nothing. A query with fewer than k candidates returns them all, one without any returns nothing.
    """
    rows = cut(
        vectors(df, key, vector).where("id IS NOT NULL AND vec IS NOT NULL").withColumn("size", F.length("vec"))
    )
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(
        rows.groupBy("size")
        .agg(
            F.ceil(F.count_if(F.expr(queries)) / GROUP).cast("int").alias("lefts"),
            F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("rights"),
        )
        # Enough stripes to keep all partitions busy, and to bound what one task reads.
        .withColumn("stripes", F.expr(f"CAST(least(rights, greatest(ceil({wide} / greatest(lefts, 1)), ceil(rights / {STRIPE}))) AS INT)"))
    ).where("lefts > 0")
    rows = rows.join(sizes, "size")
    block = "CAST(pmod(xxhash64(id, {}), {}) AS INT)"
    left = rows.where(queries).select(
        "size", "stripes", F.expr(block.format(11, "lefts")).alias("left"),
        F.explode(F.expr("sequence(0, stripes - 1)")).alias("stripe"), F.lit(-1).alias("right"), "id", "vec",
    )
    right = rows.withColumn("right", F.expr(block.format(13, "rights"))).select(
        "size", "stripes", F.explode(F.expr("sequence(0, lefts - 1)")).alias("left"),
        (F.col("right") % F.col("stripes")).alias("stripe"), "right", "id", "vec",
    )
    number = F.pmod(F.xxhash64("size"), F.lit(wide)) + F.col("left").cast("long") * F.col("stripes") + F.col("stripe")
    found = "query_id long, rank int, vec_id long, score double"
    best = (
        left.unionByName(right)
        .repartitionById(wide, (number % wide).cast("int"))
        .drop("stripes")
        .sortWithinPartitions("size", "left", "stripe", "right")
        .mapInArrow(_tiles(k), found)
    )
    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), found)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


ORACLE_OP3 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
