"""Small helpers of the training-data operators: lineage cuts, broadcasts by size, memory of Python tasks, runs of sorted rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that may be broadcast; beyond them the join is a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_field(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of df with further fields (name, type in DDL) behind."""
    more = [T.StructField(n, T.StructType.fromDDL(f"x {kind}")["x"].dataType) for n, kind in fields]
    return T.StructType([*df.schema.fields, *more])


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, read from the shared checkpoint folder from now on.

    The folder is the session's own (``spark.checkpoint.dir``). Only a session on one machine that
    names none gets one here.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("spark-checkpoints")
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for files of this job in the folder that driver and executors share."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir() or "").rpartition("/")[0]
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "spark-checkpoints"
    return f"{base.rstrip('/')}/{name}"


def by_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a cut table for broadcast if its count and its bytes allow; else leave it to a shuffle."""
    if df.count() > rows:
        return df
    if any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType)) for f in df.schema.fields):
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
        if (size or 0) > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts are Python's at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose task gives the memory it has freed back to the system at its end.

    Spark keeps a worker for later tasks, and the C library what the worker has freed: an executor's
    idle workers would hold the most that any of their tasks took.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
                trim(0)

    return task


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, with the runs' starts and the table's end.

    The partition is sorted by the keys. A run has to fit in memory; the callers split their keys so
    that it does.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]) if held is not None else part
        starts = _starts(part, keys)
        held = part.slice(starts[-1])
        if len(starts) > 1:
            yield part.slice(0, starts[-1]), starts
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _starts(part: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(part.num_rows, bool)
    new[0] = True
    for k in keys:
        c = part.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each run of equal keys by itself."""
    for part, starts in whole_runs(batches, keys):
        for a, b in zip(starts, starts[1:]):
            yield part.slice(a, b - a)


def tiles(df: DataFrame, keys: list[str], id_column: str, size: int) -> DataFrame:
    """df's rows in every pair of blocks of their group: columns ``block``, ``left``, ``right`` (left <= right).

    ``n`` is the number of rows of a row's group and its blocks hold about ``size`` of them. The
    result is partitioned so that the tiles of a large group go to partitions in turn, and sorted
    for ``whole_runs`` by keys, left and right.
    """
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__blocks", F.ceil(F.col("n") / size).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_column, F.lit(7)), F.col("__blocks")))
    rows = rows.withColumn("__other", F.explode(F.expr("sequence(0L, __blocks - 1)")))
    rows = rows.withColumn("left", F.least("block", "__other")).withColumn("right", F.greatest("block", "__other"))
    number = F.pmod(F.xxhash64(*keys), F.lit(wide)) + F.col("left") * F.col("__blocks") + F.col("right")
    rows = rows.repartitionById(wide, (number % wide).cast("int"))
    return rows.drop("__blocks", "__other", "n").sortWithinPartitions(*keys, "left", "right")


def stars(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (id, smaller id) that join the rows a and b as the matrix of their links does.

    Labels spread along the links until they are the smallest id of their part, so that all that
    leaves a tile is one pair for each of its rows.
    """
    ids = np.concatenate([a, b])
    label = ids.copy()
    i, j = label[: len(a)], label[len(a) :]
    top = np.iinfo(np.int64).max
    while True:
        before = label.copy()
        np.minimum(i, np.where(linked, j[None, :], top).min(axis=1, initial=top), out=i)
        np.minimum(j, np.where(linked, i[:, None], top).min(axis=0, initial=top), out=j)
        # A row that stands on both sides has one label.
        order = np.argsort(ids, kind="stable")
        twin = np.flatnonzero(ids[order][1:] == ids[order][:-1])
        least = np.minimum(label[order[twin]], label[order[twin + 1]])
        label[order[twin]] = label[order[twin + 1]] = least
        if np.array_equal(label, before):
            break
    hung = label < ids
    return ids[hung], label[hung]


class Forest:
    """Tells which links join two of a task's trees; the others add nothing."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def joining(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        kept = []
        if len(self.parent) > 1_000_000:
            self.parent.clear()
        for x, y in np.unique(np.stack([a, b]), axis=1).T.tolist():
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                kept.append((x, y))
        a, b = zip(*kept) if kept else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
