"""Vectors as byte strings: one row per id, only those that can be measured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix(column) -> np.ndarray:
    """Rows of double precision from the byte strings of vectors of equal length."""
    kind = np.float64
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()])


def _bytes(values) -> bytes | None:
    if values is None or not len(values):
        return None
    if None in values:
        return None
    x = np.array(values, np.float64) + 0.0  # -0.0 becomes 0.0
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            made = [_bytes(v) for v in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "vec"])


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``vec`` (double precision, as bytes) per distinct id.

    ``vec`` is null for a vector that is null, empty, zero or holds null or non-finite components.
    An id that repeats stands for the usable vector whose bytes are smallest. A null id stays one row.
    """
    if not isinstance(df.schema[vector].dataType, T.ArrayType):
        raise TypeError(f"{vector} is not an array column")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    packed = rows.mapInArrow(_packed, "id long, vec binary")
    return packed.groupBy("id").agg(F.min("vec").alias("vec"))
