"""Time that the Arrow passes of a run spend on each read."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import stash


def marks(batch: pa.RecordBatch, keys: pa.Array, us: list[int]) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """``batch`` with an empty column ``us``, and a row for each of ``keys``, the batch's first
    column, with its microseconds there and nulls elsewhere."""
    rows = pa.record_batch([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], names=[*batch.schema.names, "us"])
    empty = [pa.nulls(len(us), c.type) for c in batch.columns[1:]]
    return rows, pa.record_batch([keys, *empty, pa.array(us, pa.int64())], names=rows.schema.names)


class Clock:
    """Gathers the time of a run's passes; one for each run."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def split(self, passed: DataFrame, key: str, value: str) -> DataFrame:
        """The rows of a pass with :func:`marks`, written, without the marks, in which
        ``value`` is null."""
        rows = stash(passed, "timed")
        self.add(rows.where("us IS NOT NULL"), key)
        return rows.where(F.col(value).isNotNull()).drop("us")

    def add(self, rows: DataFrame, key: str) -> None:
        self.parts.append(rows.select(F.col(key).alias("qid"), "us"))

    def total(self) -> DataFrame:
        """``(qid, mt)``: the milliseconds of each read."""
        rows = reduce(DataFrame.unionByName, self.parts)
        return rows.groupBy("qid").agg((F.sum("us") / 1000.0).alias("mt"))
