"""Shared folders, written intermediate tables and small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, a laptop) a temporary one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="riverseed-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder URI below the shared root."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    keeps values that must not be computed twice."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has at most ``max_rows``
    rows and, where rows have texts or lists, about ``max_bytes`` bytes; beyond that
    the join shuffles both sides."""
    size = F.lit(0) if max_bytes is None else F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    rows, held = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= max_rows and held <= (max_bytes or 0) else df


def skew_join(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (a written table or a scan, read more than once) joined to ``unique``, which
    has a row for each value of ``keys`` at most. Keys with more than a tenth of a task's
    even share of the rows are at most ``10 * partitions``: what ``unique`` has of them is
    broadcast, and only the other rows are shuffled, so that no key makes a large task."""
    sizes = rows.groupBy(*keys).count()
    limit = rows.count() // (10 * max(partitions(rows.sparkSession), 1)) + 1
    heavy = stash(sizes.where(F.col("count") > limit).drop("count").dropna(), "heavy")
    if heavy.isEmpty():
        return rows.join(unique, keys, how)
    few = stash(unique.join(F.broadcast(heavy), keys, "left_semi"), "heavy-rows")
    light = rows.join(F.broadcast(heavy), keys, "left_anti").join(unique.join(F.broadcast(heavy), keys, "left_anti"), keys, how)
    return rows.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(few), keys, how).unionByName(light)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once (a lambda variable inside bodies
    of higher-order functions, where a plain expression would be evaluated again
    for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column``, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def file_system(uri: str):
    """Arrow file system and path of a URI of a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else os.path.abspath(uri))


def normal_uri(uri: str) -> str:
    """``file:/x`` as ``file:///x``; other URIs as they are."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def put_file(uri: str, write) -> None:
    """Run ``write(stream)`` on a new file and give it its name only when whole, so
    that repeated or parallel attempts of a task leave one complete file."""
    fs, path = file_system(normal_uri(uri))
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path.rpartition('/')[0]}/_attempt-{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        write(out)
    fs.move(attempt, path)


def forest_roots(links: DataFrame, what: str) -> DataFrame:
    """Roots of a forest given as ``(node, parent)`` with ``parent < node``, one
    row a node: pointer jumping, a join for each doubling of the depth."""
    now = stash(links.select("node", "parent"), what)
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        nxt = stash(now.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), what)
        now = nxt.select("node", "parent")
        if nxt.where("moved").isEmpty():
            return now.select("node", F.col("parent").alias("root"))


def components(edges: DataFrame, what: str) -> DataFrame:
    """``(node, root)`` of each node of an undirected graph ``(a, b)``; root is the
    smallest node reachable. Large-star and small-star steps in turn, each a
    pre-aggregated minimum and a join, until the edges form stars."""
    e = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stash(skew_join(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), what)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, low, ["a"])
        small = stash(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(), what)
        same = small.join(e, ["a", "b"], "left_anti").isEmpty() and small.count() == e.count()
        e = small
        if same:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
