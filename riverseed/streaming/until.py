"""Stopping a run once its relative abundances are steady."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options

#: Squared distances to the current outlier in one pass over the vectors; the largest found.
_DISTANCE = """aggregate(slice(v, 2, size(v)), named_struct('at', v[0], 'd', 0D), (a, x) ->
    if(aggregate(zip_with(x, a.at, (p, q) -> (p - q) * (p - q)), 0D, (s, y) -> s + y) > a.d,
       named_struct('at', x, 'd', aggregate(zip_with(x, a.at, (p, q) -> (p - q) * (p - q)), 0D, (s, y) -> s + y)), a), a -> a.d)"""


def estimates(reads: DataFrame, o: Options) -> DataFrame:
    """``(est, n_reads, distance, stop)`` from mapped reads ``(rid, target, length)`` that
    are numbered from 0: after each ``su_every`` reads beyond the least number the shares
    of the targets so far, and the largest outlier distance among the last estimates
    (null until there are more than ``su_samples``). ``stop`` holds where a run may end.
    Sums are by block of reads, then running by target; the
    vector of one block, a value for each target, meets in one row."""
    blocks = reads.groupBy(F.floor(F.col("rid") / o.su_every).cast("long").alias("block"), "target").agg(F.sum("length").alias("x"), F.count("*").alias("n"))
    last = blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
    grid = blocks.select("target").distinct().select("target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(last, 0)).cast("long"))).alias("block"))
    w = Window.partitionBy("target").orderBy("block")
    run = grid.join(blocks, ["block", "target"], "left").select("block", "target", F.sum(F.coalesce("x", F.lit(0.0))).over(w).alias("x"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"))
    vec = run.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("target", "x"))).alias("v"), F.sum("x").alias("total"), F.sum("n").alias("n_reads"))
    vec = vec.select("block", "n_reads", F.expr("transform(v, t -> t.x / total)").alias("share"))
    vec = vec.where((F.col("n_reads") > o.su_min_reads) & (F.col("n_reads") % o.su_every == 0))
    ring = vec.select(F.explode(F.sequence("block", F.col("block") + o.su_samples - 1)).alias("block"), F.col("block").alias("of"), "share")
    ring = ring.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("of", "share"))).getField("share").alias("v"))
    first = o.su_min_reads // o.su_every + o.su_samples
    out = vec.join(ring, "block").select((F.col("block") + 1).alias("est"), "n_reads", F.when(F.col("block") >= first, F.round(F.expr(_DISTANCE), 9)).alias("distance"))
    return out.withColumn("stop", F.coalesce(F.col("distance") <= o.su_threshold, F.lit(False)))
