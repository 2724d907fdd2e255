"""The registered queries over the given tables, and their DuckDB SQL.

Samples are the values of ``events`` by user and time; bases are the letters of
``documents`` and ``benchmark`` texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signal_math import hash64, quantize
from ..operators import evaluate, mapper, mapping, scan, signal, sketch
from ..options import options
from ..work import stash

FLAGSHIP = "map_passages"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("read_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("value").alias("pa"))


_S = "s AS (SELECT user_id::BIGINT AS read_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, value AS pa FROM events)"


@_query(f"WITH {_S} SELECT read_id, pos, (pa + 10.0::DOUBLE) * 0.5::DOUBLE AS pa FROM s WHERE (pa + 10.0::DOUBLE) * 0.5::DOUBLE > 30 AND (pa + 10.0::DOUBLE) * 0.5::DOUBLE < 200")
def q01_calibrate_filter(spark, sf_dir):
    return signal.calibrate(_samples(spark, sf_dir), 10.0, 0.5)


@_query("SELECT user_id::BIGINT AS read_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id")
def q02_read_stats(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("read_id")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@_query(f"WITH {_S}, m AS (SELECT read_id, avg(pa) AS a, stddev_pop(pa) AS d FROM s GROUP BY read_id) SELECT read_id, pos, round((pa - a) / d, 6) + 0.0::DOUBLE AS z FROM s JOIN m USING (read_id) WHERE d > 0 AND abs((pa - a) / d) < 3")
def q03_zscore_clip(spark, sf_dir):
    return signal.z_scores(_samples(spark, sf_dir)).withColumn("z", F.round("z", 6) + F.lit(0.0))


@_query(
    f"WITH {_S}, c AS (SELECT *, pos // 16 AS chunk_no FROM s), g AS (SELECT read_id, chunk_no, sum(count(*)) OVER w AS n, sum(sum(pa)) OVER w AS s1, sum(sum(pa * pa)) OVER w AS s2 FROM c GROUP BY read_id, chunk_no WINDOW w AS (PARTITION BY read_id ORDER BY chunk_no)) "
    "SELECT read_id, chunk_no::BIGINT AS chunk_no, pos, round((pa - s1 / n) / sqrt(s2 / n - (s1 / n) * (s1 / n)), 5) + 0.0::DOUBLE AS z FROM c JOIN g USING (read_id, chunk_no) WHERE s2 / n - (s1 / n) * (s1 / n) > 1e-9"
)
def q04_running_zscore(spark, sf_dir):
    return signal.running_z_scores(_samples(spark, sf_dir), 16).withColumn("z", F.round("z", 5) + F.lit(0.0))


@_query(f"WITH {_S} SELECT read_id, pos, round(sum(pa) OVER w, 4) AS s1, round(sum(pa * pa) OVER w, 4) AS s2 FROM s WINDOW w AS (PARTITION BY read_id ORDER BY pos)")
def q05_prefix_sums(spark, sf_dir):
    w = Window.partitionBy("read_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _samples(spark, sf_dir).select("read_id", "pos", F.round(F.sum("pa").over(w), 4).alias("s1"), F.round(F.sum(F.col("pa") * F.col("pa")).over(w), 4).alias("s2"))


def _t_sql(w: int) -> str:
    frames = f"l AS (PARTITION BY read_id ORDER BY pos ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), r AS (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    cols = ", ".join(f"count(pa) OVER {x} AS c{x}, avg(pa) OVER {x} AS m{x}, avg(pa * pa) OVER {x} AS q{x}" for x in "lr")
    return f"WITH {_S}, t AS (SELECT read_id, pos, {cols} FROM s WINDOW {frames}) SELECT read_id, pos, round(abs(mr - ml) / sqrt(greatest((ql - ml * ml + qr - mr * mr) / {w}, 1.1754943508222875e-38)), 4) AS t FROM t WHERE cl = {w} AND cr = {w}"


@_query(_t_sql(3))
def q06_tstat_short(spark, sf_dir):
    return signal.t_statistic(_samples(spark, sf_dir), 3).withColumn("t", F.round("t", 4))


@_query(_t_sql(9))
def q07_tstat_long(spark, sf_dir):
    return signal.t_statistic(_samples(spark, sf_dir), 9).withColumn("t", F.round("t", 4))


@_query()
def q08_peaks_and_events(spark, sf_dir):
    """Events of chunks of 4,000 values; thresholds for values that are noisier than signals."""
    o = options(seg_thresholds=(1.5, 1.5), min_events=0)
    return signal.events(_samples(spark, sf_dir), o).withColumn("ev", F.round("ev", 6))


def _quantize_sql(z: str, fr: float) -> str:
    c1 = (1 - fr) / 2
    return f"(trunc((CASE WHEN {z} BETWEEN -2 AND 2 THEN {fr}::DOUBLE * ((({z} + 3) / 6 - {1 / 6!r}) / {5 / 6 - 1 / 6!r}) WHEN ({z} + 3) / 6 < 0.5 THEN {fr}::DOUBLE + {c1!r}::DOUBLE * (({z} + 3) / 6) ELSE {fr + c1!r}::DOUBLE + {c1!r}::DOUBLE * (({z} + 3) / 6) END) * 15)::INT & 15)"


_Z = f"WITH {_S}, m AS (SELECT read_id, avg(pa) AS a, stddev_pop(pa) AS d FROM s GROUP BY read_id), z AS (SELECT read_id, pos, round((pa - a) / d, 6)::DOUBLE AS z FROM s JOIN m USING (read_id) WHERE d > 0 AND abs((pa - a) / d) < 3)"


def _quantized(spark, sf_dir, fr):
    return q03_zscore_clip(spark, sf_dir).select("read_id", "pos", quantize(F.col("z"), fr).alias("bucket"))


@_query(f"{_Z} SELECT read_id, pos, {_quantize_sql('z', 0.4)} AS bucket FROM z")
def q14_quantize(spark, sf_dir):
    return _quantized(spark, sf_dir, 0.4)


@_query(f"{_Z} SELECT read_id, pos, {_quantize_sql('z', 0.6)} AS bucket FROM z")
def q15_quantize_fast(spark, sf_dir):
    return _quantized(spark, sf_dir, 0.6)


def _hash_ctes(source: str, key: str, keep: str, name: str) -> str:
    """The hash, one step in each select; the last is ``<name>7`` with column k."""
    m, out, at = 4294967295, [], source
    steps = [f"{key} & {m}", f"(({m} - k) + (k << 21)) & {m}", "xor(k, k >> 24)", f"(k + (k << 3) + (k << 8)) & {m}", "xor(k, k >> 14)", f"(k + (k << 2) + (k << 4)) & {m}", "xor(k, k >> 28)", f"(k + ((k & 1) << 31)) & {m}"]
    for i, step in enumerate(steps):
        out.append(f"{name}{i} AS (SELECT {keep}, {step} AS k FROM {at})")
        at = f"{name}{i}"
    return ", ".join(out)


@_query(f"WITH o AS (SELECT l_orderkey::BIGINT AS key FROM lineitem GROUP BY 1), {_hash_ctes('o', 'key', 'key', 'h')} SELECT key, k AS hash FROM h7")
def q18_hash64(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("key")).distinct().withColumn("hash", hash64(F.col("key")))


def _pore(fine_range: float) -> str:
    return f"codes AS (SELECT range::BIGINT AS code FROM range(4096)), {_hash_ctes('codes', 'code', 'code', 'p')}, lv AS (SELECT code, (k % 10000) / 100.0::DOUBLE AS level FROM p7), st AS (SELECT avg(level) AS a, stddev_pop(level) AS d FROM lv), pore AS (SELECT code, (level - a) / d AS z FROM lv, st), pq AS (SELECT code, {_quantize_sql('z', fine_range)} AS b FROM pore)"


_PORE = _pore(0.4)


def _seed_ctes(table: str, key: str, n: str, e: int = 8) -> str:
    base = f"{n}t AS (SELECT {key}::BIGINT AS id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM {table}), {n}l AS (SELECT id, p, (ascii(s[p]) - 97) % 4 AS c FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS p FROM {n}t))"
    code = " + ".join(f"lead(c, {i}) OVER w * {4 ** (5 - i)}" for i in range(6))
    gram = " + ".join(f"(lead(b, {i}) OVER w)::BIGINT * {16 ** (e - 1 - i)}" for i in range(e))
    return f"{base}, {n}k AS (SELECT id, p, {code} AS code FROM {n}l WINDOW w AS (PARTITION BY id ORDER BY p)), {n}q AS (SELECT id, p, b FROM {n}k JOIN pq USING (code)), {n}g AS (SELECT id, p, {gram} AS gram FROM {n}q WINDOW w AS (PARTITION BY id ORDER BY p)), {n}f AS (SELECT id, (p - 1)::INT AS pos, gram FROM {n}g WHERE gram IS NOT NULL), {_hash_ctes(n + 'f', 'gram', 'id, pos', n + 'h')}, {n} AS (SELECT id, pos, k AS hash FROM {n}h7)"


_Q = _seed_ctes("benchmark", "item_id", "qs")
_T = _seed_ctes("documents", "doc_id", "ts")


@_query(f"WITH {_PORE}, {_Q} SELECT id, pos, hash FROM qs")
def q19_sketch_regular(spark, sf_dir):
    return sketch.seeds(_table(spark, sf_dir, "benchmark"), "item_id")


@_query(f"WITH {_PORE}, {_T}, o AS (SELECT hash, count(*) AS n_occ FROM ts GROUP BY hash) SELECT n_occ::BIGINT AS n_occ, count(*)::BIGINT AS n_hashes FROM o GROUP BY n_occ")
def q23_occ_histogram(spark, sf_dir):
    return mapping.occurrences(sketch.seeds(_table(spark, sf_dir, "documents"), "doc_id")).groupBy("n_occ").agg(F.count("*").alias("n_hashes"))


_LIMIT = "n_of AS (SELECT hash, count(*) AS n_occ FROM ts GROUP BY hash), mo AS (SELECT coalesce(max(least(greatest(n_occ + 1, 50), 500000)), 50) AS most FROM (SELECT n_occ, row_number() OVER (ORDER BY n_occ) - 1 AS i, count(*) OVER () AS n FROM n_of) WHERE i = floor((1 - 0.01)::DOUBLE * n))"
_ANCHORS = f"{_LIMIT}, o AS (SELECT hash FROM n_of, mo WHERE n_occ <= most), an AS (SELECT qs.id AS qid, qs.pos AS q_pos, ts.id AS tid, ts.pos AS t_pos FROM qs JOIN o USING (hash) JOIN ts USING (hash))"


def _located(spark, sf_dir) -> tuple[DataFrame, mapping.Shared]:
    """The anchors of passages and documents, and what else is known of their seeds; the
    occurrence limit follows from the index."""
    o, items = options(w=0, diff=0.0), sketch.seeds(_table(spark, sf_dir, "benchmark"), "item_id")
    index = scan.TextIndex(_table(spark, sf_dir, "documents"), "doc_id", o)
    if located := scan.locate(items, index):
        return located.anchors().drop("rev"), located.shared()
    seeds = stash(index.seeds().drop("rev"), "index")
    shared = mapping.share(items, seeds, mapper.limit_of(seeds, o))
    return mapping.match(shared), shared


def _anchors(spark, sf_dir):
    return _located(spark, sf_dir)[0]


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS} SELECT qid, q_pos, tid, t_pos FROM an")
def q26_seed_join(spark, sf_dir):
    return _anchors(spark, sf_dir).select("qid", "q_pos", "tid", "t_pos")


_BINS = "bins AS (SELECT qid, tid, floor((t_pos - q_pos) / 25.0)::BIGINT AS bin, count(*)::BIGINT AS cnt, min(t_pos) AS t_start, max(t_pos) AS t_end FROM an GROUP BY ALL)"


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_BINS} SELECT qid, tid, bin, cnt, t_start, t_end FROM bins WHERE cnt >= 15 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cnt DESC, tid, bin) = 1")
def map_passages(spark, sf_dir):
    return mapping.best_placement(mapping.diagonal_bins(_anchors(spark, sf_dir)))


@_query("SELECT l_returnflag AS tool, round(avg(1000 * l_extendedprice / l_quantity), 3) AS mean_rate, round(median(1000 * l_extendedprice / l_quantity), 3) AS median_rate FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def q48_throughput(spark, sf_dir):
    """Mappings by tool: return flags for tools, prices for bases, quantities for milliseconds."""
    t = _table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    rows = t.select(F.col("l_returnflag").alias("tool"), F.col("l_extendedprice").alias("q_len"), F.col("l_quantity").alias("mt"))
    return evaluate.throughput(rows, ["tool"]).select("tool", F.round("mean_bases", 3).alias("mean_rate"), F.round("median_bases", 3).alias("median_rate"))
