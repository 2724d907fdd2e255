"""Further registered queries: sketches, indexes, joins, chains, warping, evaluation, runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signal_math import hash64, quantize
from ..operators import align, chain, dtw, evaluate, mapper, mapping, sketch
from ..operators.collapse import collapse
from ..options import options
from ..work import stash, work_dir
from ..sources import index as stored_index
from ..streaming import until
from ..streaming.reads import rare_index, stream_map
from ..streaming.signals import SignalRun, chunk_files
from .catalogue import _ANCHORS, _BINS, _PORE, _Q, _S, _T, _Z, _anchors, _hash_ctes, _located, _pore, _quantize_sql, _query, _samples, _seed_ctes, _table, q03_zscore_clip

DIFF, GRAM, WINDOW = 0.35, 6, 5
SPAN = sketch.K + sketch.GRAM - 1


def _seeds(spark: SparkSession, sf_dir: str, name: str, key: str, **how) -> DataFrame:
    return sketch.seeds(_table(spark, sf_dir, name), key, **how)


def _items(spark, sf_dir, **how):
    return _seeds(spark, sf_dir, "benchmark", "item_id", **how)


def _docs(spark, sf_dir, **how):
    return _seeds(spark, sf_dir, "documents", "doc_id", **how)


@_query(f"WITH {_S}, g AS (SELECT read_id, pos // 16 AS seg, list_sort(list(pa)) AS v FROM s GROUP BY ALL), b AS (SELECT *, v[len(v) // 4 + 1] AS lo, v[3 * len(v) // 4 + 1] AS hi FROM g) SELECT read_id, seg::BIGINT AS seg, round(list_avg(list_filter(v, lambda x: x >= lo - (hi - lo) AND x <= hi + (hi - lo))), 6) AS ev FROM b")
def q09_segment_iqr_mean(spark, sf_dir):
    g = _samples(spark, sf_dir).groupBy("read_id", F.floor(F.col("pos") / 16).cast("long").alias("seg")).agg(F.array_sort(F.collect_list("pa")).alias("v"))
    b = g.withColumn("lo", F.expr("v[int(floor(size(v) / 4))]")).withColumn("hi", F.expr("v[int(floor(3 * size(v) / 4))]"))
    return b.select("read_id", "seg", F.expr("round(aggregate(filter(v, x -> x >= lo - (hi - lo) and x <= hi + (hi - lo)), (0D as s, 0 as n), (a, x) -> (a.s + x as s, a.n + 1 as n), a -> a.s / a.n), 6)").alias("ev"))


_KMER = f"{_Q}, ks AS (SELECT id, (p - 1)::INT AS pos, code::BIGINT AS code FROM qsk WHERE code IS NOT NULL)"


@_query(f"WITH {_PORE}, {_KMER} SELECT id, pos, code FROM ks")
def q10_kmer_codes(spark, sf_dir):
    return sketch.kmers(_table(spark, sf_dir, "benchmark"), "item_id").select("id", "pos", "code")


@_query(f"WITH {_PORE}, {_KMER} SELECT id, pos, ({' + '.join(f'(3 - ((code >> {2 * i}) & 3)) * {4 ** (5 - i)}' for i in range(6))})::BIGINT AS rc_code FROM ks")
def q11_revcomp_kmers(spark, sf_dir):
    return sketch.kmers(_table(spark, sf_dir, "benchmark"), "item_id").select("id", "pos", "rc_code")


@_query(f"WITH {_PORE}, {_KMER} SELECT id, pos, round(z, 6) AS level FROM ks JOIN pore USING (code)")
def q13_expected_events(spark, sf_dir):
    return sketch.kmers(_table(spark, sf_dir, "benchmark"), "item_id").select("id", "pos", F.round("level", 6).alias("level"))


_KEPT = f"{_Z.replace('WITH ', 'WITH RECURSIVE ', 1)}, zn AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS rn FROM z), r AS (SELECT read_id, pos, z, rn, z AS last, true AS keep FROM zn WHERE rn = 1 UNION ALL SELECT n.read_id, n.pos, n.z, n.rn, CASE WHEN abs(n.z - r.last) >= {DIFF}::DOUBLE THEN n.z ELSE r.last END, abs(n.z - r.last) >= {DIFF}::DOUBLE FROM r JOIN zn n ON n.read_id = r.read_id AND n.rn = r.rn + 1), kept AS (SELECT read_id, pos, z, (row_number() OVER (PARTITION BY read_id ORDER BY pos) - 1)::INT AS ev FROM r WHERE keep)"


def _kept(spark, sf_dir):
    return collapse(q03_zscore_clip(spark, sf_dir), DIFF)


@_query(f"{_KEPT} SELECT read_id, pos, z, ev FROM kept")
def q16_collapse_kept(spark, sf_dir):
    return _kept(spark, sf_dir)


@_query(f"{_KEPT}, kb AS (SELECT read_id, pos, ev, {_quantize_sql('z', 0.4)} AS b FROM kept), kg AS (SELECT read_id, pos, {' + '.join(f'(lead(b, {i}) OVER w)::BIGINT * {16 ** (GRAM - 1 - i)}' for i in range(GRAM))} AS gram FROM kb WINDOW w AS (PARTITION BY read_id ORDER BY ev)) SELECT read_id, pos, gram FROM kg WHERE gram IS NOT NULL")
def q17_egram_pack(spark, sf_dir):
    w = Window.partitionBy("read_id").orderBy("ev")
    rows = _kept(spark, sf_dir).withColumn("b", quantize(F.col("z")).cast("long"))
    gram = sum((F.lead("b", i).over(w) * 16 ** (GRAM - 1 - i) for i in range(1, GRAM)), F.col("b") * 16 ** (GRAM - 1))
    return rows.select("read_id", "pos", gram.alias("gram")).where("gram IS NOT NULL")


def _minimizer_ctes(n: str, w: int = WINDOW) -> str:
    return f"{n}a AS (SELECT *, CASE WHEN count(*) OVER x = {w} THEN min(hash) OVER x END AS m, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY hash, pos DESC) AS rk FROM {n} WINDOW x AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)), {n}b AS (SELECT *, max(m) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS top FROM {n}a), {n}m AS (SELECT id, pos, hash FROM {n}b WHERE CASE WHEN n >= {w} THEN top = hash ELSE rk = 1 END)"


@_query(f"WITH {_PORE}, {_Q}, {_minimizer_ctes('qs')} SELECT id, pos, hash FROM qsm")
def q20_minimizers(spark, sf_dir):
    return _items(spark, sf_dir, w=WINDOW)


@_query(f"WITH {_PORE}, {_T}, {_minimizer_ctes('ts')} SELECT hash, count(*)::BIGINT AS n_occ, min(id) AS first_id, max(id) AS last_id, sum(pos)::BIGINT AS pos_sum FROM tsm GROUP BY hash")
def q21_index_postings(spark, sf_dir):
    return _docs(spark, sf_dir, w=WINDOW).groupBy("hash").agg(F.count("*").alias("n_occ"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("pos").alias("pos_sum"))


@_query(f"WITH {_PORE}, {_T} SELECT 6 AS k, 8 AS e, 4 AS q, 0 AS w, (SELECT count(*) FROM documents)::BIGINT AS n_seq, count(*)::BIGINT AS n_seeds, count(DISTINCT hash)::BIGINT AS n_hashes FROM ts")
def q22_index_summary(spark, sf_dir):
    s = mapping.occurrences(_docs(spark, sf_dir)).agg(F.lit(0).cast("long").alias("n_seq"), F.coalesce(F.sum("n_occ"), F.lit(0)).alias("n_seeds"), F.count("*").alias("n_hashes"))
    n = _table(spark, sf_dir, "documents").agg(F.count("*").alias("n_seq"), F.lit(0).cast("long").alias("n_seeds"), F.lit(0).cast("long").alias("n_hashes"))
    const = [F.lit(v).alias(c) for c, v in (("k", sketch.K), ("e", sketch.GRAM), ("q", 4), ("w", 0))]
    return s.unionByName(n).agg(*[F.sum(c).alias(c) for c in ("n_seq", "n_seeds", "n_hashes")]).select(*const, "n_seq", "n_seeds", "n_hashes")


@_query(f"WITH {_PORE}, {_T}, o AS (SELECT count(*) AS n_occ FROM ts GROUP BY hash), r AS (SELECT n_occ, row_number() OVER (ORDER BY n_occ) - 1 AS i, count(*) OVER () AS n FROM o) SELECT least(greatest(n_occ + 1, 50), 500000)::BIGINT AS mid_occ FROM r WHERE i = floor((1 - 0.01)::DOUBLE * n)")
def q24_mid_occ(spark, sf_dir):
    return mapping.mid_occ(_docs(spark, sf_dir))


@_query(f"WITH {_PORE}, {_Q}, {_T}, a AS (SELECT hash, id AS qid, count(*) AS nq FROM qs GROUP BY ALL), b AS (SELECT hash, id AS tid, count(*) AS nt FROM ts GROUP BY ALL) SELECT qid, tid, sum(nq * nt)::BIGINT AS n_anchors FROM a JOIN b USING (hash) GROUP BY ALL")
def q25_seed_join(spark, sf_dir):
    return mapping.match_counts(_items(spark, sf_dir), _docs(spark, sf_dir))


@_query(f"WITH {_PORE}, {_Q} SELECT id, pos, coalesce(lag(hash) OVER w = hash, false) OR coalesce(lead(hash) OVER w = hash, false) AS tandem FROM qs WINDOW w AS (PARTITION BY id ORDER BY pos)")
def q27_tandem_flags(spark, sf_dir):
    return mapping.tandem(_items(spark, sf_dir)).select("id", "pos", "tandem")


_OFTEN = 5
_REP = f"f AS (SELECT hash FROM ts GROUP BY hash HAVING count(*) > {_OFTEN}), cv AS (SELECT DISTINCT id AS qid, unnest(range(pos + 1, pos + 2 + {SPAN})) AS x FROM qs SEMI JOIN f USING (hash)), rep AS (SELECT qid, count(*)::BIGINT AS rep_len FROM cv GROUP BY qid)"


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_REP} SELECT qid, rep_len FROM rep")
def q28_repeat_length(spark, sf_dir):
    return mapping.repeat_length(mapping.share(_items(spark, sf_dir), _docs(spark, sf_dir), _OFTEN), SPAN)


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Anchors, written, and repeat lengths from one sketch of both tables and one count of
    their hashes; all that a query derives from mappings starts here."""
    anchors, shared = _located(spark, sf_dir)
    return stash(anchors, "anchors"), mapping.repeat_length(replace(shared, max_occ=_OFTEN), SPAN)


@_query(f"WITH {_PORE}, {_T}, {_minimizer_ctes('ts')}, o AS (SELECT hash FROM tsm GROUP BY hash HAVING count(*) BETWEEN 2 AND 10), r AS (SELECT * FROM tsm SEMI JOIN o USING (hash)) SELECT a.id AS qid, b.id AS tid, count(*)::BIGINT AS n FROM r a JOIN r b USING (hash) WHERE a.id::VARCHAR < b.id::VARCHAR GROUP BY ALL")
def q29_allpairs_overlap(spark, sf_dir):
    return mapping.all_pairs(_docs(spark, sf_dir, w=WINDOW), 10).groupBy("qid", "tid").agg(F.count("*").alias("n"))


@_query(f"WITH {_PORE}, {_Q} SELECT id, pos, hash FROM (SELECT *, count(*) OVER (PARTITION BY id, hash) AS m, count(*) OVER (PARTITION BY id) AS n FROM qs) WHERE m <= 0.01::DOUBLE * n")
def q30_query_freq_filter(spark, sf_dir):
    return mapping.frequent_in_read(_items(spark, sf_dir), 0.01).select("id", "pos", "hash")


_GAP = options().gap
_COST = f"trunc({_GAP!r}::DOUBLE * dd + 0.5::DOUBLE * (CASE WHEN dd >= 1 THEN log2(dd + 1) ELSE 0 END))"


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, pr AS (SELECT qid, tid, q_pos, t_pos, q_pos - lag(q_pos) OVER w AS dq, t_pos - lag(t_pos) OVER w AS dr FROM an WINDOW w AS (PARTITION BY qid, tid ORDER BY t_pos, q_pos)), d AS (SELECT *, abs(dr - dq) AS dd, least(dr, dq) AS dg FROM pr) SELECT qid, tid, q_pos, t_pos, (least({SPAN}, dg) - CASE WHEN dd <> 0 OR dg > {SPAN} THEN {_COST} ELSE 0 END)::BIGINT AS score FROM d WHERE dq > 0 AND dq <= 2500 AND dr > 0 AND dr <= 2500 AND dd <= 500")
def q31_pair_scores(spark, sf_dir):
    w = Window.partitionBy("qid", "tid").orderBy("t_pos", "q_pos")
    score = chain.pair_score(F.col("q_pos") - F.lag("q_pos").over(w), F.col("t_pos") - F.lag("t_pos").over(w), options())
    return _anchors(spark, sf_dir).select("qid", "tid", "q_pos", "t_pos", score.alias("score")).where("score IS NOT NULL")


def _plus(anchors: DataFrame) -> DataFrame:
    return anchors.withColumn("rev", F.lit(0))


@_query()
def q32_chain_dp(spark, sf_dir):
    return chain.chains(_plus(_anchors(spark, sf_dir)), options())


@_query()
def q33_chain_rmq(spark, sf_dir):
    return chain.chains(_plus(_anchors(spark, sf_dir)), options(rmq=True))


_REG = "reg AS (SELECT qid, tid, floor((t_pos - q_pos) / 25.0)::BIGINT AS bin, count(*)::BIGINT AS score, min(q_pos) AS qs, max(q_pos) + 1 AS qe, min(t_pos) AS rs, max(t_pos) + 1 AS re FROM an GROUP BY ALL HAVING count(*) >= 2), rk AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid, bin) - 1)::INT AS rank FROM reg)"


def _regions(anchors: DataFrame) -> DataFrame:
    places = [F.min("q_pos").alias("qs"), (F.max("q_pos") + 1).alias("qe"), F.min("t_pos").alias("rs"), (F.max("t_pos") + 1).alias("re")]
    bins = F.floor((F.col("t_pos") - F.col("q_pos")) / 25).cast("long").alias("bin")
    return anchors.groupBy("qid", "tid", bins).agg(F.count("*").alias("score"), *places).where("score >= 2")


def _band_ranks(regions: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "tid", "bin")
    return regions.withColumn("rank", F.row_number().over(w) - 1)


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG} SELECT qid, tid, bin, score, qs, qe, rs, re FROM reg")
def q34_chain_regions(spark, sf_dir):
    return _regions(_anchors(spark, sf_dir))


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG} SELECT qid, tid, bin, score, rank FROM rk")
def q35_chain_rank(spark, sf_dir):
    return _band_ranks(_regions(_anchors(spark, sf_dir))).select("qid", "tid", "bin", "score", "rank")


@_query()
def q36_primary_secondary(spark, sf_dir):
    o = options(best_n=5)
    return chain.primaries(chain.chains(_plus(_anchors(spark, sf_dir)), o), o)


_QUAL = f"{_REP}, sc AS (SELECT rk.*, coalesce(rep_len, 0) AS rep_len, sum(score) OVER w AS total, coalesce(max(score) FILTER (rank > 0) OVER w, 0) AS sub, count(*) FILTER (rank > 0 AND score >= 30) OVER w AS nsub FROM rk LEFT JOIN rep USING (qid) WINDOW w AS (PARTITION BY qid)), mq AS (SELECT *, greatest(least((trunc(least((CASE WHEN score > 100 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE * score END) * (total / (total + rep_len)), CASE WHEN score > 10 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE * score END) * 40 * (1 - greatest(sub, 15) / score) * ln(score)) - trunc(4.343::DOUBLE * ln(nsub + 1.0) + 0.499::DOUBLE))::INT, 60), 0) AS mapq FROM sc WHERE rank = 0)"


def _qualities(regions: DataFrame, rep: DataFrame) -> DataFrame:
    """The best band of each query; the others count as its secondaries."""
    w = Window.partitionBy("qid")
    other = F.col("rank") > 0
    rows = _band_ranks(regions).join(rep, "qid", "left").fillna(0, ["rep_len"])
    rows = rows.select("*", F.sum("score").over(w).alias("total"), F.coalesce(F.max(F.when(other, F.col("score"))).over(w), F.lit(0)).alias("sub"), F.count(F.when(other & (F.col("score") >= 30), 1)).over(w).alias("nsub"))
    q = chain.mapq(F.col("score"), F.col("score"), F.col("sub"), F.col("nsub"), F.col("total"), F.col("rep_len"), options())
    return rows.where("rank = 0").withColumn("mapq", q)


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG}, {_QUAL} SELECT qid, tid, score, sub, nsub, mapq FROM mq")
def q37_mapq(spark, sf_dir):
    anchors, rep = _run(spark, sf_dir)
    return _qualities(_regions(anchors), rep).select("qid", "tid", "score", "sub", "nsub", "mapq")


_DEC = "cq AS (SELECT qid, count(*) AS n, avg(score) AS mc FROM rk GROUP BY qid), dec AS (SELECT mq.*, n, (n = 1 AND mapq >= 2) OR (n > 1 AND 0.35::DOUBLE * least(mapq / 30, 1.0::DOUBLE) + 0.05::DOUBLE * (CASE WHEN mapq > 0 THEN greatest(0, 1 - (mapq / n) / mapq) ELSE 0 END) + 0.6::DOUBLE * (CASE WHEN score > 0 THEN greatest(0, 1 - mc / score) ELSE 0 END) >= 0.45::DOUBLE) OR mapq > 2 AS mapped FROM mq JOIN cq USING (qid))"


def _decisions(anchors: DataFrame, rep: DataFrame) -> DataFrame:
    regions = stash(_regions(anchors), "regions")
    n = regions.groupBy("qid").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    yes = chain.mapped(F.col("n"), F.col("mapq"), F.col("mapq") / F.col("n"), F.col("score"), F.col("mean_score"), options())
    return _qualities(regions, rep).join(n, "qid").withColumn("mapped", yes)


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG}, {_QUAL}, {_DEC} SELECT qid, tid, n, mapq, mapped FROM dec")
def q38_decision(spark, sf_dir):
    return _decisions(*_run(spark, sf_dir)).select("qid", "tid", "n", "mapq", "mapped")


_LEN = "length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
_PAFSQL = f"pf AS (SELECT i.item_id::BIGINT AS qid, {_LEN} AS q_len, d.* EXCLUDE (qid) FROM benchmark i LEFT JOIN (SELECT * FROM dec WHERE mapped) d ON d.qid = i.item_id), tl AS (SELECT doc_id::BIGINT AS tid, {_LEN} AS t_len FROM documents)"


def _paf_rows(spark, sf_dir, run: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    reads = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("qid"), mapper.n_letters().alias("q_len"))
    lengths = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("tid"), mapper.n_letters().alias("t_len"))
    best = _decisions(*(run or _run(spark, sf_dir))).where("mapped").withColumns({"rev": F.lit(0), "cnt": F.col("score"), "nc": F.col("n")}).join(lengths, "tid")
    return reads.join(best, "qid", "left")


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG}, {_QUAL}, {_DEC}, {_PAFSQL} SELECT qid, concat_ws(chr(9), qid, q_len, qs, qe, '+', tid, t_len, rs, re, qe - qs - 1, re - rs, mapq, 'mt:f:0.000000', 'ci:i:1', 'sl:i:' || q_len, 'cm:i:' || score, 'nc:i:' || n, 's1:i:' || score, 'sm:f:0') AS line FROM pf JOIN tl USING (tid)")
def q39_paf_rows(spark, sf_dir):
    return mapping.paf(_paf_rows(spark, sf_dir).where("tid IS NOT NULL"))


@_query(f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG}, {_QUAL}, {_DEC}, {_PAFSQL} SELECT qid, concat_ws(chr(9), qid, q_len, '*', '*', '*', '*', '*', '*', '*', '*', '*', 0, 'mt:f:0.000000', 'ci:i:1', 'sl:i:' || q_len, 'cm:i:0', 'nc:i:0', 's1:i:0', 'sm:f:0') AS line FROM pf WHERE tid IS NULL")
def q40_paf_unmapped(spark, sf_dir):
    return mapping.paf(_paf_rows(spark, sf_dir).where("tid IS NULL"))


def _vector_pairs(spark, sf_dir, cut: int = 0):
    """Each vector and the next one by number; ``cut`` values off the ends of the first."""
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    a = F.expr(f"slice(embedding, {cut + 1}, greatest(size(embedding) - {2 * cut}, 0))") if cut else F.col("embedding")
    return v.select("vec_id", a.alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.round("cost", 6))


@_query()
def q41_dtw_global(spark, sf_dir):
    return _rounded(dtw.distances(_vector_pairs(spark, sf_dir), ["vec_id"]))


@_query()
def q42_dtw_semiglobal(spark, sf_dir):
    return _rounded(dtw.distances(_vector_pairs(spark, sf_dir, 16), ["vec_id"], semiglobal=True))


@_query()
def q43_dtw_banded(spark, sf_dir):
    return _rounded(dtw.distances(_vector_pairs(spark, sf_dir, 4), ["vec_id"], band=0.1))


@_query()
def q44_dtw_traceback(spark, sf_dir):
    return dtw.paths(_vector_pairs(spark, sf_dir), ["vec_id"])


@_query()
def q45_dtw_rescore(spark, sf_dir):
    """The chains of the items, each scored again between its anchors, over the events of the
    documents in blocks."""
    o = options(dtw="sparse")
    events = stash(align.text_events(_table(spark, sf_dir, "documents"), "doc_id", o, reverse=False), "events")
    rows = mapper.selected(_plus(_anchors(spark, sf_dir)), o, align.text_reads(_table(spark, sf_dir, "benchmark"), "item_id", o), events)
    return rows.select("qid", "rank", "tid", "score", "n_aligned", *[F.round(c, 6).alias(c) for c in ("cost", "alignment_score")])


@_query()
def q68_map_aligned(spark, sf_dir):
    """Items mapped by alignment scores to an index of the documents that was saved with
    their events."""
    at = work_dir(spark, "saved-index")
    stored_index.save(_table(spark, sf_dir, "documents"), "doc_id", at, options("fast", dtw="sparse"), events=True)
    stored, o = stored_index.load(spark, at)
    return mapper.map_stored(_table(spark, sf_dir, "benchmark"), "item_id", stored, o)


#: Tool: the decided bands; truth: the best band of 15 anchors or more. Both with every item.
_EVAL = f"WITH {_PORE}, {_Q}, {_T}, {_ANCHORS}, {_REG}, {_QUAL}, {_DEC}, {_BINS}, tool AS (SELECT item_id::BIGINT AS qid, tid, qs, qe, {_LEN} AS q_len FROM benchmark LEFT JOIN (SELECT * FROM dec WHERE mapped) d ON d.qid = item_id), truth AS (SELECT item_id::BIGINT AS qid, tid FROM benchmark LEFT JOIN (SELECT qid, tid FROM bins WHERE cnt >= 15 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cnt DESC, tid, bin) = 1) b ON b.qid = item_id)"
_LABELLED = "m AS (SELECT qid, tid, bool_or(f) AS f, bool_or(r) AS r FROM (SELECT qid, tid, true AS f, false AS r FROM tool UNION ALL SELECT qid, tid, false, true FROM truth) GROUP BY ALL), lb AS (SELECT CASE WHEN tid IS NULL THEN 'tn' WHEN f AND r THEN 'tp' WHEN f THEN 'fp' ELSE 'fn' END AS label FROM m), c AS (SELECT count(*) FILTER (label = 'tp') AS tp, count(*) FILTER (label = 'fp') AS fp, count(*) FILTER (label = 'fn') AS fn, count(*) FILTER (label = 'tn') AS tn FROM lb)"


def _tool_and_truth(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Mappings of the items by the decision over bands, and by the best large band."""
    run = _run(spark, sf_dir)
    tool = _paf_rows(spark, sf_dir, run).select("qid", "tid", "qs", "qe", "q_len")
    best = mapping.best_placement(mapping.diagonal_bins(run[0])).select("qid", "tid")
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("qid"))
    return tool, items.join(best, "qid", "left")


@_query(f"{_EVAL}, {_LABELLED} SELECT label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lb GROUP BY label")
def q46_confusion(spark, sf_dir):
    counts = evaluate.classified(*_tool_and_truth(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@_query(f"{_EVAL}, {_LABELLED}, p AS (SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS a, coalesce(tp / nullif(tp + fn, 0), 0) AS b FROM c) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(a, 6) AS prec, round(b, 6) AS rec, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM p")
def q47_prf1(spark, sf_dir):
    c = evaluate.confusion(evaluate.classified(*_tool_and_truth(spark, sf_dir)))
    return c.select("tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("prec", "rec", "f1")])


@_query("SELECT l_returnflag AS tool, round(avg(l_extendedprice), 3) AS mean_time, round(median(l_extendedprice), 3) AS median_time, round(avg(l_extendedprice / l_quantity), 3) AS mean_chunk_time, round(median(l_extendedprice / l_quantity), 3) AS median_chunk_time FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def q49_time_per_chunk(spark, sf_dir):
    """Return flags for tools, prices for milliseconds, quantities for chunks."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_extendedprice").alias("mt"), F.col("l_quantity").alias("ci"))
    names = ("mean_time", "median_time", "mean_chunk_time", "median_chunk_time")
    return evaluate.times(rows, ["tool"]).select("tool", *[F.round(c, 3).alias(c) for c in names])


@_query(f"{_EVAL} SELECT count(*)::BIGINT AS n, round(avg(q_len), 6) AS mean_all, round(avg(q_len) FILTER (tid IS NOT NULL), 6) AS mean_mapped, round(avg(q_len) FILTER (tid IS NULL), 6) AS mean_unmapped FROM tool")
def q50_bases_mapped_unmapped(spark, sf_dir):
    tool, _ = _tool_and_truth(spark, sf_dir)
    return evaluate.sequenced(tool).select("n", *[F.round(c, 6).alias(c) for c in ("mean_all", "mean_mapped", "mean_unmapped")])


@_query(f"{_EVAL}, g AS (SELECT coalesce(source, 'none') AS target, count(*) AS reads, sum(qe - qs) AS b FROM tool JOIN documents ON doc_id = tid WHERE qe >= qs GROUP BY 1) SELECT target, reads::BIGINT AS reads, round(reads / sum(reads) OVER (), 6) AS read_share, round(b / sum(b) OVER (), 6) AS base_share FROM g")
def q51_relative_abundance(spark, sf_dir):
    """Mapped items by the source of their documents."""
    tool, _ = _tool_and_truth(spark, sf_dir)
    rows = tool.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("tid"), "source"), "tid")
    g = evaluate.relative_abundance(rows, F.coalesce("source", F.lit("none")))
    return g.select("target", "reads", F.round("read_share", 6).alias("read_share"), F.round("base_share", 6).alias("base_share"))


@_query(f"{_EVAL} SELECT count(*) FILTER (m = t)::BIGINT AS tp, count(*) FILTER ((t IS NOT NULL AND m IS DISTINCT FROM t) OR (t IS NULL AND m IS NOT NULL))::BIGINT AS fp, count(*) FILTER (t IS NOT NULL AND m IS NULL)::BIGINT AS fn, count(*) FILTER (t IS NULL AND m IS NULL)::BIGINT AS tn FROM (SELECT tool.tid AS m, truth.tid AS t FROM tool JOIN truth USING (qid))")
def q52_abundance_accuracy(spark, sf_dir):
    return evaluate.abundance_accuracy(*_tool_and_truth(spark, sf_dir))


@_query()
def q53_sequence_until(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.col("event_type").alias("target"), F.col("value").alias("length"))
    return until.estimates(e, options(su_every=100, su_min_reads=100))


@_query(f"{_Z} SELECT read_id, string_agg({_quantize_sql('z', 0.4)}, ',' ORDER BY pos) AS buckets FROM z GROUP BY read_id")
def q54_out_quantize(spark, sf_dir):
    z = q03_zscore_clip(spark, sf_dir).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("pos", quantize(F.col("z")).alias("b")))).alias("s"))
    return z.select("read_id", F.array_join(F.col("s.b").cast("array<string>"), ",").alias("buckets"))


@_query(f"WITH d AS (SELECT DISTINCT doc_id::BIGINT AS doc_id FROM documents), {_hash_ctes('d', 'doc_id', 'doc_id', 'h')} SELECT doc_id FROM h7 ORDER BY k, doc_id LIMIT 50")
def q55_deterministic_sample(spark, sf_dir):
    """A sample of fixed size: the documents of the 50 smallest hashes."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(hash64(F.col("doc_id")), "doc_id").limit(50)


@_query()
def q56_map_end_to_end(spark, sf_dir):
    return mapper.map_reads(_table(spark, sf_dir, "benchmark"), "item_id", _table(spark, sf_dir, "documents"), "doc_id", options())


@_query()
def q57_overlap_end_to_end(spark, sf_dir):
    return mapper.overlap(_table(spark, sf_dir, "documents"), "doc_id", options("ava"))


@_query(f"WITH {_PORE}, {_T} SELECT code::BIGINT AS code, count(*)::BIGINT AS n, round(z, 6) AS z FROM tsk JOIN pore USING (code) GROUP BY code, z")
def q12_pore_zscore(spark, sf_dir):
    """The z-scored level of each k-mer that the documents have, and how often they have it."""
    k = sketch.kmers(_table(spark, sf_dir, "documents"), "doc_id")
    return k.groupBy("code", "level").agg(F.count("*").alias("n")).select("code", "n", F.round("level", 6).alias("z"))


@_query(f"WITH {_PORE}, {_seed_ctes('benchmark', 'item_id', 'vs', 6)} SELECT id, pos, hash FROM vs")
def q63_sketch_viral(spark, sf_dir):
    return _items(spark, sf_dir, o=options("viral", diff=0.0))


@_query(f"WITH {_pore(0.6)}, {_seed_ctes('benchmark', 'item_id', 'fs', 11)}, {_minimizer_ctes('fs', 3)} SELECT id, pos, hash FROM fsm")
def q64_sketch_faster(spark, sf_dir):
    return _items(spark, sf_dir, o=options("faster", diff=0.0))


def _simulated(spark, sf_dir) -> DataFrame:
    """Raw signals of the items, ``(read_id, pos, pa)``: the level of each k-mer held for nine
    samples with a little noise from a hash, as picoamperes."""
    k = sketch.kmers(_table(spark, sf_dir, "benchmark"), "item_id")
    rows = k.select(F.col("id").alias("read_id"), "level", "pos", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    noise = (F.pmod(F.xxhash64("read_id", "pos", "i"), F.lit(1000)) - 500) / 5000.0
    return rows.select("read_id", (F.col("pos") * 9 + F.col("i")).alias("pos"), (90.0 + 12.0 * (F.col("level") + noise)).alias("pa"))


def _signal_options():
    return options("viral", diff=0.0, fine_range=0.4, min_mapq=1)


@_query()
def q59_map_signals(spark, sf_dir):
    """Items as raw signals, mapped through chunks, events, seeds and chains to the documents."""
    o = _signal_options()
    docs = _table(spark, sf_dir, "documents")
    lengths = docs.select(F.col("doc_id").cast("long").alias("tid"), mapper.n_letters().alias("t_len"))
    return mapper.map_signals(_simulated(spark, sf_dir), mapper.text_index(docs, "doc_id", o), lengths, o)


@_query()
def q60_signal_targets(spark, sf_dir):
    """The values of users as signals, each mapped to an index of those signals."""
    o = options("viral", seg_thresholds=(1.5, 1.5), min_events=0, diff=0.0, e=4)
    samples = _samples(spark, sf_dir)
    lengths = samples.groupBy(F.col("read_id").alias("tid")).agg(F.count("*").cast("int").alias("t_len"))
    return mapper.map_signals(samples, mapper.signal_index(samples, o), lengths, o, signal_targets=True)


@_query()
def q61_tool_comparison(spark, sf_dir):
    """Presets as tools, against the mapping of the texts by the best large band."""
    _, truth = _tool_and_truth(spark, sf_dir)
    tools = {}
    for preset in ("sensitive", "fast", "viral"):
        rows = mapper.map_reads(_table(spark, sf_dir, "benchmark"), "item_id", _table(spark, sf_dir, "documents"), "doc_id", options(preset))
        tools[preset] = rows.select("qid", "tid", "q_len", F.lit(1.0).alias("mt"), F.lit(1).alias("ci"), F.col("q_len").alias("sl"))
    out = evaluate.compared(tools, stash(truth, "truth"))
    return out.select("tool", *evaluate.LABELS, *[F.round(c, 6).alias(c) for c in ("prec", "rec", "f1", "mean_all", "mean_mapped", "mean_unmapped", "mean_all_chunks")])


@_query()
def q62_contamination(spark, sf_dir):
    """Mappings with the depletion settings to the documents of one source, against the best large band."""
    docs = _table(spark, sf_dir, "documents")
    rows = mapper.map_reads(_table(spark, sf_dir, "benchmark"), "item_id", docs, "doc_id", options("viral", depletion=True))
    _, truth = _tool_and_truth(spark, sf_dir)
    first = docs.agg(F.min("source").alias("source"))
    c = evaluate.contamination(rows, truth, docs.join(F.broadcast(first), "source").select(F.col("doc_id").cast("long").alias("tid")))
    return c.select(*evaluate.LABELS, *[F.round(x, 6).alias(x) for x in ("prec", "rec", "f1")])


@_query()
def q69_run_speeds(spark, sf_dir):
    """Presets as tools: their reads, and the speeds and times that their runs measured, which
    differ from run to run."""
    tools = []
    for preset in ("sensitive", "fast"):
        rows = mapper.map_reads(_table(spark, sf_dir, "benchmark"), "item_id", _table(spark, sf_dir, "documents"), "doc_id", options(preset), timed=True)
        tools.append(stash(rows.select("qid", "q_len", "mt", "ci", "sl").withColumn("tool", F.lit(preset)), "timed"))
    rows = tools[0].unionByName(tools[1])
    counts = rows.groupBy("tool").agg(F.count("*").alias("reads"), F.sum("mt").alias("total_ms"))
    return counts.join(evaluate.throughput(rows, ["tool"]), "tool", "left").join(evaluate.times(rows, ["tool"]), "tool", "left")


@_query()
def q58_stream_map(spark, sf_dir):
    return stream_map(spark, f"{sf_dir}/benchmark.parque[t]", "item_id", _table(spark, sf_dir, "documents"), "doc_id", options("fast", chunk_size=120))


@_query()
def q67_map_stored(spark, sf_dir):
    """Items mapped to an index of the documents that was saved and loaded again."""
    at = work_dir(spark, "saved-index")
    stored_index.save(_table(spark, sf_dir, "documents"), "doc_id", at, options("fast"))
    stored, o = stored_index.load(spark, at)
    return mapper.map_stored(_table(spark, sf_dir, "benchmark"), "item_id", stored, o)


@_query()
def q66_dtw_diagonal_band(spark, sf_dir):
    """Each vector against the next within twelve places of the diagonal; the first lacks
    eight values at both ends, so the corner is sixteen places off and out of reach, but not
    for the whole ones."""
    whole = dtw.distances(_vector_pairs(spark, sf_dir), ["vec_id"], radius=12).withColumn("kind", F.lit("whole"))
    cut = dtw.distances(_vector_pairs(spark, sf_dir, 8), ["vec_id"], radius=12).withColumn("kind", F.lit("cut"))
    return _rounded(whole.unionByName(cut))


@_query()
def q65_signal_stream(spark, sf_dir):
    """Items as raw signals that arrive in chunks, three files of them, mapped as they come;
    a decided read's later chunks are neither segmented nor sketched."""
    o = replace(_signal_options(), chunk_size=800, max_chunks=8)
    chunks = work_dir(spark, "chunk-files")
    chunk_files(_simulated(spark, sf_dir), o, chunks, 3)
    index = stash(rare_index(_table(spark, sf_dir, "documents"), "doc_id", o), "index")
    return SignalRun(spark, index, o).run(chunks)
