import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.functions.signal_math import pore_levels, quantize_np
from riverseed.operators import chain, dtw, mapper, mapping, sketch
from riverseed.options import PRESETS, options, parse_count
from riverseed.sources import index, signals
from riverseed.streaming import reads, until

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(42)


def letters(n, rng=RNG):
    return "".join(rng.choice(list("abcd"), n))


def brute_dtw(a, b, semi):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    if semi:
        d[0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1].min() if semi else d[-1, -1]


@pytest.mark.parametrize("semi", [False, True])
def test_dtw_against_brute_force(semi):
    for _ in range(40):
        a, b = RNG.normal(size=RNG.integers(1, 12)), RNG.normal(size=RNG.integers(1, 12))
        want = brute_dtw(a, b, semi)
        assert np.isclose(dtw.costs(a[None], b[None], semi)[0], want)
        cost, cells = dtw.path(a, b, semi)
        assert np.isclose(cost, want) and np.isclose(sum(abs(a[i] - b[j]) for i, j in cells), want)
        assert dtw.costs(a[None], b[None], band=0.1)[0] >= brute_dtw(a, b, False) - 1e-9
    assert dtw.costs(np.empty((1, 0)), np.ones((1, 3)))[0] == dtw.FAR


def test_dtw_of_empty_and_null(spark):
    rows = spark.createDataFrame([(1, [], []), (2, None, [1.0]), (3, [1.0], [1.0]), (4, [1.0, 2.0], [2.0])], "id long, a array<double>, b array<double>")
    assert {r.id: r.cost for r in dtw.distances(rows, ["id"]).collect()} == {1: 0.0, 2: dtw.FAR, 3: 0.0, 4: 1.0}


def exhaustive(t, q, o):
    """Best score that ends in each anchor, all predecessors tried one by one."""
    f = []
    for i in range(len(t)):
        best = o.span
        for j in range(i):
            s = int(chain._scores(np.array([q[i] - q[j]]), np.array([t[i] - t[j]]), o)[0])
            if s > chain.NONE:
                best = max(best, f[j] + s)
        f.append(best)
    return f


def test_chains_against_all_predecessors():
    for _ in range(20):
        n = int(RNG.integers(2, 60))
        t, q = np.sort(RNG.integers(0, 600, n)), RNG.integers(0, 600, n)
        order = np.lexsort((q, t))
        o = options(max_skips=10**6)
        assert chain.link(t[order], q[order], o)[0].tolist() == exhaustive(t[order], q[order], o)


def test_chains_are_disjoint_and_colinear(spark):
    t, q = np.r_[np.arange(0, 200, 3), np.arange(1000, 1100, 3)], np.r_[np.arange(0, 200, 3), np.arange(10, 110, 3)]
    for o in (options(min_score=10), options(min_score=10, rmq=True)):
        assert [x[1:6] for x in chain.chains_of(t, q, o)] == [(67, 0, 199, 0, 199), (34, 10, 110, 1000, 1100)]
    rows = spark.createDataFrame([(1, 7, 0, int(a), int(b)) for a, b in zip(t, q)] + [(2, 7, 0, 5, 5)], "qid long, tid long, rev int, t_pos int, q_pos int")
    got = chain.chains(rows, options(min_score=10)).orderBy("qs").collect()
    assert [(r.qid, r.cnt, r.rs) for r in got] == [(1, 67, 0), (1, 34, 1000)]
    assert chain.chains(rows.where("false"), options()).count() == 0


def test_parents():
    o = options()
    assert chain.parents_of([(0, 100, 90, 20), (10, 90, 50, 20), (200, 300, 40, 5)], o) == [[0, 50, 1], [0, 0, 0], [2, 0, 0]]
    assert chain.parents_of([], o) == []


def test_minimizers_by_definition():
    for n in (0, 1, 3, 5, 40):
        h = RNG.integers(0, 9, n)
        got = sketch.minimizers(h, 5).tolist()
        if n >= 5:
            assert got == [i for i in range(n) if any(h[i] == h[s : s + 5].min() for s in range(max(0, i - 4), min(i, n - 5) + 1))]
        else:
            assert len(got) == min(n, 1)


def test_kept_compares_with_the_last_kept():
    assert sketch.kept(np.array([0, 0.2, 0.4, 0.5, 1.0]), 0.35).tolist() == [0, 2, 4]
    assert sketch.kept(np.array([]), 0.35).tolist() == []


def test_reverse_strand_is_the_complement():
    base = sketch.bases(b"abcdbbac")
    assert sketch.bases(b"abcdbbac", 1).tolist() == (3 - base[::-1]).tolist()
    assert sketch.revcomp_codes(sketch.kmer_codes(base)).tolist() == sketch.kmer_codes(sketch.bases(b"abcdbbac", 1))[::-1].tolist()


def test_map_both_strands(spark):
    flip = str.maketrans("abcd", "dcba")
    a, b = letters(900), letters(700)
    reads_ = [(1, a[200:500]), (2, b[100:400][::-1].translate(flip)), (3, letters(300)), (4, None), (5, "")]
    q = spark.createDataFrame(reads_, "id long, text string")
    t = spark.createDataFrame([(10, a), (11, b), (12, None)], "id long, text string")
    got = {r.qid: r for r in mapper.map_reads(q, "id", t, "id", options()).collect()}
    assert len(got) == 5 and (got[1].tid, got[1].rev, got[2].tid, got[2].rev) == (10, 0, 11, 1)
    assert abs(got[1].rs - 200) < 25 and abs(got[2].rs - 100) < 25 and abs(got[2].re - 400) < 25
    assert [got[i].tid for i in (3, 4, 5)] == [None] * 3


def test_overlap_takes_each_pair_once(spark):
    a = letters(1500)
    rows = spark.createDataFrame([(1, a[:1000]), (2, a[500:]), (3, letters(800))], "id long, text string")
    got = mapper.overlap(rows, "id", options("ava-large")).collect()
    assert {(r.qid, r.tid) for r in got} == {(1, 2)} and abs(max(r.qe - r.qs for r in got) - 500) < 60


def test_repeat_length(spark):
    q = spark.createDataFrame([(1, 0, 5), (1, 3, 5), (1, 50, 5), (1, 70, 6)], "id long, pos int, hash long")
    t = spark.createDataFrame([(9, i, 5) for i in range(4)] + [(9, 9, 6)], "id long, pos int, hash long")
    assert [tuple(r) for r in mapping.repeat_length(mapping.share(q, t, 3), 10).collect()] == [(1, 3 + 11 + 11)]


def test_paf_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 50, 2, 40, 0, 7, 900, 10, 48, 9, 60, 33), (2, 20, *[None] * 10)], "qid long, q_len int, qs int, qe int, rev int, tid long, t_len int, rs int, re int, cnt int, mapq int, score int")
    rows = rows.withColumns({"mt": F.when(F.col("qid") == 1, 1.5), "nc": F.when(F.col("qid") == 1, 3), "sm": F.when(F.col("qid") == 1, 12.346)})
    signals.write_paf(mapping.paf(rows), f"{tmp_path}/out")
    back = signals.paf(spark, f"{tmp_path}/out").orderBy("qid").collect()
    assert (back[0].qs, back[0].n_match, back[0].block_len, back[0].cm, back[0].s1, back[0].mt, back[0].ci, back[0].sl, back[0].nc) == (2, 37, 38, 9, 33, 1.5, 1, 50, 3)
    lines = [r.line.split("\t")[12:] for r in mapping.paf(rows).orderBy("qid").collect()]
    assert lines == [["mt:f:1.500000", "ci:i:1", "sl:i:50", "cm:i:9", "nc:i:3", "s1:i:33", "sm:f:12.35"], ["mt:f:0.000000", "ci:i:1", "sl:i:20", "cm:i:0", "nc:i:0", "s1:i:0", "sm:f:0"]]
    assert back[1].tid is None and back[1].strand is None and back[1].mapq == 0


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">one first\nACGU\nac\n>two\n\nGG>T\n>three\n")
    got = [tuple(r) for r in signals.fasta(spark, str(tmp_path / "a.fa.gz")).collect()]
    assert got == [("one", "first", "ACGTac"), ("two", "", "GG>T"), ("three", "", "")]
    (tmp_path / "b.fq").write_text("@r1 x\nACGU\n+\n@@II\n@r2\nGG\n+r2\nII\n")
    assert [tuple(r) for r in signals.fastq(spark, str(tmp_path / "b.fq")).collect()] == [("r1", "x", "ACGT", "@@II"), ("r2", "", "GG", "II")]
    # in splits of some 40 bytes, with quality lines of any characters
    rng = np.random.default_rng(1)
    records = [(f"n{i}", letters(n, rng).upper(), "".join(rng.choice(list("@I+!"), n))) for i, n in enumerate(rng.integers(1, 30, 60))]
    (tmp_path / "c.fq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in records))
    for size in ("40b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = [(r.name, r.text, r.qual) for r in signals.fastq(spark, str(tmp_path / "c.fq")).collect()]
        assert sorted(got) == sorted(records), size
    (tmp_path / "p.tsv").write_text("kmer\tlevel_mean\nAA\t1\nAC\t2\nTT\t3\n")
    pore = signals.pore_model(spark, str(tmp_path / "p.tsv")).orderBy("code").collect()
    assert [r.code for r in pore] == [0, 1, 15] and abs(sum(r.level for r in pore)) < 1e-9
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.slow5").write_text("#slow5_version\t0.2.0\n@asic\tx\n#char*\tuint32_t\nr1\t0\t8192\t10\t1024\t4000\t3\t400,800,9000\n")
    row = signals.slow5(spark, str(tmp_path)).first()
    assert row.read_id == "r1" and row.signal == [51.25, 101.25]
    assert signals.format_of("x/y.pod5") == "pod5"
    with pytest.raises(ValueError):
        signals.format_of("x/y.txt")


def test_index_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, letters(300)), (2, None)], "id long, text string")
    o = options("faster")
    assert not index.is_index(spark, f"{tmp_path}/ix")
    index.save(t, "id", f"{tmp_path}/ix", o, 4)
    stored, back = index.load(spark, f"{tmp_path}/ix")
    assert index.is_index(spark, f"{tmp_path}/ix") and back == o and stored.lengths.count() == 2
    made = mapper.target_index(t, "id", o)
    assert stored.seeds.exceptAll(made.select(stored.seeds.columns)).isEmpty() and stored.seeds.count() == made.count() > 0
    assert {tuple(r) for r in stored.counts.collect()} == {tuple(r) for r in mapping.occurrences(made).collect()} and stored.max_occ == mapper.limit_of(made, o)


def test_runs_on_a_saved_index(spark, tmp_path):
    """Same rows as a run that makes its index, and no exchange on the index's side."""
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    o = options("fast")
    index.save(docs, "doc_id", f"{tmp_path}/ix", o, 4)
    stored, back = index.load(spark, f"{tmp_path}/ix")
    again, _ = index.load(spark, f"{tmp_path}/ix")
    want = {tuple(r) for r in mapper.map_reads(items, "item_id", docs, "doc_id", o).collect()}
    got = {tuple(r) for r in mapper.map_stored(items, "item_id", stored, back).collect()}
    assert got == want and any(r[2] is not None for r in got) and again.max_occ == stored.max_occ
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mapping.match(mapping.share_stored(sketch.seeds(items, "item_id", 0, o), stored))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :]
    assert "Bucketed: true" in join and "SelectedBucketsCount: 4 out of 4" in join and join.count("Exchange hashpartitioning") == 1


def test_options():
    assert options("viral").bw == 100 and options(r10=True).k == 9 and options("viral", depletion=True).best_n == 5
    assert parse_count("500M") == 500_000_000 and parse_count("10k") == 10_000
    assert all(options(p).span for p in PRESETS)
    with pytest.raises(ValueError):
        options("none")
    with pytest.raises(ValueError):
        options(align=True)


def test_stream_equals_steps(spark):
    """The stream's rows are those of the per-read rule over each read's chunks in turn."""
    o = options("fast", chunk_size=120)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in reads.stream_map(spark, f"{SF}/benchmark.parque[t]", "item_id", docs, "doc_id", o).collect()}
    rows = reads.chunk_anchors(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", reads.rare_index(docs, "doc_id", o), o)
    by = {}
    for r in rows.collect():
        by.setdefault(r.qid, {}).setdefault(r.chunk_no, []).append((r.tid, r.rev, r.t_pos, r.q_pos))
    want = set()
    for qid, parts in by.items():
        held = []
        for no in sorted(parts):
            found, held = reads.step(held + parts[no], o)
            if found:
                (tid, rev, s, n, qs, qe, rs, re), q = found
                want.add((qid, tid, rev, s, n, q, no + 1, qs, qe, rs, re))
                break
    assert got == want and got


def test_run_stopping(spark):
    rows = [(i, "ab"[i % 2 if i < 700 else 0], 1.0) for i in range(1250)]
    o = options(su_every=100, su_min_reads=100, su_samples=3, su_threshold=0.001)
    got = until.estimates(spark.createDataFrame(rows, "rid long, target string, length double"), o).orderBy("est").collect()
    shares = []
    for r in got:
        part = [x for x in rows if x[0] < r.est * 100]
        shares.append([sum(x[1] == c for x in part) / len(part) for c in "ab"])
        d = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
        ring, top = shares[-3:], 0.0
        at = ring[0]
        for x in ring[1:]:
            if d(x, at) > top:
                top, at = d(x, at), x
        assert r.distance is None if r.est < 5 else abs(r.distance - top) < 1e-8
    assert [r.est for r in got] == list(range(2, 13)) and [r.stop for r in got][:7] == [False] * 3 + [True] * 3 + [False]


def test_bucket_table():
    assert set(quantize_np(pore_levels(6)).tolist()) <= set(range(16))
