"""Signals to mappings, bases, settings and the evaluation of mappings."""

from dataclasses import fields

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.functions.signal_math import hash64_np, pore_levels, quantize_np
from riverseed.operators import chain, evaluate, mapper, mapping, signal, sketch
from riverseed.options import Options, options
from riverseed.sources import signals as sources

RNG = np.random.default_rng(7)


def dna(n):
    return "".join(RNG.choice(list("ACGT"), n))


def test_dna_bases_and_strands():
    assert sketch.bases(b"ACGTUacgtu", alphabet="dna").tolist() == [0, 1, 2, 3, 3] * 2
    assert sketch.bases(b"AC GN\nT", 1, "dna").tolist() == [0, 4, 1, 2, 3]
    s, back = dna(80).encode(), bytes.maketrans(b"ACGT", b"TGCA")
    assert sketch.bases(s, 1, "dna").tolist() == sketch.bases(s.translate(back)[::-1], alphabet="dna").tolist()
    with pytest.raises(ValueError):
        sketch.bases(b"A", alphabet="x")


@pytest.mark.parametrize("text", ["ACGTACGTAC", "ACGNNTACGA", "NNNNACGTA", "NNN", "AC", ""])
def test_kmers_pass_over_other_characters(text):
    """Each place's code is that of the last k bases up to it; where fewer have come, with A before them."""
    k, want = 3, []
    for i in range(k - 1, len(text)):
        had = [c for c in text[: i + 1] if c in "ACGT"][-k:]
        want.append(sum("ACGT".index(c) * 4 ** (len(had) - 1 - j) for j, c in enumerate(had)))
    assert sketch.kmer_codes(sketch.bases(text.encode(), alphabet="dna"), k).tolist() == want


def test_seeds_by_definition(spark):
    """Seeds of a loaded pore model, one k-mer, one value, one gram at a time."""
    o = options(k=3, e=4, q=3, w=0, diff=0.2, fine_range=0.5, fine_min=-1.5, fine_max=1.0, alphabet="dna")
    levels = RNG.normal(size=4**3)
    rows = [(c, float(v)) for c, v in enumerate(levels)]
    pore = sketch.pore_of(spark.createDataFrame(rows, "code long, level double"), 3)
    assert pore.tolist() == levels.tolist()
    with pytest.raises(ValueError):
        sketch.pore_of(spark.createDataFrame(rows[:-1], "code long, level double"), 3)
    text = dna(200)
    values = [levels[sum("ACGT".index(c) * 4 ** (2 - j) for j, c in enumerate(text[i : i + 3]))] for i in range(len(text) - 2)]
    at, last = [], None
    for i, v in enumerate(values):
        if last is None or abs(v - last) >= o.diff:
            at.append(i)
            last = v
    buckets = [int(quantize_np(np.array([values[i]]), 0.5, -1.5, 1.0, 3)[0]) for i in at]
    want = set()
    for j in range(len(at) - 3):
        gram = sum(b << 3 * (3 - x) for x, b in enumerate(buckets[j : j + 4]))
        want.add((at[j], int(hash64_np(np.array([gram]))[0])))
    got = sketch.seeds(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id", 0, o, pore).collect()
    assert {(r.pos, r.hash) for r in got} == want and {r.id for r in got} == {1}


#: A setting's other value where it shows, and what else must be set for that.
CHANGES = {
    "k": (5, {}), "e": (6, {}), "q": (3, {}), "w": (5, {}), "diff": (0.8, {}), "fine_min": (-1.0, {}), "fine_max": (1.0, {}), "fine_range": (0.7, {}), "alphabet": ("dna", {}), "rev_target": (False, {}),
    "seg_windows": ((4, 12), {}), "seg_thresholds": ((1.0, 1.0), {}), "seg_height": (2.0, {}), "min_events": (10**6, {}), "chunk_size": (300, {}), "max_chunks": (1, {"chunk_size": 300}), "adaptive": (False, {"chunk_size": 300}),
    "sample_per_base": (5.0, {}), "mid_occ_frac": (0.9, {"mid_occ_min": 1}), "mid_occ_min": (7, {"mid_occ_frac": 0.99}), "mid_occ_max": (3, {"mid_occ_min": 1}),
    "bw": (3, {}), "max_target_gap": (4, {"bw": 1}), "max_query_gap": (4, {"bw": 1}), "max_iterations": (1, {}), "max_skips": (0, {}), "min_anchors": (60, {}), "min_score": (60, {}), "gap_scale": (30.0, {}), "skip_scale": (30.0, {}),
    "rmq": (True, {"max_iterations": 1}), "rmq_inner": (1, {"rmq": True}), "rmq_cap": (1, {"rmq": True}), "bw_long": (100, {"bw": 3}),
    "min_score2": (10**6, {"all_chains": True}), "check_strand": (True, {}), "mask_level": (0.99, {}), "mask_len": (0, {}), "best_n": (5, {}), "pri_ratio": (0.99, {"best_n": 5}), "all_chains": (True, {}),
    "min_mapq": (60, {}), "w_bestq": (0.0, {}), "w_bestmq": (9.0, {}), "w_bestmc": (9.0, {}), "w_threshold": (0.0, {}), "w_bestma": (9.0, {}), "dtw_min_score": (0.0, {}), "dtw_band": (0.5, {}), "dtw": ("sparse", {}), "dtw_full": (True, {}), "dtw_match_bonus": (9.0, {}),
    "su_threshold": (0.0, {}), "su_samples": (2, {}), "su_every": (50, {}), "su_min_reads": (300, {}),
}


def test_every_setting_is_read():
    """No setting without an operator that reads it."""
    import inspect

    from riverseed.operators import align, dtw
    from riverseed.streaming import reads, until

    text = "".join(inspect.getsource(m) for m in (align, chain, dtw, mapper, mapping, signal, sketch, reads, until)) + inspect.getsource(Options.gap.fget) + inspect.getsource(Options.skip.fget) + inspect.getsource(Options.span.fget)
    assert set(CHANGES) == {f.name for f in fields(Options)}
    assert not [f for f in CHANGES if f"o.{f}" not in text and f"self.{f}" not in text]


@pytest.mark.parametrize("name", ["k", "e", "q", "w", "diff", "fine_min", "fine_max", "fine_range", "alphabet"])
def test_sketch_settings_change_seeds(spark, name):
    rows = spark.createDataFrame([(1, dna(400))], "id long, text string")
    value, more = CHANGES[name]
    seeds = lambda o: {(r.pos, r.hash) for r in sketch.seeds(rows, "id", 0, o).collect()}
    assert seeds(options(**more)) != seeds(options(**more, **{name: value}))


@pytest.mark.parametrize("name", ["seg_windows", "seg_thresholds", "seg_height", "min_events", "chunk_size", "max_chunks", "adaptive"])
def test_segment_settings_change_events(spark, name):
    x = np.repeat(RNG.normal(size=160), 9) + RNG.normal(0, 0.1, 1440)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "read_id long, pos int, pa double")
    value, more = CHANGES[name]
    base = {"min_events": 5} | more
    found = lambda o: [(r.chunk_no, r.used, r.events) for r in signal.chunk_events(rows, o).orderBy("chunk_no").collect()]
    assert found(options(**base)) != found(options(**base | {name: value}))


@pytest.mark.parametrize("name", ["bw", "max_target_gap", "max_query_gap", "max_iterations", "max_skips", "min_anchors", "min_score", "gap_scale", "skip_scale", "rmq", "rmq_inner", "rmq_cap", "bw_long"])
def test_chain_settings_change_chains(name):
    t = np.sort(RNG.integers(0, 2000, 150))
    q = np.abs(t + RNG.integers(-40, 40, 150))
    value, more = CHANGES[name]
    assert chain.chains_of(t, q, options(**more)) != chain.chains_of(t, q, options(**more, **{name: value}))


def test_chunk_events_plainly(spark):
    """Running z-scores, clipping and segments of each chunk, in plain numpy."""
    o = options(chunk_size=500, max_chunks=3, min_events=4)
    reads = {i: np.repeat(RNG.normal(90, 12, 30 * i), 9) + RNG.normal(0, 1, 270 * i) for i in range(1, 9)}
    reads[9] = np.full(600, 5.0)
    rows = [(i, p, float(v)) for i, x in reads.items() for p, v in enumerate(x)] + [(1, None, 1.0), (2, 1, None)]
    RNG.shuffle(rows)
    df = spark.createDataFrame([(int(a), None if b is None else int(b), None if c is None else float(c)) for a, b, c in rows], "read_id long, pos int, pa double")
    got = {(r.read_id, r.chunk_no): r for r in signal.chunk_events(df.repartition(5), o).collect()}
    for i, x in reads.items():
        offset = 0
        for c in range(min(-(-len(x) // 500), 3)):
            part, upto = x[c * 500 : (c + 1) * 500], x[: (c + 1) * 500]
            if upto.std() > 1e-6:
                z = (part - upto.mean()) / upto.std()
                z = z[np.abs(z) < 3]
                want = signal.segment(z, signal.peaks(z))
            else:
                want = []
            r = got.pop((i, c))
            assert np.allclose(r.events, want) and (r.n_events, r.used, r.offset) == (len(want), len(want) >= 4, offset)
            offset += len(want) if len(want) >= 4 else 0
    assert not got and signal.chunk_events(df.where("false"), o).count() == 0


def test_ascents_by_hand():
    v = [0.0, 0.0, 5.0, 9.0, 5.0, 1.0, 1.0, 4.0, 8.0, 3.0]
    assert list(signal.ascents(v, 0, 10, 2, 4.0, 0.5)) == [(3, 3, 5, True), (8, 8, 9, False)]
    assert list(signal.ascents(v, 0, 10, 2, 99.0, 0.5)) == [(3, -1, 9, False)] and list(signal.ascents(v, 3, 3, 2, 4.0, 0.5)) == []


def simulated(texts, k=6):
    levels = pore_levels(k)
    for i, t in texts:
        x = np.repeat(levels[sketch.kmer_codes(sketch.bases(t.encode(), alphabet="dna"), k)], 9)
        for p, v in enumerate(90 + 12 * (x + RNG.normal(0, 0.05, len(x)))):
            yield i, p, float(v)


def test_signals_map_to_where_they_come_from(spark):
    a, b = dna(3000), dna(2500)
    back = str.maketrans("ACGT", "TGCA")
    reads = [(1, a[500:1100]), (2, b[300:900][::-1].translate(back)), (3, dna(600)), (4, dna(20))]
    o = options("viral", alphabet="dna", diff=0.0, min_events=30)
    samples = spark.createDataFrame(list(simulated(reads)), "read_id long, pos int, pa double").repartition(5)
    targets = spark.createDataFrame([(10, a), (11, b), (12, None)], "id long, text string")
    lengths = targets.select(F.col("id").alias("tid"), mapper.n_letters("text", "dna").alias("t_len"))
    got = {r.qid: r for r in mapper.map_signals(samples, mapper.target_index(targets, "id", o), lengths, o).collect()}
    assert (got[1].tid, got[1].rev, got[2].tid, got[2].rev, got[3].tid, got[4].tid) == (10, 0, 11, 1, None, None)
    assert abs(got[1].rs - 500) < 60 and abs(got[1].re - 1100) < 60 and abs(got[2].rs - 300) < 60 and abs(got[2].re - 900) < 60
    assert got[1].ci == 2 and got[1].sl == 595 * 9 and got[4].events == 0 and abs(got[1].qe - 600) < 60
    lines = [r.line for r in mapping.paf(mapper.map_signals(samples, mapper.target_index(targets, "id", o), lengths, o)).collect()]
    assert len(lines) == 4 and all(len(x.split("\t")) == 19 for x in lines)
    # signals as targets
    o = options("viral", diff=0.0, min_events=0)
    found = mapper.map_signals(samples.where("read_id < 4"), mapper.signal_index(samples, o), samples.groupBy(F.col("read_id").alias("tid")).agg(F.count("*").cast("int").alias("t_len")), o, signal_targets=True)
    assert {r.qid: r.tid for r in found.collect()} == {1: 1, 2: 2, 3: 3}
    raw = signal.chunk_events(samples, options(min_events=0), detect=False).agg(F.sum("n_events")).first()[0]
    assert 0.97 * samples.count() < raw <= samples.count()


def test_derived_occurrence_limit(spark):
    """A passage in more documents than the least limit still maps where the quantile allows it."""
    a = dna(300)
    o = options("viral", alphabet="dna", mid_occ_min=2, mid_occ_frac=0.5)
    t = spark.createDataFrame([(i, a) for i in range(8)], "id long, text string")
    q = spark.createDataFrame([(1, a[50:250])], "id long, text string")
    assert mapper.limit_of(mapper.target_index(t, "id", o), o) >= 8
    index, seeds = mapper.target_index(t, "id", o), sketch.seeds(q, "id", 0, o)
    anchors = lambda limit: mapping.seed_matches(seeds, index, limit).count()
    assert anchors(mapper.limit_of(index, o)) >= 8 * 100 and anchors(mapper.limit_of(index, o, 2)) == 0
    assert mapper.limit_of(mapper.target_index(t.where("false"), "id", o), o) == 2


def test_secondaries():
    a = {"score": 100, "qs": 0, "qe": 50, "tid": 1, "rs": 5, "re": 60, "rev": 0}
    o = options(best_n=3)
    assert not chain.worth_keeping(a | {"score": 100}, a, o) and chain.worth_keeping(a | {"qs": 1, "score": 30}, a, o)
    low = a | {"score": 20, "rev": 1}
    assert not chain.worth_keeping(low, a, o) and chain.worth_keeping(low, a, options(check_strand=True)) and not chain.worth_keeping(low | {"score": 15}, a, options(check_strand=True))


def test_alignment_scores_decide(spark):
    o = options()
    rows = spark.createDataFrame([(1, 1, 20.0), (1, 1, -1.0), (2, 9, 60.0), (2, 9, 10.0)], "n int, q int, a double")
    c = lambda x: F.col(x)
    got = rows.select(
        chain.mapped(c("n"), F.lit(0), F.lit(0), F.lit(50), F.lit(30), o, c("a")).alias("m"),
        chain.mapq(F.lit(90), F.lit(8), F.lit(0), F.lit(0), F.lit(90), F.lit(0), o, c("a")).alias("q"),
    ).collect()
    assert [r.m for r in got] == [True, False, 0.2 * 60 / 50 + 0.6 * 0.4 >= 0.45, False]
    want = lambda a: int(0.8 * 40 * (1 - 15 / 90) * 2 * np.log(a)) if a > 0 else 0
    assert [r.q for r in got] == [min(60, want(r)) for r in (20, -1, 60, 10)]


def test_fuzzy_lengths(spark):
    steps = [(0, 0), (4, 5), (40, 30), (60, 90)]
    rows = spark.createDataFrame([(1, 2, 0, 0, t, q) for t, q in steps], "qid long, tid long, rev int, chain int, t_pos int, q_pos int")
    span, match, block = options().span, options().span, options().span
    for (t0, q0), (t1, q1) in zip(steps[:-1], steps[1:]):
        short = min(t1 - t0, q1 - q0)
        match, block = match + short + min(short, span), block + max(t1 - t0, q1 - q0)
    r = chain.fuzzy_lengths(rows, options()).first()
    assert (r.match_len, r.block_len) == (match, block)


def test_evaluation_by_hand(spark):
    kind = "qid string, tid string, q_len long, qs long, qe long, mt double, ci int, sl long"
    tool = spark.createDataFrame([("a", "x", 100, 0, 90, 10.0, 1, 900), ("a", "x", 100, 0, 90, 10.0, 1, 900), ("b", "y", 50, 5, 45, 20.0, 2, 450), ("c", None, 30, None, None, 5.0, 4, 270), ("d", None, 40, None, None, 5.0, 1, 360)], kind)
    truth = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "x"), ("d", None)], "qid string, tid string")
    assert {(r.qid, r.tid): r.label for r in evaluate.classified(tool, truth).collect()} == {("a", "x"): "tp", ("b", "y"): "fp", ("b", "z"): "fn", ("c", "x"): "fn", ("c", None): "tn", ("d", None): "tn"}
    c = evaluate.confusion(evaluate.classified(tool, truth)).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.prec, c.f1) == (1, 1, 2, 2, 0.5, 0.4) and abs(c.rec - 1 / 3) < 1e-12 and abs(c.tp_share - 1 / 6) < 1e-12
    one = tool.dropDuplicates()
    s = evaluate.speedup(evaluate.throughput(one)).first()
    assert (s.mean_bases, s.median_bases, s.mean_samples) == ((10_000 + 2500 + 6000 + 8000) / 4, 7000, (90_000 + 22_500 + 54_000 + 72_000) / 4) and s.speedup == s.mean_bases / 450
    assert evaluate.times(one).first()[:2] == (10.0, 7.5)
    assert evaluate.sequenced(one).first()[:] == (4, 55.0, 75.0, 35.0)
    assert sorted(map(tuple, evaluate.relative_abundance(one, F.col("tid")).collect())) == [("x", 1, 0.5, 90 / 130), ("y", 1, 0.5, 40 / 130)]
    # an unmapped read that has a truth is both wrong and missed
    assert evaluate.abundance_accuracy(one, truth).first()[:] == (1, 2, 1, 1)
    only = evaluate.contamination(one, truth, spark.createDataFrame([("x",)], "tid string")).first()
    assert (only.tp, only.fp, only.fn, only.tn) == (1, 0, 1, 3)
    both = {r.tool: r for r in evaluate.compared({"t": one, "none": one.where("false")}, truth).collect()}
    assert both["t"].f1 == c.f1 and both["t"].mean_mapped_chunks == 1.5 and both["none"].f1 == 0 and both["none"].fn == 3
    empty = evaluate.confusion(evaluate.classified(one.where("false"), truth.where("false"))).first()
    assert (empty.tp, empty.prec, empty.f1, empty.tn_share) == (0, 0.0, 0.0, 0.0)


def test_samples_of_files_map(spark, tmp_path):
    """Text files of signals and a pore model as given, end to end."""
    a = dna(1200)
    levels = pore_levels(6)
    (tmp_path / "model.tsv").write_text("kmer\tlevel_mean\n" + "".join(f"{''.join('ACGT'[c >> 2 * (5 - i) & 3] for i in range(6))}\t{90 + 12 * v}\n" for c, v in enumerate(levels)))
    x = [round(v * 8) for _, _, v in simulated([(1, a[200:700])])]
    (tmp_path / "r.slow5").write_text("#slow5_version\t0.2.0\nread7\t0\t8192\t0\t1024\t4000\t%d\t%s\n" % (len(x), ",".join(map(str, x))))
    o = options("viral", alphabet="dna", diff=0.0)
    pore = sketch.pore_of(sources.pore_model(spark, str(tmp_path / "model.tsv")), 6)
    reads = sources.slow5(spark, str(tmp_path)).withColumn("id", F.lit(7))
    samples = sources.samples(reads, "id")
    t = spark.createDataFrame([(1, a)], "id long, text string")
    row = mapper.map_signals(samples, mapper.target_index(t, "id", o, pore), t.select(F.col("id").alias("tid"), mapper.n_letters("text", "dna").alias("t_len")), o).first()
    assert (row.qid, row.tid, row.rev) == (7, 1, 0) and abs(row.rs - 200) < 60
