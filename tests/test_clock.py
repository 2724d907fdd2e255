"""Measured times of reads: as many as there are reads, and the rows as without."""

import numpy as np
from pyspark.sql import functions as F

from riverseed.functions.signal_math import pore_levels
from riverseed.operators import evaluate, mapper, mapping, sketch
from riverseed.options import options

RNG = np.random.default_rng(3)


def dna(n):
    return "".join(RNG.choice(list("ACGT"), n))


def test_times_of_texts(spark):
    texts = [(i, dna(1500)) for i in range(4)]
    t = spark.createDataFrame(texts, "id long, text string")
    reads = spark.createDataFrame([(i, texts[i][1][200:900]) for i in range(4)] + [(7, "AC"), (8, None)], "id long, text string")
    for o in (options("fast", alphabet="dna"), options("fast", alphabet="dna", dtw="sparse")):
        plain = mapper.map_reads(reads, "id", t, "id", o)
        rows = mapper.map_reads(reads, "id", t, "id", o, timed=True)
        got = rows.collect()
        assert sorted(map(repr, rows.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
        assert all(r.mt > 0 and r.ci == 1 and r.sl == r.q_len for r in got if r.qid < 4) and len(got) == 6 and all(r.mt >= 0 for r in got)
    lines = {r.qid: r.line for r in mapping.paf(rows).collect()}
    assert all("mt:f:0.000000" not in lines[i] for i in range(4))
    speeds = evaluate.throughput(spark.createDataFrame(got)).first()
    assert speeds.mean_bases > 0 and speeds.mean_samples > 0


def test_times_of_signals(spark):
    target = dna(1500)
    levels = pore_levels(6)[sketch.kmer_codes(sketch.bases(target[300:800].encode(), 0, "dna"), 6)]
    x = 90 + 12 * np.repeat(levels, 9) + np.random.default_rng(1).normal(0, 0.3, 9 * len(levels))
    samples = spark.createDataFrame([(5, i, float(v)) for i, v in enumerate(x)] + [(6, i, 1.0) for i in range(50)], "read_id long, pos int, pa double")
    o = options("viral", alphabet="dna", diff=0.0)
    t = spark.createDataFrame([(1, target)], "id long, text string")
    lengths = t.select(F.col("id").alias("tid"), mapper.n_letters("text", "dna").alias("t_len"))
    rows = {r.qid: r for r in mapper.map_signals(samples, mapper.target_index(t, "id", o), lengths, o, timed=True).collect()}
    assert rows[5].mt > 0 and rows[5].tid == 1 and rows[6].mt == 0 and rows[6].tid is None
