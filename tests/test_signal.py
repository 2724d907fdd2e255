import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.functions.signal_math import hash64, hash64_np, quantize, quantize_np
from riverseed.operators.signal import peaks, segment
from riverseed.operators.sketch import seed_hashes
from riverseed.plans import catalogue, mappings  # noqa: F401

SF = "/root/testdata/sf0.001"
GOLDEN = {0: 4290886808, 1: 3079993582, 2: 1865025060, 255: 1746887881, 0x12345678: 391856246, 0xFFFFFFFF: 3365156203}


def test_hash_golden(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDEN], "k long").select("k", hash64(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == GOLDEN
    assert hash64_np(np.array(list(GOLDEN))).tolist() == list(GOLDEN.values())


def test_quantizer(spark):
    xs = [-2.5, -2.0, -1.5, -0.7, 0.0, 0.7, 1.4, 2.0, 2.1]
    got = [r.b for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", quantize(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == quantize_np(np.array(xs)).tolist() == [6, 0, 0, 1, 3, 4, 5, 6, 14]


def test_peaks_of_steps():
    rng = np.random.default_rng(42)
    x = np.repeat([0.0, 2.0, -1.0, 1.0], 20) + rng.normal(0, 0.05, 80)
    assert {20, 40, 60} <= set(peaks(x))
    assert np.allclose(segment(x, [20, 40, 60]), [0, 2, -1], atol=0.1)
    assert peaks(np.array([])) == [] and peaks(np.ones(30)) == []


def test_seeds_ignore_other_characters():
    q = np.arange(4096) % 16
    assert seed_hashes(b"abcdefghijklmnop", q).tolist() == seed_hashes("A-b c.déefghijklmnop".encode(), q).tolist()
    assert len(seed_hashes(b"short", q)) == 0


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(catalogue.SQL[name])
    cols = [c[0] for c in cur.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(str, cur.fetchall()))
