"""Collapse by runs that are summed up and carried over, against one value at a time."""

import random

import numpy as np
import pytest

from riverseed.operators import collapse


def plain(z, diff):
    out, last = [], None
    for i, v in enumerate(z):
        if last is None or abs(v - last) >= diff:
            out.append(i)
            last = v
    return out


def series(kind, n, rng):
    if kind == "noise":
        return rng.normal(size=n)
    if kind == "ramp":
        return np.linspace(0, 5, n)
    if kind == "steps":
        return np.repeat(rng.normal(size=n // 5 + 1), 5)[:n]
    if kind == "near":  # at and about the difference
        return rng.choice([0.0, 0.35, 0.7, 0.35 + 1e-16, 0.34999999999999998, -0.35], n)
    return np.zeros(n)


@pytest.mark.parametrize("kind", ["noise", "ramp", "steps", "near", "flat"])
@pytest.mark.parametrize("diff", [0.35, 2.0, 0.0, -1.0])
def test_sums_of_runs(kind, diff):
    """After every value, the sum of a run tells what it keeps last and how many."""
    for seed in range(8):
        rng = np.random.default_rng(seed)
        z = series(kind, int(rng.integers(1, 90)), rng)
        sums = collapse.summed(z, diff)
        for last in (None, *z[:5].tolist(), *rng.normal(0, 2, 25).tolist(), 0.35, -0.35, 1e9):
            at = plain(z if last is None else np.r_[last, z], diff)
            got = at if last is None else [i - 1 for i in at[1:]]
            assert collapse.after(last, *sums, diff) == ((float(z[got[-1]]) if got else last), len(got))


@pytest.mark.parametrize("size", [7, 64, 65_536])
def test_reads_in_runs(spark, size):
    rng = np.random.default_rng(size)
    reads = {i: series(k, n, rng) for i, (k, n) in enumerate([("noise", 400), ("ramp", 300), ("steps", 250), ("near", 200), ("flat", 120), ("noise", 1), ("ramp", 20_000)])}
    rows = [(i, p * 2, float(v)) for i, z in reads.items() for p, v in enumerate(z)] + [(0, None, 1.0), (0, 1, None), (None, 1, 1.0), (0, 3, float("nan"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "read_id long, pos int, z double")
    got = sorted(map(tuple, collapse.collapse(df, 0.35, size).collect()))
    assert got == [(i, p * 2, float(z[p]), e) for i, z in reads.items() for e, p in enumerate(plain(z, 0.35))]
    assert collapse.collapse(df.where("false"), 0.35, size).count() == 0


def test_a_read_is_in_many_tasks(spark):
    """One read of 40,000 values: no task has more than a few of its runs."""
    df = spark.range(40_000).selectExpr("1L AS read_id", "cast(id AS int) AS pos", "sin(id / 7) AS z")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would make one task of so little
    per = collapse.runs(df, 0.35, 1000).selectExpr("spark_partition_id() AS p", "size(z) AS n").groupBy("p").agg({"n": "sum", "p": "count"}).collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(per) == 4 and max(r["sum(n)"] for r in per) < 25_000
