"""The seed join with hashes that all reads have: same rows, even tasks."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from riverseed.functions.signal_math import pore_levels
from riverseed.operators import mapping, sketch
from riverseed.operators.sketch import buckets_of
from riverseed.options import options
from riverseed.plans import catalogue, mappings


def seeds(spark, rows):
    return spark.createDataFrame(rows, "id long, pos int, hash long")


def plain(q, t, limit):
    many = Counter(h for *_, h in t)
    return Counter((a, p, b, r) for a, p, h in q for b, r, k in t if h is not None and h == k and many[h] <= limit)


def skewed(seed, n_hot):
    rng = random.Random(seed)
    q = [(i, p, rng.randrange(60)) for i in range(40) for p in range(5)] + [(i, 9, 999) for i in range(n_hot)] + [(1, 1, 999)] * 3 + [(7, 7, None)]
    t = [(100 + i, p, rng.randrange(80)) for i in range(30) for p in range(4)] + [(200 + i, i, 999) for i in range(25)] + [(300, i, 5) for i in range(90)] + [(8, 8, None)]
    return q, t


@pytest.mark.parametrize("least", [1, 40, 10**9])
@pytest.mark.parametrize("limit", [20, 50, 200])
def test_same_rows_however_split(spark, least, limit):
    q, t = skewed(limit, 150)
    got = mapping.match(mapping.share(seeds(spark, q), seeds(spark, t), limit), least).collect()
    assert Counter(map(tuple, got)) == plain(q, t, limit)


def test_both_sides_are_split(spark):
    q, t = skewed(1, 400)
    shared = mapping.share(seeds(spark, q), seeds(spark, t), 200)
    hot = {r.hash: (r.pq, r.pt) for r in mapping.pieces(shared, 4, least=100).collect()}
    assert hot[999][0] * hot[999][1] >= 403 * 25 / 1000 and hot[999][0] > 1
    assert mapping.pieces(shared, 4, least=10**9) is None
    even = mapping.share(seeds(spark, [(i, 0, 1) for i in range(300)]), seeds(spark, [(i, 0, 1) for i in range(300)]), 500)
    assert {(r.pq * r.pt >= 10, r.pq > 1, r.pt > 1) for r in mapping.pieces(even, 1, least=900).collect()} == {(True, True, True)}


def test_a_hash_in_every_read_makes_no_large_task(spark):
    """Anchors by task: the pieces of the hot hash are even, none is much over an even share."""
    rng = random.Random(5)
    q = [(i, p, rng.randrange(4000)) for i in range(3000) for p in range(3)] + [(i, 3, 7) for i in range(3000)]
    t = [(i, p, rng.randrange(4000)) for i in range(900) for p in range(4)] + [(10_000 + i, 0, 7) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = mapping.share(seeds(spark, q), seeds(spark, t), 200)
        sizes = lambda least: sorted(r["count"] for r in mapping.match(shared, least).groupBy(F.spark_partition_id().alias("p")).count().collect())
        whole, split = sizes(10**9), sizes(1)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(whole) == sum(split) and whole[-1] > 3 * whole[len(whole) // 2]
    assert len(split) == 8 and split[-1] <= 2 * split[5] and split[-1] < 1.5 * sum(split) / 4  # four tasks have the hot hash


def test_counts_with_and_without_a_limit(spark):
    q, t = skewed(3, 20)
    for limit in (20, None):
        want = Counter((a, b) for a, _, b, _ in plain(q, t, limit or 10**9).elements())
        got = {(r.qid, r.tid): r.n_anchors for r in mapping.match_counts(seeds(spark, q), seeds(spark, t), limit).collect()}
        assert got == want


def counted(t, q):
    many = Counter((h, b) for b, _, h in t if h is not None)
    out = Counter()
    for (h, a), n in Counter((h, a) for a, _, h in q if h is not None).items():
        for (k, b), m in many.items():
            if h == k:
                out[a, b] += n * m
    return out


@pytest.mark.parametrize("least", [1, 40, 10**9])
@pytest.mark.parametrize("limit", [20, None])
def test_counts_are_the_same_however_split(spark, least, limit):
    q, t = skewed(4, 60)
    q += [(i % 7, 20 + i, 999) for i in range(50)]
    many = Counter(h for *_, h in t)
    kept = [x for x in t if limit is None or many[x[2]] <= limit]
    got = {(r.qid, r.tid): r.n_anchors for r in mapping.match_counts(seeds(spark, q), seeds(spark, t), limit, least).collect()}
    assert got == counted(kept, q)


def test_the_query_counts_hashes_of_every_frequency(spark, tmp_path):
    """A passage of 120 documents, far over any occurrence limit, links its item to each."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcd", k=n))
    common = letters(60)
    items = [(1, common), (2, letters(40) + common), (3, letters(80)), (4, None), (5, "abc")]
    docs = [(i, letters(50) + common * (1 + i % 2) + letters(30)) for i in range(120)] + [(1000 + i, letters(200)) for i in range(30)] + [(2000, None), (2001, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.qid, r.tid): r.n_anchors for r in mappings.q25_seed_join(spark, str(tmp_path)).collect()}
    levels = buckets_of(pore_levels(sketch.K), options())
    hashes = lambda rows: [(i, 0, h) for i, text in rows for h in sketch.seed_hashes((text or "").encode(), levels).tolist()]
    assert got == counted(hashes(docs), hashes(items))
    assert {(i, d) for i in (1, 2) for d in range(120)} <= set(got)
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == {(a, b): n for a, b, n in con.execute(catalogue.SQL["q25_seed_join"]).fetchall()}
