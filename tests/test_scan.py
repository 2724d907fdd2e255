"""Anchors and chains made in the pass that sketches the targets, against the seed join."""

import numpy as np
import pytest

from riverseed.functions.many_chains import many_chains
from riverseed.operators import chain, mapper, mapping, scan, sketch
from riverseed.options import options


def texts(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, text string")


def passages(seed=5, n=40):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(3, 9))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(words, r.integers(0, 400)))) for i in range(n)]
    items = [(100 + i, d[1][len(d[1]) // 3 :][:200]) for i, d in enumerate(docs[:8])]
    return docs + [(n, None), (None, docs[3][1]), (n + 1, "ab")], items + [(200, None), (201, "xy")]


@pytest.mark.parametrize("groups,places", [(300, 4000), (60, 300), (8, 60)])
@pytest.mark.parametrize("preset", ["sensitive", "viral"])
def test_groups_together_and_alone(groups, places, preset):
    o, r = options(preset), np.random.default_rng(groups)
    n = 3000
    g, t = r.integers(0, groups, n), r.integers(0, places, n)
    q = np.where(r.random(n) < 0.4, t % 250, r.integers(0, 250, n))
    got = sorted(zip(*[x.tolist() for x in many_chains(g, t, q, o, chain._scores, chain.link, chain.trace, chain.NONE)]))
    want = sorted((k, *c[:6]) for k in range(groups) for c in chain.chains_of(t[g == k], q[g == k], o))
    assert got == want and got


def test_kept_places():
    r = np.random.default_rng(3)
    for _ in range(300):
        z, last = np.round(r.normal(size=r.integers(0, 60)) * r.choice([0.05, 0.3, 1]), 1), r.choice([np.inf, 0.0, 0.5])
        want, at = [], last
        for i, v in enumerate(z.tolist()):
            if abs(v - at) >= 0.35:
                want.append(i)
                at = v
        assert sketch.kept(z, 0.35, last).tolist() == want


def test_counts_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(scan, "GATHERED", 50)
    monkeypatch.setattr(scan, "COUNTED", 100)
    assert scan.unpack(scan.pack(np.array([0, 1, 255, 2**32 - 1]))).tolist() == [0, 1, 255, 2**32 - 1]
    docs, items = (texts(spark, x) for x in passages())
    o = options("fast", mid_occ_min=2)
    index = mapper.text_index(docs, "id", o)
    located = scan.locate(sketch.seeds(items, "id", 0, o), index)
    assert located.max_occ == mapper.limit_of(index.seeds(), o)
    want = mapping.occurrences(index.seeds()).join(sketch.seeds(items, "id", 0, o).select("hash").distinct(), "hash").collect()
    assert {(r.hash, r.nt) for r in located.counts.collect()} == {(r.hash, r.n_occ) for r in want}


@pytest.mark.parametrize("limit", [None, 3, 1000])
def test_anchors_equal_the_join(spark, limit):
    docs, items = (texts(spark, x) for x in passages())
    o = options(mid_occ_min=5)
    index, seeds = mapper.text_index(docs, "id", o), sketch.seeds(items, "id", 0, o)
    located = scan.locate(seeds, index, limit)
    shared = mapping.share(seeds, index.seeds(), mapper.limit_of(index.seeds(), o, limit))
    cols = ["qid", "q_pos", "tid", "rev", "t_pos"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert rows(located.anchors()) == rows(mapping.match(shared)) != []
    rep = lambda s: sorted(map(tuple, mapping.repeat_length(s, o.span).collect()))
    assert rep(located.shared()) == rep(shared)


@pytest.mark.parametrize("twice", [False, True])
def test_chains_equal_those_of_the_join(spark, twice):
    """Also where a target is two texts, whose anchors make one group."""
    docs, items = passages()
    docs = texts(spark, docs + [(3, docs[5][1])] if twice else docs)
    o, items = options(), texts(spark, items)
    located = scan.locate(sketch.seeds(items, "id", 0, o), mapper.text_index(docs, "id", o), 1000)
    rows = lambda df: sorted(map(tuple, df.select(*[f.split()[0] for f in chain.FIELDS.split(", ")]).collect()), key=repr)
    assert rows(located.chains(o)) == rows(chain.chains(located.anchors(), o)) != []


def test_no_index_is_written(spark, monkeypatch):
    """A run's disk doesn't grow with the index: the targets' seeds are nowhere written."""
    names = []
    for m in (mapper, mapping, scan):
        monkeypatch.setattr(m, "stash", lambda df, what, f=m.stash: (names.append(what), f(df, what))[1])
    docs, items = (texts(spark, x) for x in passages())
    got = mapper.map_reads(items, "id", docs, "id", options(mid_occ_min=1000))
    assert {r.qid for r in got.where("tid IS NOT NULL").collect()} >= {100, 101, 102}
    assert not {"index", "shared"} & set(names)


def test_many_queries_are_joined(spark, monkeypatch):
    docs, items = (texts(spark, x) for x in passages())
    run = lambda: sorted(map(tuple, mapper.map_reads(items, "id", docs, "id", options()).collect()), key=repr)
    few = run()
    monkeypatch.setattr(scan, "FEW_SEEDS", 10)
    assert run() == few


def test_queries_of_anchors_write_no_index(spark, monkeypatch):
    from riverseed.plans import catalogue, mappings

    names = []
    for m in (catalogue, mappings, mapping, scan):
        monkeypatch.setattr(m, "stash", lambda df, what, f=m.stash: (names.append(what), f(df, what))[1])
    for f in (catalogue.q26_seed_join, mappings.q45_dtw_rescore, mappings.q50_bases_mapped_unmapped, mappings.q51_relative_abundance):
        assert f(spark, "/root/testdata/sf0.001").count() > 0
    assert not {"index", "shared"} & set(names)


def test_stream_writes_no_index(spark, tmp_path, monkeypatch):
    """Two files, the second of which has a read of the first again: the rows are as with an
    index that is joined, which is written only where a batch is too large."""
    from riverseed.streaming import reads

    names = []
    for m in (reads, mapping, scan):
        monkeypatch.setattr(m, "stash", lambda df, what, f=m.stash: (names.append(what), f(df, what))[1])
    docs, items = passages()
    docs = [d for d in docs if d[0] is not None]
    texts(spark, items[:5]).coalesce(1).write.parquet(f"{tmp_path}/r/a")
    texts(spark, items[4:]).coalesce(1).write.parquet(f"{tmp_path}/r/b")
    run = lambda: sorted(map(tuple, reads.stream_map(spark, f"{tmp_path}/r/*", "id", texts(spark, docs), "id", options("fast", chunk_size=60, mid_occ_min=5)).collect()))
    few = run()
    assert len(few) >= 5 and not {"index", "shared"} & set(names)
    monkeypatch.setattr(scan, "FEW_SEEDS", 10)
    assert run() == few and "index" in names


def ranked_chains(r, n):
    rows = [{"qs": s, "qe": s + int(r.integers(1, 120)), "score": int(r.integers(5, 60)), "cnt": int(r.integers(2, 6)), "tid": int(r.integers(0, 9)), "rev": int(r.integers(0, 2)), "rs": int(r.integers(0, 50)), "re": int(r.integers(50, 99))} for s in r.integers(0, 200, n).tolist()]
    rows.sort(key=lambda x: (-x["score"], -x["cnt"], *[x[c] for c in chain.ORDER[2:]]))
    return rows


@pytest.mark.parametrize("given", [{}, {"best_n": 2}, {"best_n": 5, "check_strand": True, "mask_len": 10}])
def test_primaries_of_blocks_and_of_a_whole_query(given):
    """Chains that come in blocks leave what the rule over all of a query's chains leaves."""
    o, r = options(**given), np.random.default_rng(4)
    for _ in range(60):
        rows = ranked_chains(r, int(r.integers(1, 150)))
        keep, second = [], 0
        for k, (x, (p, sub, n)) in enumerate(zip(rows, chain.parents_of([(x["qs"], x["qe"], x["score"], x["cnt"]) for x in rows], o))):
            if p != k:
                if second >= o.best_n or not chain.worth_keeping(x, rows[p], o):
                    continue
                second += 1
            keep.append(x | {"rank": k, "parent": p, "subsc": sub, "n_sub": n, "qid": 1})
        query, cut = chain._Query(o), int(r.integers(0, len(rows) + 1))
        for part in (rows[:cut], rows[cut:]):
            query.add({c: np.array([x[c] for x in part], np.int64) for c in rows[0]})
        assert sorted(query.kept(1), key=lambda x: x["rank"]) == keep


def test_no_query_is_gathered(spark):
    """The chains of a query stream through a task; null ids are a query of their own."""
    rows = [(qid, x["tid"], x["rev"], x["score"], x["cnt"], x["qs"], x["qe"], x["rs"], x["re"]) for qid in (None, 0, 3) for x in ranked_chains(np.random.default_rng(7), 300)]
    found = chain.primaries(spark.createDataFrame(rows, chain.FIELDS), options(best_n=3))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = found.collect()
    by = [sorted(tuple(r)[1:] for r in got if r.qid == q) for q in (None, 0, 3)]
    assert by[0] == by[1] == by[2] and sum(r.parent != r.rank for r in got) == 9


def test_times_go_to_the_queries(spark):
    docs, items = (texts(spark, x) for x in passages())
    o = options("fast", mid_occ_min=1000)
    located = scan.locate(sketch.seeds(items, "id", 0, o), mapper.text_index(docs, "id", o))
    rows = located.chains(o, True).collect()
    names = [f.split()[0] for f in chain.FIELDS.split(", ")]
    assert sorted((tuple(r[c] for c in names) for r in rows if r.us is None), key=repr) == sorted(map(tuple, located.chains(o).collect()), key=repr)
    assert {r.qid for r in rows if r.us is not None} >= {r.qid for r in rows if r.us is None} and all(r.us >= 0 for r in rows if r.us is not None)
