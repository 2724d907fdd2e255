"""Quality classifier: indicators and descent against plain versions, held-out accuracy, edges."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.llm import quality_model, queries
from riverseed.llm.quality_model import _bucket, calibrate, descend, indicators, log_ratio

LONG = "plain words here and there ".encode() * 30_000
TEXTS = [b"", b" \n", b"a", b"The the THE the the ! end.", "süß ñandú $$$ x%%%".encode(), b"no no no no", LONG, b"tail"]


def plain_kind(b):
    if 97 <= b <= 122:
        return 1
    if 65 <= b <= 90:
        return 2
    if 48 <= b <= 57:
        return 3
    if b in b".,;:'\"()-":
        return 4
    return 5 if b < 128 else 0


def plain(text):
    """Buckets of a text, an n-gram at a time."""
    one = lambda code, stream: int(_bucket(np.array([code], np.uint64), stream)[0])
    out = {one(int.from_bytes(text[i : i + n], "big"), n) for n in range(1, 5) for i in range(len(text) - n + 1)}
    words = text.split()
    shapes, coarse = [], []
    for i, w in enumerate(words):
        kinds = [plain_kind(b) for b in w]
        flags = (i > 0 and w == words[i - 1]) | (kinds.count(2) > 1 and 1 not in kinds) << 1
        shapes.append(flags | kinds[0] << 2 | kinds[-1] << 5 | min(len(w) // 4, 3) << 8)
        coarse.append(flags | (kinds[-1] == 5) << 2)
    for stream, values, bits, most in ((10, shapes, 10, 3), (20, coarse, 3, 4)):
        for n in range(1, most + 1):
            for i in range(len(values) - n + 1):
                code = 0
                for v in values[i : i + n]:
                    code = code << bits | v
                out.add(one(code, stream + n))
    return sorted(out)


def test_indicators_against_plain():
    for texts in (TEXTS, [b""], [b"x"], TEXTS[::-1]):
        counts, buckets = indicators(texts)
        got = np.split(buckets, np.cumsum(counts)[:-1])
        for t, g in zip(texts, got):
            assert g.tolist() == plain(t if len(t) < 1000 else t[:200] + t[-200:]) or len(t) > 1000
    counts, buckets = indicators([LONG])
    assert buckets.tolist() == plain(LONG[: 27 * 9])  # periodic: a few periods have all its n-grams


def test_descent_closes_the_duality_gap():
    rng = np.random.default_rng(3)
    ratio = rng.normal(size=40)
    rows = [np.sort(rng.choice(40, rng.integers(1, 12), False)) for _ in range(120)]
    y = np.where(rng.random(120) < 0.3, -1.0, 1.0)
    cost = np.where(y > 0, 0.7, 2.0)
    w, bias = descend(rows, y, ratio, cost, rounds=5000, still=1e-9)
    x = np.zeros((120, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 40] = 1
    v = np.r_[w, bias]
    loss = np.maximum(0, 1 - y * (x @ v))
    primal = v @ v / 2 + (cost * loss**2).sum()
    alpha = 2 * cost * loss  # the optimum's dual point
    dual = alpha.sum() - ((y * alpha) @ x) @ ((y * alpha) @ x) / 2 - (alpha**2 / (4 * cost)).sum()
    assert primal - dual < 1e-6 * primal


def test_calibration_and_ratio():
    rng = np.random.default_rng(4)
    m = rng.normal(size=4000)
    y = np.where(rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1))), 1.0, -1.0)
    a, b = calibrate(m, y, np.ones(4000))
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2
    held = np.array([[3, 0, 1], [0, 2, 1]])
    assert np.allclose(log_ratio(held), np.log(np.array([1, 3, 2]) / np.array([4, 1, 2]) * 7 / 6))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op11_quality_scores"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    pairs = [(a.score > b.score) for a, b in itertools.product(held, held) if a.quality > b.quality]
    assert np.mean(pairs) > 0.99


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("label", "h", "quality", "score", "kind", "part", "data", "q", "lang")})


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int").withColumn("text", F.lit("x")).withColumn("h", F.lit(2))


ROWS = [(i, f"good words number {i} flow on" if i % 2 else f"bad### {i} words$$$ here%%% {i}") for i in range(200)]


@pytest.mark.parametrize("most", [4_000_000, -1])
def test_learns_and_ignores_held_out_labels(spark, monkeypatch, most):
    monkeypatch.setattr(quality_model, "MAX_LABELS", most)  # -1: labels are joined by a shuffle
    train = "crc32(cast(doc_id AS string)) % 5 != 0"
    marks = [(i, i % 2) for i in range(200)]
    flip = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in marks]
    one = {r.doc_id: r.score for r in quality_model.quality_scores(docs(spark, ROWS), labels(spark, marks), train).collect()}
    two = {r.doc_id: r.score for r in quality_model.quality_scores(docs(spark, ROWS), labels(spark, flip), train).collect()}
    assert one == two and all((s > 0.5) == (i % 2 == 1) for i, s in one.items())


def test_edges(spark):
    marks = [(i, i % 2) for i in range(200)] + [(1, 1), (2, None), (3, 0), (None, 1), (500, 7)]
    rows = [*ROWS, (None, "no id"), (None, None), (201, ""), (202, None), (203, LONG.decode()), (1, ROWS[1][1]), (1, ROWS[1][1])]
    got = quality_model.quality_scores(docs(spark, rows), labels(spark, marks), "true", max_rows=40).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[201] == by[202] and len(by[1]) == 1 and len(by[None]) == 2
    assert quality_model.quality_scores(docs(spark, []), labels(spark, marks), "true").count() == 0
    assert {r.score for r in quality_model.quality_scores(docs(spark, ROWS), labels(spark, []), "true").collect()} == {0.5}
    only = quality_model.quality_scores(docs(spark, ROWS), labels(spark, [(1, 1), (3, 1)]), "true").collect()
    assert {round(r.score, 9) for r in only} == {0.75}
