"""The pipeline's stages on small tables."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from riverseed.llm import mixing, queries, token_files
from riverseed.llm.common import work_dir


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).select(*pipeline.COLUMNS)


def test_near_duplicates_keep_unrelated_rows_of_one_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, text("a"), "s"), (None, text("b"), "s"), (None, text("c"), "s"), (7, text("d"), "s"), (7, text("e"), "s"), (7, text("d"), "s"), (8, text("d"), "s"), (9, text("f") + " end", "s"), (None, text("f"), "s"), (None, None, "s"), (None, " ", "s")]
    got = sorted((str(r.doc_id), r.text or "") for r in pipeline.near_duplicate_stage(spark, documents(spark, rows), "").collect())
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (9, text("f") + " end"), (None, ""), (None, " ")]
    assert got == sorted((str(i), t) for i, t in want)


def test_token_files_follow_the_mixture(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1300)), "ab"[i % 2]) for i in range(8)]
    mixed = pipeline.mixing_stage(spark, documents(spark, rows), "").cache()
    pieces = sorted(mixed.collect(), key=lambda r: (r.shard, r.slot, r.source, r.place))
    got = sorted(pipeline.token_stage(spark, mixed, "").collect(), key=lambda r: r.start)
    encoder = token_files.encoder_for(queries.tokenizer_path())
    n = [len(encoder.encode([r.text])[0]) + 1 for r in pieces]
    assert [(r.doc_id, r.n_tokens) for r in got] == [(r.doc_id, k) for r, k in zip(pieces, n, strict=True)]
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    # a file for each shard of the mixture
    out = work_dir(spark, "t")
    shards = token_files.write_token_files(mixed, out, queries.tokenizer_path(), order=mixing.ORDER, whole=True)
    assert {m["shard"]: m["n_docs"] for m in shards} == Counter(r.shard for r in pieces)


def test_mixture_counts_are_those_of_its_text(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100 + i)), "ab"[i % 2]) for i in range(6)]
    # equal rows, rows of one id and text in two sources, and rows without an id
    docs = documents(spark, rows + [rows[0], rows[0], (1, rows[0][1], "a"), (0, rows[0][1], "b"), (None, rows[0][1], "a"), (-1, rows[0][1], "a")])
    taken = mixing.mix_taken(docs).collect()
    mixed = Counter()
    for r in mixing.mix_documents(docs, 32).collect():
        mixed[r.doc_id, r.source] += len(r.text.split())
    want = Counter()
    for r in taken:
        want[r.doc_id, r.source] += r.taken
    assert len(taken) == docs.count() and mixed == +want
    total = Counter()
    for r in taken:
        total[r.source] += r.taken
    assert all(abs(total[r.source] - r.target) <= 64 for r in taken)


def test_mixture_cuts_texts_at_words(spark):
    texts = ["a b", "c", " \td\n\ne  f ", "€ é", None, "", "g" * 5, " h", "i "]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1)
    pieces = mixing.mix_documents(docs, 2).collect()
    got = Counter((r.doc_id, r.text, r.n_chars) for r in pieces)
    assert set(got) == {(0, "a b", 3), (1, "c", 1), (2, "d", 1), (2, "e  f", 4), (3, "€ é", 3), (6, "ggggg", 5), (7, "h", 1), (8, "i", 1)}


EDGES = [(None, None, None), (None, "", "a"), (1, " \n", "a"), (2, "word " * 60, "b"), (2, "word " * 60, "b"), (3, " ".join(f"u{i}" for i in range(70)), None), (4, " ".join(f"v{i}" for i in range(20_000)), "b")]


def test_stages_on_edges(spark):
    """Nulls, empty and long texts, repeated rows, no rows, clashing names: the rows that each stage keeps."""
    folder = work_dir(spark, "sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(30, 45))), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = documents(spark, EDGES)
    extra = docs.withColumns({c: F.lit(1) for c in ("kept", "node", "comp", "size", "start", "shard", "slot", "place", "item_ids", "h")})
    ids = lambda df: sorted((str(r.doc_id), len(r.text or "")) for r in df.collect())
    for name, stage, want in (
        ("quality", pipeline.quality_stage, {3, 4}),
        ("near", pipeline.near_duplicate_stage, {None, 1, 2, 3, 4}),
        ("decontamination", pipeline.decontamination_stage, {None, 1, 2, 4}),
        ("mixing", pipeline.mixing_stage, {2, 3, 4}),
    ):
        got = stage(spark, extra, folder)
        assert got.columns[: len(pipeline.COLUMNS)] == pipeline.COLUMNS, name
        assert {r.doc_id for r in got.collect()} <= want and (name == "mixing" or {r.doc_id for r in got.collect()} == want), name
        assert stage(spark, extra.where("false"), folder).count() == 0, name
    assert len(ids(pipeline.near_duplicate_stage(spark, extra, folder))) == len(EDGES) - 1
    mixed = pipeline.mixing_stage(spark, docs, folder).cache()
    assert pipeline.token_stage(spark, mixed, folder).count() == mixed.count()
    assert pipeline.token_stage(spark, mixed.where("false"), folder).count() == 0


def test_whole_pipeline_against_a_plain_version(spark):
    """Each stage's decisions on the small tables, computed again from its own input."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    stages, inputs, docs = dict(pipeline.STAGES), [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in list(stages.items())[:-1]:
        inputs.append(docs.collect())
        docs = pipeline.stash(stage(spark, docs, sf), "t")
    inputs.append(docs.collect())
    ids = [sorted(r.doc_id for r in x) for x in inputs]
    # quality: the verdicts of the query, which its own test recomputes
    verdict = {r.doc_id: r.kept for r in queries.op2_quality_rules(spark, sf).collect()}
    assert ids[1] == sorted(i for i, k in verdict.items() if k)
    # near duplicates: five-word shingles, 0.8, the least id of each component
    sets = {}
    for r in inputs[1]:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        sets[r.doc_id] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in sets}

    def find(i):
        return i if least[i] == i else find(least[i])

    order = sorted(sets)
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                i, j = sorted((find(a), find(b)))
                least[j] = i
    assert ids[2] == [i for i in order if find(i) == i]
    # decontamination: windows of ten words
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[j : j + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := split(r.text)) for j in range(max(len(w) - 9, 1))}
    long = {k for k in windows if len(k) == 10}
    hit = lambda w: any(tuple(w[j : j + k]) in windows for k in {len(x) for x in windows} for j in range(len(w) - k + 1))
    assert long and ids[3] == sorted(r.doc_id for r in inputs[2] if not hit(split(r.text)))
    # the mixture: words near the targets of op8's rule, pieces of the documents' own words
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in inputs[3]}
    sizes, taken = Counter(), Counter()
    for r in inputs[3]:
        sizes[r.source] += len(texts[r.doc_id])
    for r in inputs[4]:
        w = r.text.split()
        taken[r.source] += len(w)
        assert any(texts[r.doc_id][k : k + len(w)] == w for k in range(len(texts[r.doc_id]) - len(w) + 1))
    target = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], 3 * pipeline.BLOCK_WORDS) for s in sizes), (taken, target, sizes)
    # tokens of each piece, read back from the files
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((r.doc_id, zlib.crc32(np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in inputs[4])
    assert Counter((r.doc_id, r.ids_crc32) for r in pipeline.token_stage(spark, docs, sf).collect()) == want
