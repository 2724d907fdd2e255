"""Edge tables and brute-force comparisons of the training-data operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.llm import decontaminate, html_extract, lm_score, mixing, near_dup, pii, quality_rules, queries, token_counts, token_files, warc
from riverseed.llm.common import components, skew_join, work_dir

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 700}x" for i in range(30_000))
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "a", 9),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", None, 9),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", None, 9),
    (3, None, "a", 9), (4, "", "b", 9), (5, " \n\t ", "b", 9), (None, "no id here but words", "b", 9), (None, None, None, None),
    (6, "one", "a", 9), (7, "one", "a", 9), (8, LONG, "c", 9), (9, LONG + " end", "c", 9),
    (10, "mail a.b@c.de_x@y.zz or +1 (555) 123-4567, 10.0.0.256 10.0.0.255, 4111 1111 1111 1111 €+", "a", 9),
]


def table(spark, rows=DOCS):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("key", "node", "n", "h", "part", "start", "size", "kept", "lang", "row", "block", "head", "k")})


def test_near_duplicates_edges(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(table(spark), 2).collect())
    by = {g[0]: g for g in got}
    assert len(got) == len(DOCS)
    assert by["2"][2] == "1" and not by["2"][3] and by["7"][2] == "6" and by["9"][2] == "8"
    assert by["3"][1:] == (0, "3", True) and by["4"][2] == "4" and by["5"][2] == "5" and by["6"][1] == 1
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(240):
        ws = list(base[i % 3 if i % 2 else i % 12])
        for _ in range(rng.randrange(0, 9)):
            ws[rng.randrange(len(ws))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(ws), "s", 0))
    sets = [{tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_a_join(spark, how):
    rows = spark.createDataFrame([(i, [7, None, i % 50][i % 3]) for i in range(3000)], "v long, k long")
    unique = spark.createDataFrame([(k, -k) for k in range(0, 60, 2)] + [(7, -7)], "k long, x long")
    got, want = (Counter(map(tuple, f.select("v", "k", "x").collect())) for f in (skew_join(rows, unique, ["k"], how), rows.join(unique, "k", how)))
    assert got == want and len(want) > 1000


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    out = work_dir(spark, "t")
    token_files.write_token_files(table(spark), out, queries.tokenizer_path(), seq_len=64)
    rows = token_files.read_documents(spark, out).collect()
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, x, _, _ in DOCS)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    empty = work_dir(spark, "t")
    assert token_files.write_token_files(table(spark, []), empty, queries.tokenizer_path()) == [] and token_files.read_documents(spark, empty).count() == 0


def test_word_encoder_is_whole_text_encoding():
    e = token_files.WordEncoder(queries.tokenizer_path())
    rng, letters = random.Random(5), list("abzAÉß 's'll €†\n\t ́Σς1②<|endoftext|>#!中\U0001f600\x00")
    for _ in range(2000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(15)))
        assert e.encode([s])[0].tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_encoder_of_a_tokenizer_that_joins_spaces():
    e = token_files.WordEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a b", "  two  spaces\nand lines", "", "the the the"]
    ids, n = e.encode(texts)
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.by_word is False and ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    w = token_files.WordEncoder(queries.tokenizer_path())
    w.encode(texts)
    assert w.by_word is True


def test_main_text_brute_force(spark):
    """The pages of the given tables are one article each; cut it out plainly."""
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op1_html_main_text(spark, SF).select("page_id", "text", "n_chars"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|h2|ul|ol|li|div|section|blockquote|pre|table|tr|td)\b[^>]*>", inner)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", x))).split()) for x in blocks]
        want = "\n".join(x for x in lines if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_mixture_query_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    of, total = {r.doc_id: r.source for r in docs}, Counter()
    for d, n in size.items():
        total[of[d]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped: dict = {}
    while True:  # the plain rule: give out what is left by weight, stop those above, again
        free = [s for s in names if s not in capped]
        left = sum(total.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * total[s] for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    want = capped | share
    runs = [queries.op8_mixture(spark, SF).collect() for _ in range(2)]
    got = {r.doc_id: r for r in runs[0]}
    assert {r.doc_id: r.taken for r in runs[1]} == {i: r.taken for i, r in got.items()} and len(runs[0]) == len(docs)
    taken = Counter()
    for d, r in got.items():
        assert (r["size"], r.source_size) == (size[d], total[of[d]]) and math.isclose(r.target, want[of[d]]) and 0 <= r.taken <= 3 * r["size"]
        taken[of[d]] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 128) for s in names)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "over the lazy dog"), (2, "w5x w6x w7x w8x w9x w10x w11x w12x w13x w14x w15x"), (3, None), (None, "fox"), (4, "!!")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(table(spark), items).collect()}
    assert decontaminate.decontaminate(table(spark), items).count() == len(DOCS)
    assert got[1, 16].n_hit == 5 and got[1, 16].item_ids == ["1"]
    assert got[8, 30_000].item_ids == ["2"] and got[8, 30_000].n_hit == 11 * 43
    assert got[3, 0].n_hit == 0
    assert decontaminate.decontaminate(table(spark), items.where("false")).where("n_hit > 0").isEmpty()


def test_personal_data_base(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng, letters = random.Random(9), list("ab@..1234567890+-- ()_%é\n")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + [x for _, x, _, _ in DOCS]
    rows = pii._with_base(spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, _t string"))
    for k in pii.KINDS:
        found = {r.i: [(x.s, x.e) for x in r.x] for r in rows.select("i", F.col(f"_{k}").alias("x")).collect()}
        for i, t in enumerate(texts):
            want = []
            for m in re.finditer(plain[k], t or ""):
                d = re.sub("[^0-9]", "", m.group())
                luhn = sum((v := int(c) * (1 + j % 2)) - 9 * (v > 9) for j, c in enumerate(reversed(d))) % 10 == 0
                if {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[k]:
                    want.append(m.span())
            assert found[i] == want, (k, t)
    out = pii.personal_data(table(spark)).where("doc_id = 10").select(pii.redacted(F.col("text_read"), F.col("spans")).alias("x")).first().x
    assert "[EMAIL]" in out and "[PHONE]" in out and "[CARD]" in out and "10.0.0.256" in out


def test_boosting_selects_what_it_has_learned():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (3000, len(pii.FEATURES)))
    y = (x[:, 1] > 3) & (x[:, 4] > 2)
    model = pii.fit_boosted(x, y, np.arange(3000) % 3 == 0)
    assert model.trees and model.thresholds
    assert not pii.fit_boosted(x, np.zeros(3000, bool), np.arange(3000) % 3 == 0).trees


def test_personal_data_adds_what_the_base_misses(spark):
    """Forms that no base pattern matches, beside look-alikes, learned from texts with base forms only."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))

    def card(valid=True):
        d = "4" + digits(14)
        total = sum((v := int(c) * (1 + (j + 1) % 2)) - 9 * (v > 9) for j, c in enumerate(reversed(d)))
        return d + str((-total + (not valid)) % 10)

    dotted = lambda c: ".".join(c[i : i + 4] for i in range(0, 16, 4))
    base = [lambda: f"{word()}.{digits(2)}@{word()}.example.com", lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f'token = "{key()}"', lambda: f"password={key()[:18]}"]
    other = [lambda: card(False), lambda: f"{rng.randrange(300, 999)}.{digits(3)}.{digits(1)}.{digits(1)}", lambda: word() * 6, lambda: "20" + digits(2) + "-11-" + digits(2), lambda: digits(24), lambda: f"{word()} @ the.{digits(1)}"]
    hidden = [(0, lambda: f"{word()}.{digits(2)} [at] {word()}.example[dot]com"), (2, lambda: dotted(card())), (3, lambda: f"({digits(3)}) 555-{digits(4)}"), (4, lambda: "AK" + key().upper()[:20])]
    texts, want, decoys = [], set(), set()
    for i in range(900):
        parts = [word() for _ in range(20)]
        if i < 600:
            parts.insert(10, rng.choice(base + other)())
        elif i < 750:
            k, made = rng.choice(hidden)
            m = made()
            at = len(" ".join(parts[:10])) + 1
            parts.insert(10, m)
            want.add((i, k, at, at + len(m)))
        else:
            decoys.add(i)
            parts.insert(10, rng.choice([lambda: dotted(card(False)), *other])())
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = pii.personal_data(docs).collect()
    added = {(r.doc_id, x.k, x.s, x.e) for r in rows for x in r.spans if x not in r.base}
    assert all(set(r.base) <= set(r.spans) for r in rows)
    free = {x for x in added if x[0] >= 600}
    assert len(free & want) >= 0.8 * len(want) and len(free & want) >= 0.9 * len(free)
    assert {k for _, k, _, _ in free & want} == {0, 2, 3, 4}
    assert not any(d in decoys for d, *_ in free) or sum(d in decoys for d, *_ in free) <= 0.05 * len(decoys)
    none = pii.personal_data(docs.where("false"))
    assert none.count() == 0


def test_personal_data_digests_match_brute_force(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum((v := int(c) * (1 + j % 2)) - 9 * (v > 9) for j, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[k]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_personal_data(spark, SF).collect():
        spans = [(k, *m.span()) for k in plain for m in re.finditer(plain[k], texts[r.doc_id]) if ok(k, m.group())]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        have = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(",")) and len(have) == r.n_spans
        order = [(pii.ALL_KINDS.index(k), int(s)) for k, s, _ in have]
        assert order == sorted(order)
        for n, k in enumerate(plain):
            assert r[f"n_{k}"] == sum(x[0] == k for x in spans)


def test_quality_statistics_and_rules(spark):
    got = {r.doc_id: r for r in quality_rules.text_statistics(spark.createDataFrame([(1, "a b c a b c\nx#\nx#\n \n"), (2, None)], "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (8, 2, 1, 6)
    assert got[2].n_words == 0 and got[2].n_repeat_words == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows, rules = quality_rules.quality(table(spark), labels)
    assert rules.rules == [] and rows.count() == len(DOCS)
    rows, rules = quality_rules.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = rows.where("NOT base_failed").join(marks, "doc_id").groupBy("quality", "kept").count().collect()
    share = {(r.quality, r.kept): r["count"] for r in kept}
    assert rules.rules and share.get((1, False), 0) <= 0.02 * share[1, True] and share[0, False] >= share.get((0, True), 0)


def test_quality_counts_brute_force(spark):
    rng = random.Random(8)
    parts = ["a", "b", "c", "d#", "Wo", "x$|", "é<", "1", " ", "  ", "\t", "\n", "\n\n", "\x0b", "\r", "\u00a0", "!?", "%&"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(80))) for _ in range(300)] + ["", None, "a b c " * 60, "one", "a b", "a a a a", LONG, "\n".join(["same line"] * 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = quality_rules.quality(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(ws[j : j + 3]) for j in range(len(ws) - 2)]
        often = Counter(grams)
        inside = {k for j, g in enumerate(grams) if often[g] > 1 for k in range(j, j + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(ws) < 50 or 100 * len(inside) > 50 * len(ws)) and not (r.base_failed and r.kept)


def test_quality_rules_are_the_expression(spark):
    """The verdict of the emitted expression, against the rules applied in Python."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows, rules = quality_rules.quality(docs, labels)
    for r in rows.collect():
        x = r.asDict()
        w, chars, lines = max(x["n_words"], 1), max(x["word_chars"], 1), max(x["n_lines"], 1)
        f = {"word_len": x["word_chars"] / w, "symbol_share": x["n_symbols"] / w, "dup_line_share": x["n_dup_lines"] / lines, "repeat_share": x["n_repeat_words"] / w, "upper_share": x["n_upper"] / chars, "digit_share": x["n_digits"] / chars, "mark_share": x["n_marks"] / w, "words_a_line": x["n_words"] / lines, "distinct_share": x["n_distinct"] / w, "log_words": math.log(x["n_words"] + 1)}
        first = next((i for i, rule in enumerate(rules.rules, 1) if all((f[n] > t) if op == ">" else (f[n] <= t) for n, op, t in rule)), 0)
        assert x["rule"] == first and x["kept"] == (not x["base_failed"] and first == 0)


def test_mixing(spark):
    t = mixing.targets({"a": 100, "b": 100, "c": 10, None: 90})
    assert t["c"] == 30 and math.isclose(sum(t.values()), 300) and t[None] < t["b"]
    n = np.array([1, 2, 5, 100, 257])
    for k in n:
        assert sorted(mixing.permuted(np.arange(k), np.full(k, k), np.full(k, 7))) == list(range(k))
    rows = mixing.mix_taken(table(spark)).collect()
    assert len(rows) == len(DOCS) and all(r.taken <= 3 * r["size"] for r in rows)
    total = Counter()
    for r in rows:
        total[r.source] += r.taken
    want = {r.source: r.target for r in rows}
    assert abs(total["c"] - want["c"]) <= 0.1 * want["c"]
    assert mixing.mix_taken(table(spark, [])).count() == 0
    assert mixing.mix_documents(table(spark).select("doc_id", "text", "source", "n_chars"), 64).where("text = ''").isEmpty()


def test_lm(spark):
    rows = {r.doc_id: r for r in lm_score.lm_scores(table(spark), "doc_id != 6", vocab=50, top=100).collect()}
    c = Counter()
    for d, t, _, _ in DOCS:
        if d != 6:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    assert rows[1].train_tokens == n and rows[6].n_known == 1 + (c[b"one"] > 0)
    assert math.isclose(rows[8].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*LONG.encode().split(), None]), rel_tol=1e-9)
    assert lm_score.lm_scores(table(spark, []), "true").count() == 0


def test_lm_does_not_depend_on_layout_and_beats_the_base(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm_score, "SHARE", 60_000)  # several copies
    monkeypatch.setattr(lm_score, "GROWTH", 1)
    train = "crc32(cast(doc_id AS string)) % 7 != 2"
    one, other = ({r.doc_id: r for r in lm_score.lm_scores(d, train).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    for i, r in one.items():
        assert math.isclose(r.score, other[i].score, rel_tol=1e-4, abs_tol=1e-2) and math.isclose(r.base_score, other[i].base_score, rel_tol=1e-9)
    held = [r for r in one.values() if not r.train]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.02


def test_lm_deals_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARE", 2_000)
    monkeypatch.setattr(lm_score, "GROWTH", 1)
    docs = spark.createDataFrame([(1 if i % 3 else i, "a b c d" if i % 3 else f"x{i} y z") for i in range(6000)], "doc_id long, text string").repartition(3)
    model = lm_score.start_model(np.empty(0, np.uint64), np.empty(0, np.int64), np.ones(lm_score.CLASSES), 1)
    sizes = lm_score._dealt(docs, model, 5).groupBy("share").count().collect()
    assert sum(r["count"] for r in sizes) == 6000 and len(sizes) == 5 * lm_score.ROUNDS and max(r["count"] for r in sizes) < 600


def test_lm_is_normalised_and_learns(spark):
    flat = np.array([b"aa", b"bb", b"cc", b"dd"], dtype=object)
    w = np.array([10, 20, 30, 40], np.uint64)
    m = lm_score.start_model(w, np.array([9, 7, 5, 3]), np.arange(lm_score.CLASSES), 4)
    t = lm_score.Trainer(m, [0])
    ids = m.outputs(np.tile(w, 3000), np.tile(flat, 3000))
    before = after = 0.0
    for model in (m, None):
        if model is None:
            for _ in range(6):
                t.texts(ids, np.array([len(ids)]))
            model = t.m
        s = (model.r @ model.c[0])[ids[:1]] + (model.r @ model.c[1])[ids[3:4]]
        p = np.exp(s @ model.q.T + model.b)
        p = (p / p.sum())[0, ids[1]]
        before, after = after, float(p)
    assert after > 0.5 > before
    z = lm_score._normalisers(spark, t.m)
    s = (t.m.r[3] @ t.m.c[0] + t.m.r[7] @ t.m.c[1]) @ t.m.q.T + t.m.b
    assert math.isclose(np.exp(s.astype(float) - z[7, 3]).sum(), 1, rel_tol=1e-4)
    assert lm_score.copies_for(10) == 1 < lm_score.copies_for(10**8) < lm_score.copies_for(10**12)


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    big = "<p>" + "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/ b", big), (2, None, big), (3, "http://c", None), (4, "http://d", "é" * 10), (None, "http://e", "x"), (5, "http://f", big)], "page_id long, url string, html string")
    arcs, out = work_dir(spark, "arc"), work_dir(spark, "warc")
    assert warc.write_arc(pages, arcs, version) == 6 and warc.convert(spark, arcs, out) == 6
    rows = {r.page_id: r for r in warc.read_warc(spark, out).collect()}
    assert [rows[i].record_type for i in (1, 2, 5)] == ["revisit", "revisit", "response"] and rows[1].refers_to_id == rows[5].record_id
    assert all(rows[i].payload_bytes == 1203 and rows[i].payload_digest == hashlib.sha1(big.encode()).hexdigest() for i in (1, 2, 5))
    assert rows[3].payload_bytes == 0 and rows[4].payload_bytes == 20 and rows[None].url == "http://e" and rows[2].url == "urn:none"


def test_archives_edges(spark):
    """No rows, repeated rows, columns with names used inside; many repeats beyond the broadcast bound."""
    pages = spark.createDataFrame([(i % 7, "http://a", "x" * (999 + i % 3), 1) for i in range(40)] + [(None, None, None, 1)], "page_id long, url string, html string, k int")
    pages = pages.withColumns({c: F.lit(1) for c in ("file", "place", "block", "to", "record_id", "payload_sha1", "n", "x")})
    for limit in (200_000, 0):
        warc.BROADCAST_ROWS = limit
        for rows, n in ((pages, 41), (pages.where("false"), 0)):
            arcs, out = work_dir(spark, "arc"), work_dir(spark, "warc")
            assert warc.write_arc(rows, arcs) == n and warc.convert(spark, arcs, out) == n
            found = warc.read_warc(spark, out).collect()
            assert len(found) == n
            if n:
                kinds = Counter((r.payload_bytes, r.record_type) for r in found)
                assert kinds[1000, "response"] == kinds[1001, "response"] == 1 and kinds[999, "revisit"] == 0 and kinds[1000, "revisit"] == 12
    warc.BROADCAST_ROWS = 200_000


def test_archive_query_edges(spark):
    folder = work_dir(spark, "sf")
    for rows in ([], [(1, "u", "y" * 1500), (1, "u", "y" * 1500), (2, "u", "y" * 1500), (3, None, None)]):
        spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{folder}/pages.parquet")
        got = sorted(tuple(r) for r in queries.op5_warc(spark, folder).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
        assert got == ([(1, 1500, "revisit", 2), (1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None)] if rows else [])


def test_archive_damage():
    body = warc.arc_head(1, "x") + warc.arc_record(1, "x", "http://a", "20080102030405", b"hello", 0) + b"http://b 0.0.0.0 2008 text/html 99\ncut"
    found = list(warc.parse_arc(body))
    assert [r.damaged for r in found] == [False, True] and found[0].block == b"hello"
    assert warc.iso_date("20080102030405") == "2008-01-02T03:04:05Z" and warc.iso_date("2008") == "2008-01-01T00:00:00Z"


def test_extraction():
    page = '<!DOCTYPE html><title>t</title><body><nav>menu</nav><div class="sidebar"><p>s</p></div><main><header><h1>A &amp; B</h1></header><script>"</p>"</script><p>one <b>two<br>three<p>four<div class="comments"><p>c</p></div><form>f</form><aside>x</aside></main><footer>z'
    assert html_extract.extract(page) == "A & B\none two three\nfour"
    assert html_extract.extract("") == "" and html_extract.extract("just text") == "just text" and html_extract.extract("<p>a<") == "a<"
    assert html_extract.in_order([1, 2, 1, 2], [1, 2]) and not html_extract.in_order([1, 1, 2, 2], [1, 2])


def test_extraction_edges(spark):
    pages = spark.createDataFrame([(1, "http://h/a", "<article><p>x</p></article>"), (1, "http://h/a", "<article><p>x</p></article>"), (2, None, None), (None, "", "<p>y")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.main_text(pages).collect()) == ["", "x", "x", "y"]
    assert html_extract.main_text(pages.where("false")).count() == 0


def test_rollup(spark):
    rows = table(spark).withColumns({"tokens": F.lit(5), "was": F.lit(2)})
    r = token_counts.Rollup(spark, work_dir(spark, "r"))
    assert r.totals().count() == 0
    insert = token_counts.changes(rows, "insert", "v", F.col("tokens"))
    assert r.commit("b1", insert) and not r.commit("b1", insert)
    assert r.commit("b2", token_counts.changes(rows.where("doc_id = 1"), "delete", "v", F.col("tokens")))
    assert r.commit("b3", token_counts.changes(rows.where("doc_id = 4"), "revise", "v", F.col("tokens"), F.col("was")))
    assert r.totals().agg(F.sum("docs"), F.sum("tokens")).first() == (len(DOCS) - 1, 5 * len(DOCS) - 5 + 3)
    with pytest.raises(ValueError):
        r.commit("../x", insert)
    # compaction changes no total and forgets no batch
    want = sorted(map(str, r.totals().collect()))
    r.compact()
    assert sorted(map(str, r.totals().collect())) == want and not r.commit("b2", insert)
    assert r.commit("b4", insert.where("false")) and sorted(map(str, r.totals().collect())) == want
    assert r.commit("b5", insert) and r.totals().agg(F.sum("docs")).first()[0] == 2 * len(DOCS) - 1
    r.compact()
    assert r.totals().agg(F.sum("docs")).first()[0] == 2 * len(DOCS) - 1


@pytest.mark.parametrize("name", ["word_bpe_49k", "byte_bpe_50k"])
def test_token_counter_is_whole_text_encoding(name):
    c = token_counts.TokenCounter(queries.tokenizer_path(f"{name}.json"))
    rng, letters = random.Random(5), list("abzAÉß 's'll €†\n\t ́Σς1②<|endoftext|>#!中\U0001f600\x00\u00a0\u3000") + [" ", " ", "the", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)]
    plain = ["the cats sat, on 12 mats\nand it's well."] * 3
    got = c.count(plain) + c.count(texts)
    assert got == [len(c.tokenizer.encode(t, add_special_tokens=False).ids) for t in plain + texts]
    assert c.words.by_word is (name == "word_bpe_49k") and (c.by_piece or c.words.by_word)


def test_token_counts_brute_force(spark):
    from tokenizers import Tokenizer

    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    files = {n: Tokenizer.from_file(queries.tokenizer_path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k")}
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for n, t in files.items():
            if r.doc_id not in toxic:
                want[r.source, r.lang, n, "docs"] += 1
                want[r.source, r.lang, n, "tokens"] += len(t.encode(r.text or "", add_special_tokens=False).ids) + (n == "word_bpe_49k")
    got = Counter()
    for r in queries.op7_token_counts(spark, SF).collect():
        got[r.source, r.lang, r.version, "docs"] += r.docs
        got[r.source, r.lang, r.version, "tokens"] += r.tokens
    assert got == want
    edges = token_counts.token_lengths(table(spark), {"k2": queries.tokenizer_path()}, ["doc_id", "k"]).collect()
    assert len(edges) == len(DOCS) and {r.k2 for r in edges if r.doc_id in (3, 4, 5)} == {0}
