"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions.

A benchmark item gives windows of ``window`` consecutive words (an item of fewer
words is one window). A window is the set of its word shingles with their
places. Containment of a whole window needs each of its shingles, so a prefix of
one shingle, the rarest in the corpus, is enough: only documents that hold a
window's prefix at a place where the window fits (positional and length bounds)
become candidates. These are verified word by word on the document's text.

Rarity is counted over all documents. The benchmark's shingles are broadcast
only up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` of words; beyond that the joins shuffle.

Edge cases: null or wordless text has no words, no hits; null or wordless items
have no windows; a null ``item_id`` is left out of the list of items, yet its
words hit; repeated rows give equal rows; the row of an untouched document has
an empty list (the SHA-256 of an empty text). Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let, skew_join, stash

BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
SHINGLE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and lower-case letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAP), "")


def _shingles(ws: Column, k: int) -> Column:
    """Hashes of the shingles of ``k`` words by place."""

    def at_each(v: Column) -> Column:
        hashed = F.transform(v, lambda w, i: F.xxhash64(w, *[F.get(v, i + F.lit(j)) for j in range(1, k)]))
        return F.slice(hashed, F.lit(1), F.greatest(F.size(v) - F.lit(k - 1), F.lit(0)))

    return let(ws, at_each)


def _covered(spans: Column) -> Column:
    """Places in the union of sorted ``(s, e)`` ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc.n + F.greatest(x.e - F.greatest(x.s, acc.end), F.lit(0))).alias("n"), F.greatest(acc.end, x.e).alias("end"))
    return F.aggregate(spans, zero, step, lambda acc: acc.n.cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """For each row of ``docs`` (``doc_id``, ``text``): ``doc_id, text_key, n_words,
    n_hit, item_ids, spans``: words, words inside occurrences of windows, the items
    (sorted strings) and the sorted word ranges ``(s, e)`` of the occurrences.
    ``text_key`` (xxhash64 of the text) tells rows of one ``doc_id`` apart."""
    strings, ranges = F.array().cast("array<string>"), F.array().cast("array<struct<s:int,e:int>>")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_key", F.coalesce("doc_id", F.lit(-1)))
    counted = rows.select("doc_id", "doc_key", "text_key", item_words(F.col("text")).alias("ws"))

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("ws")).where("size(ws) > 0")
    last = F.greatest(F.size("ws") - F.lit(window), F.lit(0))
    windows = items.select("item_id", "ws", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("item_id", F.slice("ws", F.col("i") + 1, F.lit(window)).alias("win"))
    # numbered once; which items have a window is looked up at the end
    windows = stash(windows, "item-windows")
    owners = windows.where("item_id IS NOT NULL")
    windows = stash(windows.groupBy("win").agg(F.lit(0)).select(F.monotonically_increasing_id().alias("win_id"), "win"), "windows")
    width = F.least(F.size("win"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in windows.select(width.alias("k")).distinct().collect())  # some of 1..SHINGLE
    if not sizes:
        return counted.select("doc_id", "text_key", F.size("ws").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), strings.alias("item_ids"), ranges.alias("spans"))

    tokens = [windows.where(width == k).select(F.lit(k).alias("k"), "win_id", F.size("win").alias("len"), F.posexplode(_shingles(F.col("win"), k)).alias("offset", "sh")) for k in sizes]
    tokens = stash(reduce(DataFrame.unionByName, tokens), "tokens")
    n_tokens, n_bytes = tokens.count(), windows.agg(F.sum(F.length(F.array_join("win", " ")))).first()[0]
    hint = F.broadcast if n_tokens <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES else (lambda df: df)  # windows and prefixes are no more rows than tokens

    # every place of the benchmark's shingles in the corpus
    known = stash(tokens.select("k", "sh").distinct(), "known")
    found = [counted.select("doc_key", "text_key", F.size("ws").alias("n_words"), F.posexplode(_shingles(F.col("ws"), k)).alias("pos", "sh")).join(hint(known.where(F.col("k") == k)), "sh") for k in sizes]
    found = stash(reduce(DataFrame.unionByName, found), "found")

    # the rarest shingle of each window; a window with a shingle that occurs nowhere can't occur
    rarity = found.groupBy("k", "sh").count()
    ranked = tokens.join(rarity, ["k", "sh"], "left").groupBy("k", "win_id", "len").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "sh", "offset")).alias("p"))
    prefix = stash(ranked.where("p.count > 0").select("k", "win_id", "len", "p.sh", "p.offset"), "prefix")
    places = found.join(hint(prefix), ["k", "sh"]).select("doc_key", "text_key", "n_words", (F.col("pos") - F.col("offset")).alias("start"), "len", "win_id")
    places = places.where("start >= 0 AND start + len <= n_words").select("doc_key", "text_key", "start", "win_id").distinct()

    # verification on the words of each candidate document
    cands = places.join(hint(windows), "win_id").groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("start", "win_id", "win")).alias("cands"))
    cands = stash(cands, "cands")
    narrow = bounded(cands.select("doc_key", "text_key"), BROADCAST_ROWS)
    texts = rows.join(narrow, ["doc_key", "text_key"], "left_semi").select("doc_key", "text_key", "text").dropDuplicates(["doc_key", "text_key"])
    same = lambda ws: F.filter("cands", lambda c: F.slice(ws, c.start + F.lit(1), F.size(c.win)) == c.win)
    true = cands.join(texts, ["doc_key", "text_key"]).select("doc_key", "text_key", let(item_words(F.col("text")), same).alias("hits"))
    span = F.sort_array(F.transform("hits", lambda h: F.struct(h.start.alias("s"), (h.start + F.size(h.win)).alias("e"))))
    wins = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h.win_id)))
    hits = stash(true.where("size(hits) > 0").select("doc_key", "text_key", wins.alias("wins"), span.alias("spans")).withColumns({"n_hit": _covered(F.col("spans")), "set_key": F.sha2(F.array_join(F.col("wins").cast("array<string>"), ","), 256)}), "hits")
    # the items of each distinct set of windows
    sets = hits.groupBy("set_key").agg(F.first("wins").alias("wins")).select("set_key", F.explode("wins").alias("win_id"))
    named = sets.join(hint(windows), "win_id").join(owners, "win").select("set_key", "item_id").distinct().groupBy("set_key").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    named = stash(named, "sets")
    small = bounded(named, BROADCAST_ROWS // 20, BROADCAST_BYTES)
    hits = hits.drop("wins")
    hits = hits.join(small, "set_key", "left") if small is not named else skew_join(hits, named, ["set_key"], "left")
    hits = stash(hits.select("doc_key", "text_key", "n_hit", "spans", F.coalesce("item_ids", strings).alias("item_ids")), "hits")

    out = counted.select("doc_id", "doc_key", "text_key", F.size("ws").cast("long").alias("n_words")).join(bounded(hits, BROADCAST_ROWS // 20, BROADCAST_BYTES), ["doc_key", "text_key"], "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", strings).alias("item_ids"), F.coalesce("spans", ranges).alias("spans"))
