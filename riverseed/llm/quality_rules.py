"""Quality rules: learned decision lists, in DataFrame functions.

Sequential covering on labelled documents: a rule is a conjunction of threshold
tests on text statistics. It grows test by test, each the one with the best
gain on rows not yet covered, is pruned from its end on other rows (a held-out
third), and is kept if it is precise enough there. Covered rows leave, and the
next rule starts. The list becomes one ordered conditional expression; the
first rule that holds rejects a document, and one that none holds for is kept.

Each step is one grouped count over the labelled rows: statistics are binned by
quantiles, so a step returns at most ``statistics * BINS`` rows to the driver.
At most ``max_labels`` labelled rows are used to fit (a documented bound: those
with the smallest hash of their id); rules are applied to all rows.

Edge cases: null or empty text has no words (and fails the base rule); a
``doc_id`` labelled more than once counts once for each label; labels that are
null are left out; with no labels, or none of one class, the list is empty and
only the base rule rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, stash, words

BINS = 24
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test, as expressions on the base counts.
FEATURES = {
    "word_len": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "log_words": "ln(n_words + 1)",
}


def _repeats(ws: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included."""
    grams = lambda v: F.transform(v, lambda w, i: F.struct(F.xxhash64(w, F.get(v, i + 1), F.get(v, i + 2)).alias("h"), i.alias("i")))
    ordered = let(ws, lambda v: F.sort_array(F.slice(grams(v), F.lit(1), F.greatest(F.size(v) - 2, F.lit(0)))))
    again = lambda g: F.filter(g, lambda x, j: (x.h == F.get(g, j + 1).h) | (x.h == F.get(g, j - 1).h))
    # get() is null beyond either end, and (true OR null) is true
    starts = F.sort_array(F.transform(let(ordered, again), lambda x: x.i))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a.n + i + 3 - F.greatest(i, a.end)).alias("n"), (i + 3).alias("end"))
    return F.aggregate(starts, zero, step, lambda a: a.n.cast("long"))


def text_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (``doc_id`` by default) and the counts of each row's whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), text.alias("_t"))
    has_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split("_t", "\n"), has_word)
    chars = lambda drop: F.length("_t") - F.length(F.regexp_replace("_t", drop, ""))
    src = src.withColumns({"_w": words(F.col("_t")), "_l": lines})
    names = [c for c in src.columns if c not in ("_t", "_w", "_l")]
    return src.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        chars(f"[{SYMBOLS}]".replace("$", r"\$")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        chars("[A-Z]").cast("long").alias("n_upper"),
        chars("[0-9]").cast("long").alias("n_digits"),
        chars(r"[!?]").cast("long").alias("n_marks"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


@dataclass
class DecisionList:
    """Ordered rules that reject; each is a list of ``(feature, op, threshold)``."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)
    stats: list[tuple[int, int]] = field(default_factory=list)  # bad and good rows that each rule covers when held out

    def sql(self) -> str:
        """The number of the first rule that holds, 0 if none, as one expression."""
        test = lambda rule: " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in rule)
        return "CASE " + " ".join(f"WHEN {test(r)} THEN {i}" for i, r in enumerate(self.rules, 1)) + " ELSE 0 END" if self.rules else "0"


def _entropy_gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of a test, as in FOIL: bits saved on each bad row covered."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def bounded_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows ``(_id, bad)``, those of the smallest hashes of ``doc_id``."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("q")).where("_id IS NOT NULL AND q IN (0, 1)").distinct()
    return stash(marks.orderBy(F.xxhash64("_id"), "_id", "q").limit(max_rows).select("_id", (F.col("q") == 0).alias("bad")), "marks")


def learn(stats: DataFrame, marks: DataFrame, max_rules: int = 8, max_tests: int = 3, precision: float = 0.97) -> DecisionList:
    """Fit the list on ``stats`` (of :func:`text_statistics`) and ``marks`` (of
    :func:`bounded_labels`). A rule needs ``precision`` on held-out rows."""
    fit = stats.join(F.broadcast(marks), stats.doc_id == marks["_id"]).where(f"NOT {BASE_FAILED}")
    fit = fit.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"), *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])
    fit = stash(fit, "fit")
    cuts = fit.select(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first().asDict()
    cuts = {f: sorted(set(v)) for f, v in cuts.items() if v}
    found = DecisionList()
    if not cuts:
        return found
    below = lambda f, v: F.array_size(F.filter(F.array(*map(F.lit, v)), lambda c: c < F.col(f)))
    binned = fit.select("bad", "held", *[below(f, v).alias(f) for f, v in cuts.items()])
    binned = stash(binned, "binned")
    test = lambda f, op, b: f"{f} {op} {b}"
    left = "true"
    for _ in range(max_rules):
        rule: list[tuple[str, str, int]] = []
        while len(rule) < max_tests:
            where = " AND ".join([left, "NOT held", *(test(*t) for t in rule)])
            rows = binned.where(where).select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in cuts])).alias("x"))
            hist = rows.groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()  # at most features * BINS rows
            first = next(iter(cuts))
            p0, n0 = sum(h.p for h in hist if h.f == first), sum(h.n for h in hist if h.f == first)
            if not p0 or not n0:
                break
            best = None
            for f in cuts:
                own = sorted((h.b, h.p, h.n) for h in hist if h.f == f)
                for op, walk in (("<", own), (">=", own[::-1])):
                    p = n = 0
                    for k, (b, hp, hn) in enumerate(walk[:-1]):
                        p, n = p + hp, n + hn
                        gain = _entropy_gain(p, n, p0, n0)
                        bound = walk[k + 1][0] if op == "<" else b
                        if best is None or (gain, -len(f), f) > best[0]:
                            best = ((gain, -len(f), f), (f, op, bound))
            if best is None or best[0][0] <= 0:
                break
            rule.append(best[1])
        # prune: of the rule's beginnings the most precise on held-out rows
        scored = []
        for k in range(len(rule), 0, -1):
            p, n = binned.where(" AND ".join([left, "held", *(test(*t) for t in rule[:k])])).agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
            scored.append(((p + 1) / (p + n + 2), p, n, k))
        worth, p, n, k = max(scored, key=lambda s: (s[0], s[1]), default=(0, 0, 0, 0))
        if not p or p / (p + n) < precision:
            break
        rule = rule[:k]
        found.rules.append([(f, op if op == ">=" else "<", cuts[f][b - 1]) for f, op, b in rule])
        found.stats.append((p, n))
        left += f" AND NOT ({' AND '.join(test(*t) for t in rule)})"
    # bin >= b means value > cuts[b-1]; bin < b means value <= cuts[b-1]
    found.rules = [[(f, ">" if op == ">=" else "<=", t) for f, op, t in r] for r in found.rules]
    return found


def apply_rules(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (number of the one that rejects, or 0) and ``kept``."""
    return stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", F.expr(rules.sql())).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_labels: int = 20_000, **options) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict of each row of ``docs`` (with its columns ``keep``), and the rules."""
    marks = bounded_labels(labels, max_labels)
    wanted = marks.select("_id").distinct()
    # written first: a filter on statistics must not sink below the join and read all texts
    labelled = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), F.col("doc_id") == wanted["_id"], "left_semi"), "labelled")
    rules = learn(text_statistics(labelled), marks, **options)
    return apply_rules(text_statistics(docs, keep), rules), rules
