"""Personal data by candidate gradient boosting, in DataFrame functions.

Base patterns give spans of e-mail addresses, IP addresses, card numbers and
phone numbers. High-recall generators propose further, overlapping spans of the
same kinds, and of secrets (keys, tokens, passwords). Boosted trees over format and
context features score the proposals; those above the threshold of their kind that
touch no base span are added, the best first where they overlap.

The trees learn from a bounded sample: the proposals of at most ``max_docs`` texts
(those of the smallest hashes), and of their distinct feature vectors at most
``max_vectors`` of each kind and label (again by hash). Labels are weak, and none
rests on whether a base span is touched:

* positive: what passes a kind's full check (a base span; for a secret, an assignment
  such as ``token = "..."``), and twins of it in which just that evidence is hidden:
  the ``@`` spelled out, no ``+``, other separators, no words around it;
* negative: what fails the format checks of its kind (Luhn, octets, number of digits,
  a secret without a letter or digit) or lies in a base span of another kind, and twins
  of positives broken so that they fail;
* not used: all else, among it what the model is there to find.

Thresholds are calibrated for each kind on held-out texts. The model becomes one
conditional expression.

Places are code points, ends exclusive. Where a text has no character that a
pattern needs, the pattern isn't tried. Patterns are written so that a failing
start isn't tried again inside the same run of characters; they match what the
plain ones do, in time linear in the text.

Edge cases: null or empty text has no spans; repeated rows give equal rows; with
no examples of one class the model adds nothing, and a kind without enough held-out
positives gets no spans added. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stash

KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans that may be added.
ALL_KINDS = (*KINDS, "secret")
# The base patterns. Possessive and anchored forms of
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: High-recall generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,64}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3,7}+(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,22}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+|(?<=[=:]\x20?[\x22']?)[A-Za-z0-9_+/-]{6,}+",
}
#: What stands before an assigned secret.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|credential|auth|key)[\x22']?\s*[=:]\s*[\x22']?\z"
FEATURES = (
    "n_chars", "n_digits", "n_letters", "n_upper", "n_seps", "n_parts", "longest", "shortest", "tail", "tail_letters", "turns", "luhn", "octets", "paren", "at", "dots",
    "before", "after", "word_before", "hint", "assigned", "kind",
)
BINS = 16


def _count(s: Column, cls: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, cls, ""))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: v - F.when(v > 9, 9).otherwise(0))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


SPANS = "array<struct<s:int,e:int,m:string>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``(s, e, m)``: places are added up over
    the pieces between matches and the matches."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["p"])
        end = start + F.length(z["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), z["m"].alias("m"))).alias("out"))

    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    both = lambda ms: F.zip_with(ms, F.slice(pieces, F.lit(1), F.size(ms)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    return let(matches, lambda ms: F.when(F.size(ms) > 0, F.aggregate(both(ms), zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS)))


def _tried(kind: str, text: Column, pattern: str, wide: bool = False) -> Column:
    needs = [F.col("_digits")] if kind not in ("email", "secret") else [F.lit(True)]
    if NEEDS[kind] and not (wide and kind in ("email", "phone")):
        needs.append(F.contains(text, F.lit(NEEDS[kind])))
    if wide and kind == "email":
        needs.append(text.rlike(r"@|[\[(]at[\])]"))
    return F.when(reduce(Column.__and__, needs), located(text, pattern)).otherwise(F.array().cast(SPANS))


def _with_base(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``_t``) and, for each kind, the base spans as ``_<kind>``."""
    rows = rows.withColumn("_digits", F.col("_t").rlike("[0-9]"))
    base = lambda k: F.filter(_tried(k, F.col("_t"), BASE[k]), lambda x: _valid(k, x.m))
    return rows.withColumns({f"_{k}": base(k) for k in KINDS})


def _features(kind: Column, m: Column, before: Column, after: Column) -> Column:
    """The features of a proposal ``m`` of a kind, with the text before and the character
    after it, as a struct."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    parts = F.array_remove(F.split(m, r"[\x20().@\[\]-]+"), "")
    char_class = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[0-9]"), 3).when(c.rlike(r"[.,;:!?]"), 4).when(c == "+", 6).otherwise(5)
    size = lambda f: let(parts, lambda p: F.coalesce(f(F.transform(p, F.length)), F.lit(0)))
    tail = F.regexp_extract(m, r"[^.\x20\]\)]*\z", 0)
    flag = lambda c: c.cast("int")
    values = {
        "n_chars": F.length(m), "n_digits": F.length(digits), "n_letters": _count(m, "[A-Za-z]"), "n_upper": _count(m, "[A-Z]"), "n_seps": _count(m, r"[\x20().-]"),
        "n_parts": F.size(parts), "longest": size(F.array_max), "shortest": size(F.array_min), "tail": F.length(tail), "tail_letters": _count(tail, "[A-Za-z]"),
        "turns": F.regexp_count(m, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")),
        "luhn": F.when(F.length(digits).between(12, 23), flag(luhn(digits))).otherwise(-1),
        "octets": flag(m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")), "paren": flag(m.contains("(")), "at": flag(m.contains("@")), "dots": _count(m, r"\."),
        "before": char_class(F.substring(before, -1, 1)), "after": char_class(after), "word_before": flag(before.rlike(r"[A-Za-z][,:=(]?\s*\+?\z")),
        "hint": flag(F.lower(before).rlike("mail|phone|call|tel|card|contact|address|host|server|fax|token|secret|passw|key")),
        "assigned": flag(before.rlike(r"[=:]\s*[\x22']?\z")), "kind": kind,
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def _around(text: Column, x: Column) -> tuple[Column, Column]:
    """What stands before a span (24 characters at most), and the character after it."""
    return F.substring(text, F.greatest(x["s"] - F.lit(23), F.lit(1)), F.least(x["s"], F.lit(24))), F.substring(text, x["e"] + F.lit(1), F.lit(1))


def _proposed(rows: DataFrame, scored: bool = True) -> DataFrame:
    """``rows`` with base spans and ``_x``: proposals ``(kind, s, e, free, ...)``; free: it
    touches no base span. ``scored``: those that are free, with their features ``f``; else
    all, with ``m, before, after``, and ``own`` and ``other``: it overlaps a base span of its
    kind, of another."""
    touches = lambda x, kinds: reduce(Column.__or__, [F.exists(f"_{o}", lambda b: (b.s < x.e) & (x.s < b.e)) for o in kinds], F.lit(False))

    def made(n: int, k: str) -> Column:
        found = _tried(k, F.col("_t"), WIDE[k], wide=True)

        def proposal(x: Column) -> Column:
            before, after = _around(F.col("_t"), x)
            at = [F.lit(n).alias("kind"), x.s.alias("s"), x.e.alias("e")]
            if scored:
                return F.struct(*at, _features(F.lit(n), x.m, before, after).alias("f"))
            own = touches(x, [k]) if k in KINDS else before.rlike(ASSIGNED)
            return F.struct(*at, x.m.alias("m"), before.alias("before"), after.alias("after"), own.alias("own"), touches(x, [o for o in KINDS if o != k]).alias("other"))

        return F.transform(F.filter(found, lambda x: ~touches(x, KINDS)) if scored else found, proposal)

    return rows.withColumn("_x", F.concat(*[made(n, k) for n, k in enumerate(ALL_KINDS)]))


def _examples(proposals: DataFrame) -> DataFrame:
    """``(kind, m, before, after, hit)`` of labelled proposals and of their twins."""
    m, kind, digits = F.col("m"), F.col("kind"), F.regexp_replace("m", "[^0-9]", "")
    is_kind = lambda k: kind == ALL_KINDS.index(k)
    fails = F.when(is_kind("secret"), ~(m.rlike("[0-9]") & m.rlike("[A-Za-z]"))).when(is_kind("email"), F.lit(False))
    for k in ("ip", "card", "phone"):
        fails = fails.when(is_kind(k), ~_valid(k, m))
    hit = F.when(F.col("own"), True).when(F.col("other") | fails, False)
    ex = lambda text, hit, before="before", after="after": F.struct(text.alias("m"), F.col(before).alias("before") if isinstance(before, str) else before.alias("before"), F.col(after).alias("after") if isinstance(after, str) else after.alias("after"), F.lit(hit).alias("hit"))
    blank = {"before": F.lit(" "), "after": F.lit(" ")}
    # the last digit moved on by one breaks every Luhn sum
    luhn_broken = F.concat(F.expr("substring(m, 1, length(m) - 1)"), F.translate(F.substring(m, -1, 1), "0123456789", "1234567890"))
    spelled = F.replace(F.regexp_replace(m, r"\.(?=[^.]*\z)", "[dot]"), F.lit("@"), F.lit(" [at] "))
    bare = F.regexp_replace(m, r"\A\+", "")
    local = F.regexp_replace(m, r"\A\+?[0-9]{1,3}[\x20.-]+", "")
    twins = {
        "email": [ex(F.replace(m, F.lit("@"), F.lit(" @ ")), True), ex(spelled, True), ex(spelled, True, **blank), ex(F.regexp_replace(m, r"[A-Za-z-]+\z", "7"), False), ex(F.regexp_replace(spelled, r"[A-Za-z-]+\z", "7"), False), ex(F.regexp_replace(m, r"@.*\.", " @ the."), False)],
        "ip": [ex(m, True, **blank), ex(F.regexp_replace(m, r"\A[0-9]+", "789"), False), ex(F.regexp_replace(m, r"[0-9]+\z", "999"), False, **blank), ex(F.concat(m, F.lit(".12")), False)],
        "card": [ex(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1."), True), ex(digits, True, **blank), ex(luhn_broken, False), ex(luhn_broken, False, **blank), ex(F.regexp_replace(luhn_broken, "([0-9]{4})(?=[0-9])", "$1."), False)],
        "phone": [ex(bare, True), ex(bare, True, **blank), ex(local, True), ex(local, True, **blank), ex(F.regexp_replace(bare, r"[\x20()-]+(?=[0-9])", "."), True), ex(F.regexp_replace(bare, r"[()-]", ""), True), ex(F.concat(digits, digits), False), ex(F.substring(digits, 1, 7), False), ex(F.regexp_replace(digits, "([0-9]{4})([0-9]{2})([0-9]{2}).*", "$1-$2-$3"), False)],
        "secret": [ex(m, True, **blank), ex(F.translate(m, "0123456789", "esaiotnrhl"), False, **blank), ex(F.regexp_replace(m, "[^0-9]", "5"), False, **blank), ex(F.regexp_replace(m, "[^0-9]", "5"), False), ex(F.regexp_replace(m, r"\A(...)(.*)(...)\z", "$1-the-$3"), False, **blank)],
    }
    own = F.array(F.struct("m", "before", "after", hit.alias("hit")))
    more = F.lit(None)
    for k, made in twins.items():
        more = F.when(is_kind(k) & F.col("own") & (_valid(k, m) if k != "phone" else F.length(digits).between(8, 15)), F.array(*made)).otherwise(more)
    out = proposals.select("h", "kind", F.explode(F.concat(own, F.coalesce(more, F.slice(own, 2, 1)))).alias("x"))
    return out.select("h", "kind", "x.*").where("hit IS NOT NULL AND length(m) > 0")


@dataclass
class Boosted:
    """Sums of depth-2 trees over binned features and the thresholds that select, by kind."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)  # (feature, cut, (feature, cut, low, high) | value, the same)
    thresholds: dict[int, float] = field(default_factory=dict)  # a kind without one gets no spans

    def score(self, f: Column) -> Column:
        def tree(t) -> Column:
            pick = lambda u: F.lit(u) if isinstance(u, float) else F.when(f[u[0]] <= u[1], F.lit(u[2])).otherwise(F.lit(u[3]))
            return F.when(f[t[0]] <= t[1], pick(t[2])).otherwise(pick(t[3]))

        return reduce(Column.__add__, map(tree, self.trees), F.lit(self.bias))

    def selects(self, kind: Column, score: Column) -> Column:
        known = reduce(lambda c, kt: c.when(kind == kt[0], score >= F.lit(kt[1])), self.thresholds.items(), F.when(F.lit(False), False))
        return known.otherwise(False)


def fit_boosted(x: np.ndarray, y: np.ndarray, held: np.ndarray, weight: np.ndarray | None = None, rounds: int = 24, rate: float = 0.4, precision: float = 0.9) -> Boosted:
    """Newton boosting of depth-2 trees on integer features; rows count ``weight`` times.
    A kind's threshold is the lowest score above which its held-out rows have
    ``precision`` (with half a hit and half a miss added: few rows select nothing)."""
    model = Boosted()
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    fit = ~held
    if not len(y) or not (0 < y[fit].sum() < fit.sum()):
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS), method="lower"))[:-1] for c in x[fit].T]
    p0 = np.average(y[fit], weights=weight[fit])
    model.bias = float(math.log(p0 / (1 - p0)))
    score = np.full(len(y), model.bias)

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        found = (1e-6, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j, own in enumerate(cuts):
            for c in own:
                low = rows & (x[:, j] <= c)
                high = rows & ~low
                if low[fit].any() and high[fit].any():
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                    if gain > found[0]:
                        found = (gain, (j, int(c)))
        return found[1]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = np.where(fit, weight * (y - p), 0.0), np.where(fit, weight * p * (1 - p), 0.0)
        leaf = lambda rows, g=g, h=h: float(round(rate * g[rows].sum() / (h[rows].sum() + 1), 6))
        root = best(fit, g, h)
        if root is None:
            break
        sides = []
        for rows in (x[:, root[0]] <= root[1], x[:, root[0]] > root[1]):
            cut = best(rows & fit, g, h)
            if cut is None:
                sides.append(leaf(rows))
                score[rows] += sides[-1]
            else:
                low, high = rows & (x[:, cut[0]] <= cut[1]), rows & (x[:, cut[0]] > cut[1])
                sides.append((FEATURES[cut[0]], cut[1], leaf(low), leaf(high)))
                score[low] += sides[-1][2]
                score[high] += sides[-1][3]
        model.trees.append((FEATURES[root[0]], root[1], *sides))
    kinds = x[:, FEATURES.index("kind")]
    for k in np.unique(kinds).tolist():
        own = np.flatnonzero(held & (kinds == k))
        own = own[np.argsort(-score[own], kind="stable")]
        s, n, hits = score[own], np.cumsum(weight[own]), np.cumsum((weight * y)[own])
        good = (hits + 0.5) / (n + 1) >= precision
        good &= np.r_[s[1:] < s[:-1], True] if len(s) else good
        if good.any():
            model.thresholds[int(k)] = float(s[np.flatnonzero(good)[-1]])
    return model


def labelled_vectors(docs: DataFrame, max_docs: int = 20_000, max_vectors: int = 20_000) -> DataFrame:
    """The distinct feature vectors of labelled proposals and twins, ``hit`` and ``held``
    (out), and how often each occurs as ``count``, within the bounds of the sample."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("_t")).where(F.col("_t").rlike("[0-9@=:]")).withColumn("h", F.xxhash64("_t"))
    keys = stash(rows.select("h").distinct().orderBy("h").limit(max_docs), "sample")
    rows = rows.join(F.broadcast(keys), "h", "left_semi").groupBy("h").agg(F.first("_t").alias("_t"))  # at most max_docs rows
    made = _examples(_proposed(_with_base(rows), scored=False).select("h", F.explode("_x").alias("x")).select("h", "x.*"))
    vectors = made.select("h", "hit", _features(F.col("kind"), F.col("m"), F.col("before"), F.col("after")).alias("f")).select("h", "hit", "f.*")
    seen = vectors.groupBy("hit", (F.pmod("h", F.lit(3)) == 0).alias("held"), *FEATURES).count()
    order = Window.partitionBy("kind", "hit").orderBy(F.xxhash64(*FEATURES), "held", *FEATURES)
    return seen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_vectors).drop("_n")


def learn(docs: DataFrame, max_docs: int = 20_000, max_vectors: int = 20_000) -> Boosted:
    """Fit on :func:`labelled_vectors`."""
    seen = labelled_vectors(docs, max_docs, max_vectors).orderBy("hit", "held", *FEATURES).collect()
    column = lambda c, kind: np.array([r[c] for r in seen], kind)
    return fit_boosted(np.array([[r[f] for f in FEATURES] for r in seen]), column("hit", bool), column("held", bool), column("count", float))


def personal_data(docs: DataFrame, model: Boosted | None = None, keep: list[str] | None = None, max_docs: int = 20_000) -> DataFrame:
    """``keep`` (``doc_id``) of each row of ``docs``, the base spans as ``base``, and base
    and added spans as ``spans``: arrays of ``(k, s, e)``, k the number of the kind."""
    model = learn(docs, max_docs) if model is None else model
    rows = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    names = [c for c in rows.columns if c != "_t"]
    rows = _with_base(rows)
    spans = lambda n, k: F.transform(f"_{k}", lambda x: F.struct(F.lit(n).alias("k"), x.s.alias("s"), x.e.alias("e")))
    base = F.concat(*[spans(n, k) for n, k in enumerate(KINDS)])
    if not model.trees or not model.thresholds:
        return rows.withColumn("base", base).select(*names, "base", F.col("base").alias("spans"), F.col("_t").alias("text_read"))
    rows = _proposed(rows).withColumn("base", base)
    scored = F.transform("_x", lambda x: F.struct((-model.score(x.f)).alias("v"), x["kind"].alias("k"), x.s.alias("s"), x.e.alias("e")))
    picked = F.array_sort(F.filter(scored, lambda x: model.selects(x.k, -x.v)))
    zero = F.array().cast("array<struct<k:int,s:int,e:int>>")
    clear = lambda acc, x: ~F.exists(acc, lambda b: (b.s < x.e) & (x.s < b.e))
    added = F.aggregate(picked, zero, lambda acc, x: F.when(clear(acc, x), F.array_append(acc, F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e")))).otherwise(acc))
    return rows.select(*names, "base", F.array_sort(F.concat("base", added)).alias("spans"), F.col("_t").alias("text_read"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (overlapping ones together) replaced by ``[KIND]``."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in ALL_KINDS]), k + 1)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + F.lit(1), x.s - acc["at"])
        fresh = F.struct(x.e.alias("at"), F.concat(acc["out"], gap, name(x.k)).alias("out"))
        return F.when(x.s >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], x.e).alias("at"), acc["out"].alias("out")))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + F.lit(1), F.length(text))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by kind and start, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ALL_KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x.k), x.s.cast("string"), x.e.cast("string"))), ",")
