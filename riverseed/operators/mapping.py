"""Seed index, occurrence limits, seed joins and best placements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..work import stash


def occurrences(index: DataFrame) -> DataFrame:
    return index.groupBy("hash").agg(F.count("*").alias("n_occ"))


#: Hashes that may be broadcast (16 bytes each).
BROADCAST_HASHES = 4_000_000


def _hint(hashes: DataFrame) -> DataFrame:
    """A written table of distinct hashes, broadcast if they are few enough."""
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes


@dataclass(frozen=True)
class Shared:
    """Seeds of queries and the index's seeds of the same hashes, both written, and how many
    of each a hash has: ``counts`` are ``(hash, nq, nt)``, written once for all that follows."""

    queries: DataFrame
    index: DataFrame
    counts: DataFrame
    max_occ: int

    def often(self) -> DataFrame:
        """Hashes of more than ``max_occ`` places in the index."""
        return _hint(stash(self.counts.where(F.col("nt") > self.max_occ).select("hash"), "frequent"))


def _found(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The index's seeds of the hashes that the written ``queries`` have."""
    return index.join(_hint(stash(queries.select("hash").distinct(), "hashes")), "hash", "left_semi")


def _counts(queries: DataFrame, index: DataFrame) -> DataFrame:
    one = queries.select("hash", F.lit(1).alias("q"), F.lit(0).alias("t")).unionByName(index.select("hash", F.lit(0).alias("q"), F.lit(1).alias("t")))
    return stash(one.groupBy("hash").agg(F.sum("q").alias("nq"), F.sum("t").alias("nt")), "counts")


def share(queries: DataFrame, index: DataFrame, max_occ: int) -> Shared:
    """The index is cut to the queries' hashes by a filter of its scan as long as those can
    be broadcast; hashes are counted with sums before their one shuffle."""
    queries = stash(queries, "queries")
    found = stash(_found(index, queries), "shared")
    return Shared(queries, found, _counts(queries, found), max_occ)


@dataclass(frozen=True)
class Stored:
    """A saved index: ``seeds`` ``(id, rev, pos, hash)`` and ``counts`` ``(hash, n_occ)`` in
    buckets by hash, ``lengths`` ``(tid, t_len)``, its occurrence limit, and, if they were
    saved, the targets' ``events`` ``(id, rev, block, values)`` in buckets by place."""

    seeds: DataFrame
    counts: DataFrame
    lengths: DataFrame
    max_occ: int
    events: DataFrame | None = None


def share_stored(queries: DataFrame, stored: Stored) -> Shared:
    """As :func:`share` with a saved index: nothing of it is counted, written or shuffled
    again; only the queries are dealt to its buckets."""
    queries = stash(queries, "queries")
    mine = queries.groupBy("hash").agg(F.count("*").alias("nq"))
    counts = mine.join(stored.counts, "hash").select("hash", "nq", F.col("n_occ").alias("nt"))
    return Shared(queries, stored.seeds, stash(counts, "counts"), stored.max_occ)


#: Pairs of a hash that one task makes at least; a hash of fewer is never split.
LEAST_PAIRS = 10_000


def pieces(shared: Shared, tasks: int, least: int | None = None) -> DataFrame | None:
    """``(hash, pq, pt)`` of hashes whose pairs of places are more than a tenth of a task's
    even share: into how many pieces the queries' and the index's seeds are dealt, so that
    each pair of pieces has about that many pairs at most. A side is split to the root of
    that number or left whole where it is shorter, so a seed is copied no oftener than the
    other side has pieces. There are ten such hashes for each task at most; None if none."""
    kept = shared.counts.where((F.col("nq") > 0) & F.col("nt").between(1, shared.max_occ)).withColumn("pairs", F.col("nq") * F.col("nt"))
    total = kept.agg(F.coalesce(F.sum(F.col("pairs").cast("double")), F.lit(0.0))).first()[0]
    limit = max(total / (10 * max(tasks, 1)), LEAST_PAIRS if least is None else least)
    side = max(int(limit**0.5), 1)
    hot = kept.where(F.col("pairs") > limit)
    longer = F.greatest("nq", "nt")
    few = F.greatest(F.ceil(F.least("nq", "nt") / side), F.lit(1))  # pieces of the shorter side
    many = F.greatest(F.ceil(longer * F.ceil(F.least("nq", "nt") / few) / limit), F.lit(1))
    of_query = F.when(F.col("nq") >= F.col("nt"), many).otherwise(few)
    of_index = F.when(F.col("nq") >= F.col("nt"), few).otherwise(many)
    hot = stash(hot.select("hash", of_query.cast("int").alias("pq"), of_index.cast("int").alias("pt")), "hot")
    return None if hot.isEmpty() else hot


def _paired(shared: Shared, q: DataFrame, t: DataFrame, q_place: list[str], t_place: list[str], least: int | None) -> DataFrame:
    """``q`` and ``t``, rows of the queries and of the index, joined by hash. A hash with
    many pairs is split on both sides: each row goes by its place to one piece of its own
    side and is copied for every piece of the other, so that each pair meets once and no
    hash makes a large task."""
    hot = pieces(shared, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    if hot is None:
        return q.join(t, "hash").drop("hash")
    hot = F.broadcast(hot)

    def dealt(rows: DataFrame, own: str, other: str, names: tuple[str, str], of: list[str]) -> DataFrame:
        rows = rows.join(hot, "hash")
        rows = rows.withColumn(names[0], F.pmod(F.xxhash64(*of), F.col(own)).cast("int"))
        return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("pq", "pt")

    cold = lambda rows: rows.join(hot, "hash", "left_anti")
    split = dealt(q, "pq", "pt", ("a", "b"), q_place).join(dealt(t, "pt", "pq", ("b", "a"), t_place), ["hash", "a", "b"])
    return cold(q).join(cold(t), "hash").drop("hash").unionByName(split.drop("hash", "a", "b"))


def match(shared: Shared, least: int | None = None) -> DataFrame:
    """Anchors ``(qid, q_pos, tid, t_pos)``, and ``rev`` if the index has it: equal hashes of
    at most ``max_occ`` places. Frequent hashes leave both sides before the join; hashes with
    many pairs are split."""
    often = shared.often()
    extra = [c for c in ("rev",) if c in shared.index.columns]
    t = shared.index.join(often, "hash", "left_anti").select("hash", F.col("id").alias("tid"), *extra, F.col("pos").alias("t_pos"))
    q = shared.queries.join(often, "hash", "left_anti").select("hash", F.col("id").alias("qid"), F.col("pos").alias("q_pos"))
    return _paired(shared, q, t, ["qid", "q_pos"], ["tid", "t_pos", *extra], least)


def seed_matches(queries: DataFrame, index: DataFrame, max_occ: int) -> DataFrame:
    """:func:`match` of seeds that nothing else is asked of."""
    return match(share(queries, index, max_occ))


def frequent(seeds: DataFrame, max_occ: int) -> DataFrame:
    """Hashes of more than ``max_occ`` of the seeds, at most ``seeds / max_occ``."""
    return stash(occurrences(seeds).where(F.col("n_occ") > max_occ).select("hash"), "frequent")


def diagonal_bins(anchors: DataFrame, width: int = 25) -> DataFrame:
    """Anchors counted by target and diagonal band."""
    return anchors.groupBy("qid", "tid", F.floor((F.col("t_pos") - F.col("q_pos")) / width).cast("long").alias("bin")).agg(F.count("*").alias("cnt"), F.min("t_pos").alias("t_start"), F.max("t_pos").alias("t_end"))


def best_placement(bins: DataFrame, least: int = 15) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("cnt"), "tid", "bin")
    return bins.where(F.col("cnt") >= least).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def mid_occ(index: DataFrame, frac: float = 0.01, low: int = 50, high: int = 500_000) -> DataFrame:
    """One row ``mid_occ``: the count at the place ``(1 - frac) * n`` of the ``n`` hashes in
    order of their counts, plus one, within the limits. Works on the histogram of counts."""
    return quantile_of(occurrences(index).groupBy("n_occ").agg(F.count("*").alias("n")), frac, low, high)


def quantile_of(h: DataFrame, frac: float, low: int, high: int) -> DataFrame:
    """:func:`mid_occ` of a histogram ``(n_occ, n)``, ``n`` hashes of that count."""
    w = Window.orderBy("n_occ")
    h = h.select("n_occ", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.floor(F.lit(1 - frac) * F.col("total"))
    return h.where(F.col("upto") > at).agg(F.least(F.greatest(F.min("n_occ") + 1, F.lit(low)), F.lit(high)).cast("long").alias("mid_occ"))


def match_counts(queries: DataFrame, index: DataFrame, max_occ: int | None = None, least: int | None = None) -> DataFrame:
    """Anchors of each query and target as products of counts by hash, over all hashes or,
    if ``max_occ`` is given, those of at most so many places in the index. Places are counted
    by hash and owner before they meet, so a hash makes a row for each query and target that
    have it, no pairs of places; hashes of many such rows are split as in :func:`match`."""
    tally = lambda seeds: seeds.groupBy("hash", "id").agg(F.count("*").alias("n"))
    queries = stash(tally(queries), "queries")
    found = stash(tally(_found(index, queries)), "shared")
    if max_occ is not None:
        often = found.groupBy("hash").agg(F.sum("n").alias("n_occ")).where(F.col("n_occ") > max_occ).select("hash")
        found = found.join(_hint(stash(often, "frequent")), "hash", "left_anti")
    shared = Shared(queries, found, _counts(queries, found), 2**62)
    q = queries.select("hash", F.col("id").alias("qid"), F.col("n").alias("nq"))
    t = found.select("hash", F.col("id").alias("tid"), F.col("n").alias("nt"))
    return _paired(shared, q, t, ["qid"], ["tid"], least).groupBy("qid", "tid").agg(F.sum(F.col("nq") * F.col("nt")).alias("n_anchors"))


def frequent_in_read(queries: DataFrame, frac: float) -> DataFrame:
    """Seeds of hashes that make at most ``frac`` of their read's seeds."""
    n = F.count("*").over(Window.partitionBy("id"))
    m = F.count("*").over(Window.partitionBy("id", "hash"))
    return queries.withColumn("m", m).withColumn("n", n).where(F.col("m") <= frac * F.col("n")).drop("m", "n")


def tandem(queries: DataFrame) -> DataFrame:
    """``tandem``: whether the seed before or after has the same hash."""
    w = Window.partitionBy("id").orderBy("pos")
    same = lambda c: F.coalesce(c.over(w) == F.col("hash"), F.lit(False))
    return queries.withColumn("tandem", same(F.lag("hash")) | same(F.lead("hash")))


def repeat_length(shared: Shared, span: int) -> DataFrame:
    """``(qid, rep_len)``: length covered by the seeds dropped for their occurrences, each
    from its place + 1 over span + 1 places. Intervals that only touch stay apart, which
    leaves the sum as it is."""
    iv = shared.queries.join(shared.often(), "hash", "left_semi").select(F.col("id").alias("qid"), (F.col("pos") + 1).alias("st"), (F.col("pos") + 2 + span).alias("en"))
    before = F.max("en").over(Window.partitionBy("qid").orderBy("st", "en").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("en") - F.greatest(F.col("st"), F.coalesce(before, F.col("st"))), F.lit(0))
    return iv.select("qid", new.alias("x")).groupBy("qid").agg(F.sum("x").alias("rep_len"))


def all_pairs(index: DataFrame, max_occ: int) -> DataFrame:
    """Anchors of all against all: pairs of different owners, the lesser name (in byte
    order) as the query, over hashes of at most ``max_occ`` places."""
    index = stash(index, "all-seeds")
    rare = occurrences(index).where(F.col("n_occ").between(2, max_occ)).select("hash")
    kept = index.join(_hint(frequent(index, max_occ)), "hash", "left_anti").join(rare, "hash", "left_semi")
    q = kept.select("hash", F.col("id").alias("qid"), F.col("pos").alias("q_pos"))
    t = kept.select("hash", F.col("id").alias("tid"), F.col("pos").alias("t_pos"))
    return q.join(t, "hash").where(F.col("qid").cast("string") < F.col("tid").cast("string")).drop("hash")


#: The tags of a mapping, their types and what they are without one.
TAGS = {"mt": ("f", "0.000000"), "ci": ("i", "1"), "sl": ("i", "0"), "cm": ("i", "0"), "nc": ("i", "0"), "s1": ("i", "0"), "sm": ("f", "0")}


def paf(rows: DataFrame) -> DataFrame:
    """The twelve columns and the tags as one tab-separated ``line`` for each row; where
    ``tid`` is null the read is unmapped and its places are ``*``. Tags are taken from the
    columns that there are: milliseconds ``mt`` (6 digits), chunks ``ci``, samples ``sl`` (the
    read's length if absent), anchors ``cnt``, chains ``nc``, ``score``, mean score ``sm``."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    cols = [F.col("qid").cast("string"), F.col("q_len").cast("string"), star("qs"), star("qe"), F.when(F.col("tid").isNull(), "*").when(F.col("rev") == 1, "-").otherwise("+"), star("tid"), star("t_len"), star("rs"), star("re")]
    n_match = F.coalesce((F.col("qe") - F.col("qs") - 1).cast("string"), F.lit("*"))
    block = F.coalesce((F.col("re") - F.col("rs")).cast("string"), F.lit("*"))
    source = {"cm": "cnt", "s1": "score", "sl": "sl" if "sl" in rows.columns else "q_len"}
    shown = {"mt": lambda c: F.format_string("%.6f", c.cast("double")), "sm": lambda c: F.format_string("%.2f", c.cast("double"))}
    tags = []
    for tag, (kind, none) in TAGS.items():
        name = source.get(tag, tag)
        value = shown.get(tag, lambda c: c.cast("string"))(F.col(name)) if name in rows.columns else F.lit(None)
        value = F.when(F.col(name).isNotNull(), value) if name in rows.columns else value
        tags.append(F.concat(F.lit(f"{tag}:{kind}:"), F.coalesce(value, F.lit(none))))
    return rows.select("qid", F.concat_ws("\t", *cols, n_match, block, F.coalesce("mapq", F.lit(0)).cast("string"), *tags).alias("line"))
