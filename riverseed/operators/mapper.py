"""Whole runs: map texts or raw signals to targets, and overlap all with all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options
from ..work import stash
from . import align, chain, mapping, scan, signal, sketch
from .clock import Clock


def n_letters(text: str = "text", alphabet: str = "letters"):
    """Bases of a text."""
    return F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]" if alphabet == "letters" else r"[\x20\x09-\x0D]", "")).cast("int")


def target_index(targets: DataFrame, key: str, o: Options, pore: np.ndarray | None = None) -> DataFrame:
    """``(id, rev, pos, hash)`` seeds of the forward strand and, if set, the reverse one."""
    return text_index(targets, key, o, pore).seeds()


def text_index(targets: DataFrame, key: str, o: Options, pore: np.ndarray | None = None) -> scan.TextIndex:
    """The same seeds, to be used where they are made."""
    return scan.TextIndex(targets, key, o, o.rev_target, pore)


def signal_index(samples: DataFrame, o: Options, detect: bool = True) -> DataFrame:
    """``(id, rev, pos, hash)`` seeds of targets that are signals ``(read_id, pos, pa)``:
    whole, one strand; ``detect`` off takes samples for events."""
    whole = Options(**{**vars(o), "adaptive": False, "min_events": 0})
    return sketch.signal_seeds(signal.chunk_events(samples, whole, detect), o).withColumn("rev", F.lit(0))


def limit_of(index: DataFrame, o: Options, max_occ: int | None = None) -> int:
    """The occurrence limit: as given, or the quantile of the index's own counts."""
    if max_occ is not None:
        return max_occ
    found = mapping.mid_occ(index, o.mid_occ_frac, o.mid_occ_min, o.mid_occ_max).first()[0]
    return o.mid_occ_min if found is None else found


def placed(queries: DataFrame, index: DataFrame | scan.TextIndex, lengths: DataFrame, o: Options, max_occ: int | None, reads: DataFrame | None = None, events: DataFrame | None = None, clock: Clock | None = None) -> DataFrame:
    """:func:`accepted` chains on an index: seeds ``(id, rev, pos, hash)``, or
    :func:`text_index`, which is written only if there are too many queries to go to its tasks."""
    if isinstance(index, scan.TextIndex):
        if located := scan.locate(queries, index, max_occ):
            return accepted(located, lengths, o, reads, events, clock)
        index = stash(index.seeds(), "index")
    return accepted(mapping.share(queries, index, limit_of(index, o, max_occ)), lengths, o, reads, events, clock)


def selected(anchors: DataFrame | scan.Located, o: Options, reads: DataFrame | None = None, events: DataFrame | None = None, clock: Clock | None = None) -> DataFrame:
    """The selected chains of all groups of ``anchors``, or of what was located; with ``dtw`` set
    also ``n_aligned``, ``cost`` and ``alignment_score`` over the events of ``reads`` and of the
    targets (see :func:`align.scores`). A ``clock`` gets the time of each query."""
    timed = clock is not None
    found = anchors.chains(o, timed) if isinstance(anchors, scan.Located) else chain.chains(anchors, o, bool(o.dtw), timed)
    found = found if clock is None else clock.split(found, "qid", "score")
    if not o.dtw:
        return chain.primaries(found, o)
    if reads is None or events is None:
        raise ValueError("alignment scores need the events of reads and targets; an index has them if they were saved with it")
    found = stash(chain.ranked(found), "chains")
    rows = stash(chain.primaries(found, o), "selected")
    kept = stash(rows.select("qid", "tid", "rev", "rank", "rs", "re").join(found.select("qid", "rank", "steps"), ["qid", "rank"]), "kept")
    scores = stash(align.scores(kept, reads, events, o), "scores")
    if clock is not None:
        clock.add(scores, "qid")
    return rows.join(scores.drop("us"), ["qid", "rank"])


def accepted(shared: mapping.Shared | scan.Located, lengths: DataFrame, o: Options, reads: DataFrame | None = None, events: DataFrame | None = None, clock: Clock | None = None) -> DataFrame:
    """The accepted chains of queries, with ``nc``, the chains of the query, and places of
    reverse mappings turned to the forward strand; ``lengths`` are ``(tid, t_len)``. With
    ``dtw`` set :func:`selected` gets ``reads`` and ``events``, and rows have ``alignment_score``."""
    located = isinstance(shared, scan.Located)
    rep = mapping.repeat_length(shared.shared() if located else shared, o.span)
    best = chain.decide(selected(shared if located else mapping.match(shared), o, reads, events, clock), rep, o).where("mapped").join(lengths, "tid")
    flip = F.col("rev") == 1
    back = lambda c: F.col("t_len") + 1 - F.col(c)
    return best.select("qid", "tid", "rev", "score", "cnt", "mapq", "qs", "qe", F.when(flip, back("re")).otherwise(F.col("rs")).alias("rs"), F.when(flip, back("rs")).otherwise(F.col("re")).alias("re"), "t_len", F.col("n_chains").alias("nc"), *["alignment_score"] * bool(o.dtw))


def map_reads(reads: DataFrame, read_key: str, targets: DataFrame, target_key: str, o: Options, max_occ: int | None = None, pore: np.ndarray | None = None, timed: bool = False) -> DataFrame:
    """A row for each read (of all-against-all settings, for each of its mappings): its
    mapping, or nulls if it has none. Null and short texts have no seeds and stay unmapped.
    ``timed`` adds ``mt``, the milliseconds spent on the read's seeds, chains and alignments,
    with ``ci`` 1 and ``sl`` its length."""
    clock = Clock() if timed else None
    queries = sketch.seeds(reads, read_key, 0, o, pore, timed)
    queries = queries if clock is None else clock.split(queries, "id", "hash")
    index = text_index(targets, target_key, o, pore)
    lengths = targets.select(F.col(target_key).cast("long").alias("tid"), n_letters("text", o.alphabet).alias("t_len"))
    events = (align.text_reads(reads, read_key, o, pore), align.text_events(targets, target_key, o, pore)) if o.dtw else (None, None)
    best = placed(queries, index, lengths, o, max_occ, *events, clock)
    rows = reads.select(F.col(read_key).cast("long").alias("qid"), n_letters("text", o.alphabet).alias("q_len")).join(best, "qid", "left")
    return rows if clock is None else _with_times(rows, clock).withColumns({"ci": F.lit(1), "sl": F.col("q_len")})


def _with_times(rows: DataFrame, clock: Clock) -> DataFrame:
    """``mt`` of each read; 0 where no pass met it."""
    return rows.join(clock.total(), "qid", "left").fillna(0.0, ["mt"])


def map_stored(reads: DataFrame, read_key: str, stored: mapping.Stored, o: Options, pore: np.ndarray | None = None) -> DataFrame:
    """:func:`map_reads` on a saved index and the settings that it was made with, or others
    that sketch alike; ``dtw`` needs an index with events."""
    mine = align.text_reads(reads, read_key, o, pore) if o.dtw else None
    best = accepted(mapping.share_stored(sketch.seeds(reads, read_key, 0, o, pore), stored), stored.lengths, o, mine, stored.events)
    return reads.select(F.col(read_key).cast("long").alias("qid"), n_letters("text", o.alphabet).alias("q_len")).join(best, "qid", "left")


def map_signals(samples: DataFrame, index: DataFrame | scan.TextIndex, lengths: DataFrame, o: Options, max_occ: int | None = None, detect: bool = True, signal_targets: bool = False, events: DataFrame | None = None, timed: bool = False) -> DataFrame:
    """A row for each read of raw signal ``(read_id, pos, pa)``: chunks to events to seeds to
    chains on an ``index`` (as in :func:`placed`) with ``lengths`` ``(tid, t_len)``. Beside the
    mapping: ``ci`` chunks, ``sl`` samples, ``nc`` chains and the ``events`` counted. Places on
    the read are scaled from events to bases by the samples a base takes, unless the targets
    are signals. With ``dtw`` set chains are scored again over the targets' ``events``
    (:func:`align.text_events` or :func:`align.signal_events`). ``timed`` adds ``mt`` as in
    :func:`map_reads`; segmenting is not in it."""
    clock = Clock() if timed else None
    chunks = stash(signal.chunk_events(samples, o, detect), "chunks")
    index = index if isinstance(index, scan.TextIndex) else stash(index, "index")
    queries = sketch.signal_seeds(chunks, o, timed)
    queries = queries if clock is None else clock.split(queries, "id", "hash")
    best = placed(queries, index, lengths, o, max_occ, align.chunk_reads(chunks), events, clock)
    per = chunks.groupBy(F.col("read_id").cast("long").alias("qid")).agg(F.count("*").cast("int").alias("ci"), F.sum("n_samples").alias("sl"), F.sum(F.when(F.col("used"), F.col("n_events")).otherwise(0)).alias("events"))
    rows = per.join(best, "qid", "left")
    rows = rows if clock is None else _with_times(rows, clock)
    scale = F.lit(1.0) if signal_targets else F.when(F.col("events") > 0, F.col("sl") / F.col("events") / F.lit(o.sample_per_base)).otherwise(0.0)
    at = {c: (scale * F.col(c)).cast("int") for c in ("qs", "qe")}
    return rows.withColumns({"q_len": (scale * F.coalesce("qe", "events") if not signal_targets else F.col("events")).cast("int")}).withColumns(at)


def overlap(reads: DataFrame, key: str, o: Options, max_occ: int | None = None) -> DataFrame:
    """Chains between reads, each pair once, of at least the second score limit."""
    index = stash(sketch.seeds(reads, key, 0, o), "index")
    anchors = mapping.all_pairs(index, limit_of(index, o, max_occ)).withColumn("rev", F.lit(0))
    return chain.chains(anchors, o).where(F.col("score") >= o.min_score2)
