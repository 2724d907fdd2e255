"""Settings of the signal engine and the named presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """All settings; those of sketching first, then chaining, decision and run stopping."""

    k: int = 6
    e: int = 8
    q: int = 4
    w: int = 0
    diff: float = 0.35
    fine_min: float = -2.0
    fine_max: float = 2.0
    fine_range: float = 0.4
    alphabet: str = "letters"
    rev_target: bool = True
    seg_windows: tuple[int, int] = (3, 9)
    seg_thresholds: tuple[float, float] = (4.0, 3.5)
    seg_height: float = 0.4
    mid_occ_frac: float = 0.01
    mid_occ_min: int = 50
    mid_occ_max: int = 500_000
    min_events: int = 50
    bw: int = 500
    bw_long: int = 0
    max_target_gap: int = 2500
    max_query_gap: int = 2500
    max_iterations: int = 200
    max_skips: int = 5
    min_anchors: int = 2
    min_score: int = 15
    min_score2: int = 0
    check_strand: bool = False
    gap_scale: float = 0.8
    skip_scale: float = 0.0
    rmq: bool = False
    rmq_inner: int = 1000
    rmq_cap: int = 100_000
    mask_level: float = 0.5
    mask_len: int = 2**31 - 1
    best_n: int = 0
    pri_ratio: float = 0.3
    min_mapq: int = 2
    max_chunks: int = 10
    chunk_size: int = 4000
    sample_per_base: float = 4000 / 450
    w_bestq: float = 0.35
    w_bestmq: float = 0.05
    w_bestmc: float = 0.6
    w_bestma: float = 0.2
    w_threshold: float = 0.45
    all_chains: bool = False
    adaptive: bool = True
    dtw: str = ""
    dtw_full: bool = False
    dtw_band: float = 0.1
    dtw_match_bonus: float = 0.4
    dtw_min_score: float = 20.0
    su_threshold: float = 1.5
    su_samples: int = 5
    su_every: int = 500
    su_min_reads: int = 500

    @property
    def span(self) -> int:
        return self.k + self.e - 1

    @property
    def gap(self) -> float:
        return self.gap_scale * 0.01 * self.span

    @property
    def skip(self) -> float:
        return self.skip_scale * 0.01 * self.span


_AVA = {"diff": 0.45, "all_chains": True, "adaptive": False, "pri_ratio": 0.0}
# fixed values: what each preset sets beyond the defaults
PRESETS: dict[str, dict] = {
    "viral": {"e": 6, "bw": 100, "max_target_gap": 500, "max_query_gap": 500, "max_chunks": 5, "min_score": 10, "gap_scale": 1.2, "skip_scale": 0.3},
    "sensitive": {},
    "fast": {"fine_range": 0.6, "min_mapq": 5, "min_score": 10, "gap_scale": 0.6},
    "faster": {"e": 11, "w": 3, "fine_range": 0.6, "max_chunks": 5, "min_mapq": 5, "min_score": 10, "gap_scale": 0.6},
    "ava-viral": _AVA | {"e": 6, "w": 0, "min_score": 20, "min_score2": 30, "min_anchors": 5, "min_mapq": 5, "bw": 1000, "gap_scale": 1.2, "skip_scale": 0.3},
    "ava": _AVA | {"w": 3, "min_score": 40, "min_score2": 75, "min_anchors": 5, "min_mapq": 5, "bw": 5000},
    "ava-sensitive": _AVA | {"w": 0, "min_score": 75, "min_score2": 100, "min_anchors": 5, "min_mapq": 5, "bw": 1000},
    "ava-large": _AVA | {"w": 5, "fine_range": 0.6, "gap_scale": 0.6, "min_score": 20, "min_score2": 50, "min_anchors": 2, "min_mapq": 2, "bw": 5000},
    "sequence-until": {},
}
DEPLETION = {"best_n": 5, "min_mapq": 10, "w_threshold": 0.5, "min_anchors": 2, "min_score": 15, "skip_scale": 0.0}
R10 = {"k": 9, "seg_windows": (3, 6), "seg_thresholds": (6.5, 4.0), "seg_height": 0.2, "gap_scale": 1.2}


def parse_count(text: str) -> int:
    """A number with an optional suffix k, M or G: ``10k`` is 10,000."""
    unit = {"k": 10**3, "m": 10**6, "g": 10**9}.get(text[-1:].lower())
    return int(float(text[:-1]) * unit + 0.499) if unit else int(float(text) + 0.499)


def options(preset: str = "sensitive", *, depletion: bool = False, r10: bool = False, **given) -> Options:
    """The preset first, then the flags, then the single settings; unknown names are an error."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset!r}; there are {', '.join(PRESETS)}")
    if unknown := set(given) - {f.name for f in fields(Options)}:
        raise ValueError(f"no settings {sorted(unknown)}")
    return replace(Options(), **PRESETS[preset] | (DEPLETION if depletion else {}) | (R10 if r10 else {}) | given)
