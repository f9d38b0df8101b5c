"""Every tunable number of the engine, and the checks that tie them together."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # Defaults, in seconds, shares and counts.
    # sampling and frame quality
    frame_sample_fps: float = 1.0
    max_sampled_frames: int = 20_000
    analysis_width: int = 640
    max_invalid_frame_ratio: float = 0.02
    dark_frame_threshold: float = 0.05
    black_pixel_value: int = 10
    black_pixel_ratio: float = 0.95
    blur_variance: float = 50.0
    low_information_edge_density: float = 0.01
    low_information_contrast: float = 0.04
    # pair differences
    diff_pixel_weight: float = 0.25
    diff_ssim_weight: float = 0.35
    diff_phash_weight: float = 0.20
    diff_edge_weight: float = 0.20
    phash_size: int = 8
    edge_low: int = 100
    edge_high: int = 200
    max_invalid_comparison_ratio: float = 0.02
    # change events
    major_min_score: float = 0.30
    very_major_min_score: float = 0.60
    major_robust_multiplier: float = 6.0
    major_merge_window: float = 2.0
    # timeline
    stable_min_score: float = 0.03
    stable_max_score: float = 0.10
    stable_robust_multiplier: float = 1.5
    exit_stable_factor: float = 1.6
    min_stable_duration: float = 2.0
    min_changing_duration: float = 1.0
    max_stable_gap: float = 0.5
    long_gap_factor: float = 2.5
    # stability windows
    window_min_duration: float = 2.0
    window_max_invalid_ratio: float = 0.10
    window_max_black_ratio: float = 0.20
    window_duration_saturation: float = 10.0
    stability_difference_weight: float = 0.55
    stability_variance_weight: float = 0.15
    stability_spike_weight: float = 0.15
    stability_duration_weight: float = 0.15
    # boundaries
    boundary_context: float = 4.0
    boundary_min_drop: float = 0.10
    boundary_min_score: float = 0.25
    boundary_duration_saturation: float = 10.0
    boundary_drop_weight: float = 0.40
    boundary_stability_weight: float = 0.25
    boundary_quality_weight: float = 0.20
    boundary_duration_weight: float = 0.10
    boundary_type_weight: float = 0.05
    # candidate positions
    settle_delay: float = 1.0
    exit_margin: float = 0.75
    min_spacing: float = 1.0
    max_per_window: int = 5
    search_radius: float = 1.5
    allow_window_only: bool = True
    max_total_candidates: int = 1000
    short_window: float = 3.0
    medium_window: float = 6.0
    long_window: float = 15.0
    # candidate scores
    sharpness_saturation: float = 200.0
    local_context: float = 1.5
    safe_margin: float = 1.0
    completeness_weights: tuple[float, ...] = (0.20, 0.18, 0.14, 0.14, 0.10, 0.08, 0.08, 0.08)
    # ranking
    rank_weights: tuple[float, ...] = (0.22, 0.28, 0.18, 0.14, 0.08, 0.06, 0.04)
    top_per_window: int = 2
    min_primary_score: float = 0.0
    min_alternate_score: float = 0.25
    ambiguous_gap: float = 0.05
    tie_epsilon: float = 1e-6
    # audio and transcript
    silence_rms: float = 0.003
    silent_ratio: float = 0.98
    high_clipping_ratio: float = 0.02
    audio_min_duration: float = 0.5
    audio_tolerance: float = 3.0
    audio_tolerance_ratio: float = 0.01
    chunk_seconds: float = 600.0
    chunk_overlap: float = 3.0
    transcript_tolerance: float = 4.0
    duplicate_similarity: float = 0.85
    merge_max_gap: float = 0.75
    max_segment_duration: float = 20.0
    max_segment_characters: int = 400
    alignment_epsilon: float = 0.05
    proximity_saturation: float = 10.0
    context_before: float = 12.0
    context_after: float = 8.0
    context_extension: float = 3.0
    context_max_characters: int = 4000
    context_max_words: int = 500
    context_sparse_words: int = 8
    # temporal neighbours and decisions
    neighbour_before: float = 12.0
    neighbour_after: float = 12.0
    neighbour_min_gap: float = 1.5
    neighbour_preferred_gap: float = 3.0
    neighbour_duplicate_difference: float = 0.015
    decision_weights: tuple[float, ...] = (0.28, 0.24, 0.16, 0.12, 0.08, 0.12)
    min_decision_score: float = 0.55
    min_confidence: float = 0.35
    alternate_switch_margin: float = 0.05
    primary_tie_bonus: float = 0.01
    decision_ambiguity_gap: float = 0.04
    transition_reject: float = 0.70
    # screenshots
    quality_weights: tuple[float, ...] = (0.30, 0.20, 0.20, 0.20, 0.10)
    screenshot_sharpness_reference: float = 250.0
    screenshot_contrast_reference: float = 0.22
    screenshot_good_score: float = 0.68
    screenshot_good_sharpness: float = 0.18
    screenshot_min_score: float = 0.50
    search_step: float = 0.5
    search_max_attempts: int = 5
    search_min_gain: float = 0.03
    duplicate_window: float = 120.0
    duplicate_full_cutoff: int = 150
    duplicate_slices: int = 4
    duplicate_bucket_cap: int = 30
    duplicate_weights: tuple[float, ...] = (0.35, 0.25, 0.20, 0.10, 0.05, 0.05)
    duplicate_score: float = 0.88
    possible_duplicate_score: float = 0.78
    duplicate_min_structure: float = 0.86
    duplicate_min_edge: float = 0.72
    duplicate_max_addition: float = 0.22
    duplicate_long_range_phash: float = 0.12
    final_weights: tuple[float, ...] = (0.35, 0.30, 0.15, 0.08, 0.07, 0.05)
    final_exact_bonus: float = 0.01
    final_epsilon: float = 1e-6
    final_semantic_deficit: float = 0.15
    # document
    square_tolerance: float = 0.05
    margin_mm: float = 12.0
    header_enabled: bool = False
    header_mm: float = 8.0
    footer_enabled: bool = True
    footer_mm: float = 8.0
    caption_enabled: bool = True
    caption_mm: float = 10.0
    caption_max_characters: int = 300
    caption_max_words: int = 50
    caption_max_lines: int = 2
    filename_max_length: int = 120
    layout_epsilon: float = 0.01

    def __post_init__(self) -> None:
        problems = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, int | float) and not isinstance(v, bool) and v < 0:
                problems.append(f"{f.name} is negative")
            if f.name.endswith("_weights") and (any(w < 0 for w in v) or sum(v) <= 0):
                problems.append(f"{f.name} do not add up to more than 0")
        if self.very_major_min_score < self.major_min_score:
            problems.append("very_major_min_score is below major_min_score")
        if self.stable_max_score < self.stable_min_score:
            problems.append("stable_max_score is below stable_min_score")
        if self.possible_duplicate_score > self.duplicate_score:
            problems.append("possible_duplicate_score is above duplicate_score")
        if self.chunk_overlap * 2 >= self.chunk_seconds:
            problems.append("chunk_overlap takes up the chunk")
        if problems:
            raise ValueError("; ".join(problems))

    def scaled(self, factor: float, **change) -> Params:
        """The same rules on a clock ``factor`` times slower; for data whose events are hours and not seconds apart."""
        names = (
            "major_merge_window min_stable_duration min_changing_duration max_stable_gap window_min_duration window_duration_saturation boundary_context "
            "boundary_duration_saturation settle_delay exit_margin min_spacing search_radius short_window medium_window long_window local_context safe_margin "
            "neighbour_before neighbour_after neighbour_min_gap neighbour_preferred_gap duplicate_window"
        ).split()
        return replace(self, **({n: getattr(self, n) * factor for n in names} | change))


DEFAULT = Params()
