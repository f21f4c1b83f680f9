"""Knobs, passed explicitly. ``Settings()`` holds the code's defaults, ``deployed()`` the values of the running service."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    half_life: float = 0.5
    recency_floor: float = 0.05
    min_scorers: int = 2000
    shortlist: int = 600
    served: int = 60
    relevance_weight: float = 0.5
    relevance_weight_personal: float = 0.0
    novelty_weight: float = 1.0
    gems_novelty_weight: float = 2.2
    novelty_ref_sd: float = 0.30
    diversity_weight: float = 0.07
    genre_calibration: float = 0.7
    age_calibration: float = 0.0
    age_fresh_weight: float = 0.5
    calibration_block: int = 0
    calibration_pool: int = 300
    implicit_weight: float = 0.8
    not_interested_offset: float = -1.0
    not_interested_weight: float = 0.4
    disagreement_penalty: float = 0.5
    unfamiliar_genre_penalty: float = 0.3
    long_series_penalty: float = 0.3
    acclaim_penalty: float = 0.6
    acclaim_evidence: float = 0.1
    popularity_prior: float = 0.5
    safe_bets_risk: float = 1.0
    memory_mix: float = 0.0
    memory_cap: float = 0.15
    order_ranker_weight: float = 0.0
    discover_ranker_weight: float = 0.0
    gems_ranker_weight: float = 0.0
    blend_share_max: float = 0.5
    blend_size_middle: float = 150.0
    ranking_share_middle: float = 80.0
    content_audience: bool = False
    content_staff: bool = False
    level_trend: str = ""


def deployed() -> Settings:
    return replace(
        Settings(), relevance_weight_personal=0.5, memory_mix=0.5, order_ranker_weight=0.5, discover_ranker_weight=0.75, gems_ranker_weight=0.5, age_calibration=1.0, calibration_block=20
    )
