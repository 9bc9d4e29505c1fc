"""Settings of the news-event operators; every operator takes an explicit ``as_of`` instead of the clock."""

from __future__ import annotations

from dataclasses import dataclass

#: Political groups of outlets.
PROGRESSIVE = ("left", "far_left", "leans_left")
CONSERVATIVE = ("right", "far_right", "leans_right")
CENSUS = ("center", "neutral", "mainstream")
#: Weight of an event's topics in its score.
TOPIC_MULTIPLIERS = {
    "Politics": 1.5, "Economy": 1.4, "World": 1.3, "Crime": 1.2, "Technology": 0.9, "Science": 0.8, "Entertainment": 0.6,
    "Sports": 0.5, "Lifestyle": 0.4, "Nature": 0.4, "Mercado da Bola": 0.1, "Futebol Brasileiro": 0.1,
}


@dataclass(frozen=True)
class Settings:
    """Thresholds and windows that decisions must share to agree."""

    similarity_strict: float = 0.05
    similarity_loose: float = 0.18
    similarity_merger: float = 0.13
    article_cutoff_days: int = 7
    rrf_k: int = 60
    rrf_decay: float = 0.05
    rrf_depth: int = 50
    search_limit: int = 10
    search_days: int = 5
    ambiguous_gap: float = 0.05
    proposals_per_article: int = 3
    rrf_override: float = 0.05
    fast_merge_hours: int = 4
    fast_merge_count: int = 10
    fast_merge_distance: float = 0.12
    centroid_limit: int = 500
    stance_edge: float = 0.35
    collision_strict: float = 0.05
    collision_strict_hours: int = 72
    collision_loose: float = 0.15
    collision_loose_hours: int = 24
    split_min_articles: int = 10
    split_eps_scale: float = 9.0
    split_eps_cap: float = 0.7
    split_hour_penalty: float = 0.15
    split_penalty_cap: float = 0.5
    split_noise: float = 0.25
    summary_debounce_minutes: int = 15
    link_cutoff_hours: int = 100


DEFAULTS = Settings()
