"""Settings that define behaviour, and the clamps for request arguments."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values of the retrieval semantics; change them only together with tests."""

    min_fuzzy_score: float = 0.15
    bigram_weight: float = 0.7
    trigram_weight: float = 0.3
    substring_floor: float = 0.9
    single_char_score: float = 0.8
    rerank_chars: int = 1000
    min_semantic_score: float = 0.5
    vector_dim: int = 512
    ready_coverage: float = 0.9
    fan_out: int = 3
    merged_factor: int = 2
    episode_gap: int = 5
    episodes_per_session: int = 3
    snippet_chars: int = 240
    snippet_fragment: int = 24
    anchor_rounds: int = 3
    anchor_fragments: int = 3
    anchor_summary_chars: int = 400
    anchor_fragment_chars: int = 160
    render_chars: int = 240
    warmup_fast: int = 64
    warmup_gentle: int = 16
    warmup_request: int = 48
    warmup_seconds: int = 30
    warmup_batch: int = 16
    schema_version: int = 3
    semantic: bool = True
    warmup: str = "off"  # or fast, gentle: how many documents a tick or a request embeds
    anchor: bool = True
    allow_unscoped: bool = False
    fold_case: bool = False

    def warmup_budget(self, request: bool = False) -> int:
        """Documents that a tick, or a request, embeds."""
        if self.warmup not in ("fast", "gentle"):
            return 0
        return self.warmup_gentle if self.warmup == "gentle" else self.warmup_request if request else self.warmup_fast


SETTINGS = Settings()


def clamp(value: object, default: int, low: int, high: int) -> int:
    """``value`` as an integer within [low, high]; ``default`` unless it is a finite number."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        value = default
    return int(min(max(value, low), high))


def clamp_limit(value: object) -> int:
    """Groups of a coarse request: 1 to 50, 10 by default."""
    return clamp(value, 10, 1, 50)


def clamp_context(value: object) -> int:
    """Neighbours of a detail request: 0 to 10, 3 by default."""
    return clamp(value, 3, 0, 10)


def clamp_page(value: object, high: int = 50) -> int:
    """Rows of a page: 1 to ``high``, 20 by default."""
    return clamp(value, 20, 1, high)


def clamp_fuzzy(value: object) -> int:
    """Hits of a fuzzy search: 1 to 100, 20 by default."""
    return clamp(value, 20, 1, 100)
