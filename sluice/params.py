"""Run parameters, kept together and written beside every model."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from sluice.functions.words import STOP_WORDS

# Fixed value: windows the reference scores at most (2,368 tokens of a text).
REFERENCE_WINDOWS = 12


@dataclass(frozen=True)
class CascadeParams:
    """Values of one run. The first block must equal the values the offline
    evaluation was made with; change one of them and the threshold has to be
    chosen again."""

    top_k: int = 5
    window_tokens: int = 256
    window_overlap: int = 64
    max_windows: int | None = None  # None scores every window of the text
    threshold: float = 0.6
    retries: int = 1
    seed: int = 42
    test_share: float = 0.2

    max_features: int | None = 50_000  # None keeps every term of df >= min_df
    min_df: int = 2
    ngram_max: int = 2
    stop_words: tuple[str, ...] = STOP_WORDS

    # Cosine scores of one text lie close together; the softmax over the
    # candidates needs a scale. 10 is a starting value: choose scale and
    # threshold on a validation split (validation_share, threshold_sweep).
    softmax_scale: float = 10.0
    # Decimals at which two scores count as equal; ties go to the label.
    tie_decimals: int = 6
    max_labels: int = 1_000

    def __post_init__(self) -> None:
        if not 0 <= self.window_overlap < self.window_tokens:
            raise ValueError("window_overlap must be smaller than window_tokens")
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must lie in [0, 1]")
        if self.max_windows is not None and self.max_windows < 1:
            raise ValueError("max_windows must be positive or None")
        if self.top_k < 1 or self.ngram_max not in (1, 2) or (self.max_features or 1) < 1:
            raise ValueError("top_k, max_features or ngram_max out of range")

    @property
    def window_step(self) -> int:
        return self.window_tokens - self.window_overlap

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> CascadeParams:
        values = json.loads(text)
        values["stop_words"] = tuple(values["stop_words"])
        return cls(**values)
