"""Options shared by the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobOptions:
    """Tunable values of the jobs. Invalid values are refused on construction."""

    # defaults
    top_k: int = 5
    chunk_size: int = 500
    chunk_overlap: int = 50
    max_answer_tokens: int = 512
    temperature: float = 0.7
    batch_rows: int = 50_000
    vector_width: int = 384
    sample_size: int = 12_000
    seed: int = 42

    def __post_init__(self) -> None:
        checks = {
            "top_k must lie in 1..20": 1 <= self.top_k <= 20,
            "chunk_size must be 50 or more": self.chunk_size >= 50,
            "chunk_overlap must be below chunk_size": 0 <= self.chunk_overlap < self.chunk_size,
            "max_answer_tokens must be 64 or more": self.max_answer_tokens >= 64,
            "temperature must lie in 0..2": 0.0 <= self.temperature <= 2.0,
            "batch_rows must be positive": self.batch_rows > 0,
            "vector_width must be positive": self.vector_width > 0,
            "sample_size must be positive": self.sample_size > 0,
        }
        broken = [message for message, holds in checks.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken) + f" (got {self})")
