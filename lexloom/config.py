"""Settings with their defaults, from the environment where it names them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _env(name: str, default):
    return field(default_factory=lambda: type(default)(os.environ.get(name, default)))


@dataclass(frozen=True)
class Config:
    store_path: str = _env("STORE_PATH", "")
    top_k: int = _env("TOP_K", 8)
    score_threshold: float = _env("SCORE_THRESHOLD", 0.3)
    temperature: float = _env("TEMPERATURE", 0.0)
    max_tokens: int = _env("MAX_TOKENS", 2048)
    max_chunk_tokens: int = _env("MAX_CHUNK_TOKENS", 1000)
    vector_size: int = _env("VECTOR_SIZE", 64)

    def errors(self) -> list[str]:
        """What is wrong with the settings; empty when they can be used."""
        out = [] if self.store_path else ["store_path is not set"]
        out += [f"{f.name} must be positive" for f in fields(self) if f.name in ("top_k", "max_tokens", "max_chunk_tokens", "vector_size") and getattr(self, f.name) <= 0]
        return out + ([] if 0 <= self.score_threshold <= 1 else ["score_threshold must be between 0 and 1"])
