"""Defaults of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults that results depend on.
    parent_tokens: int = 600
    child_tokens: int = 150
    overlap_tokens: int = 30
    top_k: int = 5
    candidate_n: int = 20
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    similarity: float = 0.92
    grounded: float = 0.6
    dimension: int = 64
    web_chars: int = 4000


DEFAULTS = Config()
