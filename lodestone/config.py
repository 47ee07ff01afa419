"""Settings of the engine, checked where they are made."""

from __future__ import annotations

from dataclasses import dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class IngestConfig:
    max_file_bytes: int = 1_048_576
    max_files: int = 10_000
    max_repository_bytes: int = 50_000_000


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 4000
    overlap_lines: int = 2
    #: Accepted for compatibility; packing whole lines leaves no fragment that it could merge.
    min_chars: int = 200

    def __post_init__(self) -> None:
        _need(self.max_chars >= 1, "max_chars must be at least 1")
        _need(self.overlap_lines >= 0 and self.min_chars >= 0, "overlap_lines and min_chars must not be negative")


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        _need(self.k1 > 0, "k1 must be positive")
        _need(0 <= self.b <= 1, "b must be between 0 and 1")


@dataclass(frozen=True)
class HybridConfig:
    top_k: int = 5
    pool: int = 20
    rrf_k: int = 60
    vector_weight: float = 1.0
    lexical_weight: float = 1.0

    def __post_init__(self) -> None:
        _need(self.top_k >= 1 and self.pool >= 1 and self.rrf_k >= 1, "top_k, pool and rrf_k must be at least 1")
        _need(self.vector_weight >= 0 and self.lexical_weight >= 0, "weights must not be negative")
        _need(self.vector_weight + self.lexical_weight > 0, "one weight must be positive")


@dataclass(frozen=True)
class RerankConfig:
    candidates: int = 20
    final: int = 5
    fail_open: bool = True

    def __post_init__(self) -> None:
        _need(self.candidates >= 1 and self.final >= 1, "candidates and final must be at least 1")


@dataclass(frozen=True)
class ContextConfig:
    max_chars: int = 20_000
    max_chunks: int = 12

    def __post_init__(self) -> None:
        _need(self.max_chars >= 1 and self.max_chunks >= 1, "max_chars and max_chunks must be at least 1")


@dataclass(frozen=True)
class ConversationConfig:
    history: int = 12
    rewrite: int = 6

    def __post_init__(self) -> None:
        _need(self.history >= 1 and self.rewrite >= 1, "history and rewrite must be at least 1")
