"""Settings of the retrieval engine; every operator also takes them as arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 512
    chunk_overlap: int = 50
    embedding_dimension: int = 384
    top_k: int = 5
    similarity_threshold: float = 0.3
    semantic_threshold: float = 0.5
    semantic_max_chunk: int = 1024
    semantic_min_chunk: int = 100
    hierarchical_max_chunk: int = 1536
    include_parent_chunks: bool = True
    dense_weight: float = 0.6
    rrf_k: int = 60
    keyword_weight: float = 0.5
    semantic_weight: float = 0.5
    claim_threshold: float = 0.4
    retrieval: str = "dense"
    rerank: bool = False
    verify_answers: bool = False
    collection: str = "legal_docs"

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")
        if self.retrieval not in ("dense", "hybrid"):
            raise ValueError("retrieval must be dense or hybrid")
        if not 0 <= self.dense_weight <= 1:
            raise ValueError("dense_weight must lie in [0, 1]")

    @classmethod
    def from_env(cls, prefix: str = "LEXLOOM_") -> EngineConfig:
        """Defaults, overridden by environment variables such as LEXLOOM_TOP_K."""
        base, found = cls(), {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(getattr(base, f.name))
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return replace(base, **found)


DEFAULTS = EngineConfig()
