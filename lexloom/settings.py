"""Settings, each overridable by an environment variable with the prefix ``LEXLOOM_``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """The defaults are fixed values: results depend on them."""

    max_chunk_chars: int = 1600
    chunk_overlap_chars: int = 200
    min_block_chars: int = 15
    top_k: int = 6
    per_kind: int = 3
    semantic_weight: float = 0.6
    keyword_weight: float = 0.3
    structure_weight: float = 0.1
    reference_bonus: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    max_context_chars: int = 7000
    comparison_context_chars: int = 3000
    expand_top_n: int = 2
    min_answerable: float = 0.35
    direct_answer: float = 0.55
    min_overlap: float = 0.34
    max_spans: int = 3
    embed_batch: int = 16
    embed_width: int = 128
    max_file_mb: int = 10
    max_documents: int = 20
    history_limit: int = 50
    max_question_chars: int = 2000
    lease_seconds: float = 3600.0
    chat_model: str = "scripted"
    embedding_model: str = "hash"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "LEXLOOM_") -> Settings:
        env = dict(os.environ) if env is None else env
        found = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in found.items()})


DEFAULT = Settings()
EXTENSIONS = (".txt", ".md", ".pdf", ".docx")
