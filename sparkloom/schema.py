"""Canonical chunk columns, their defaults, and the settings that define query semantics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The canonical columns of a chunk, their types and the defaults of missing ones.
CHUNK_COLUMNS = {
    "content": ("string", ""), "source": ("string", "unknown"), "page": ("int", None), "type": ("string", "text"), "heading": ("string", ""), "section_path": ("string", ""),
    "image_path": ("string", ""), "parent_id": ("string", ""), "parent_content": ("string", ""), "chunk_index": ("int", None), "total_chunks": ("int", None),
    "bbox": ("array<double>", None), "page_width": ("double", None), "page_height": ("double", None), "source_url": ("string", ""), "score": ("double", 0.0),
}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    child_size: int = 512
    child_overlap: int = 80
    parent_size: int = 1500
    parent_overlap: int = 100
    top_k: int = 20
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    score_threshold: float = 0.0
    diversity: float = 0.70
    min_rerank_score: float = 0.1
    rerank_top_k: int = 5
    context_budget: int = 6000
    max_turns: int = 20
    summary_every: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25

    @property
    def fetch_k(self) -> int:
        return max(3 * self.top_k, 20)


def canonical(df: DataFrame, *more: str) -> DataFrame:
    """The columns named in ``more``, then all canonical ones; a missing column gets its default, an explicit null stays, scores keep four places."""
    out = []
    for name, (kind, default) in CHUNK_COLUMNS.items():
        c = F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)
        out.append((F.round(c, 4) if name == "score" else c).alias(name))
    return df.select(*more, *out)
