"""Defaults of the engine's operators."""

from __future__ import annotations

from dataclasses import dataclass, field

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
TOP_K, RERANK_K, CONFIDENCE = 10, 5, 0.35
NUM_PERM, JACCARD = 128, 0.85
MIN_WORDS, MAX_WORDS, MAX_REPETITION = 50, 100_000, 0.3
MIN_AVG_WORD_LEN, MAX_SYMBOL_RATIO, MAX_SPAM_DENSITY = 3.0, 0.1, 0.02
WEB_RESULTS = 5
POSITIVE_SCORE, NEGATIVE_SCORE, MIN_PAIRS = 4, 2, 50
VECTOR_WEIGHT, LEXICAL_WEIGHT, RRF_K = 0.7, 0.3, 60


@dataclass
class DatasetConfig:
    """Filters and format of a dataset build."""

    languages: tuple[str, ...] = ("en",)
    min_words: int = MIN_WORDS
    max_words: int = MAX_WORDS
    deduplicate: bool = True
    source_types: tuple[str, ...] | None = None
    fmt: str = "jsonl"
    extra: dict = field(default_factory=dict)
