"""Imports every module that registers queries."""

from . import (  # noqa: F401
    centroids,
    chat_windows,
    decontamination,
    hilbert_shards,
    language,
    merkle,
    near_dedup,
    packing,
    phrase_dedup,
    ppm,
    suffix_dedup,
    toxicity,
    vector_dedup,
)
from .registry import QUERIES, SQL  # noqa: F401
