"""All registered queries."""

from colloquy.plans import (  # noqa: F401
    dialogue_queries,
    episode_queries,
    recorded_queries,
    row_queries,
    sampling_queries,
    store_queries,
    stream_queries,
    text_queries,
)
from colloquy.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
