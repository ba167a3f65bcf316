"""All queries of this package."""

from colloquy.llm import (  # noqa: F401
    alignment,
    decontamination,
    extraction,
    neardup,
    pii,
    prefix_trie,
    quality,
    recompression,
    segmentation,
    simhash,
    topk,
    url_rules,
    warc,
)
from colloquy.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
