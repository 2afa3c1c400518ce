"""Limits, checked at the readers and before exponential operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_bytes: int = 64 << 20
    max_nodes: int = 1_000_000
    max_edges: int = 10_000_000
    max_triples: int = 10_000_000
    max_xml_bytes: int = 32 << 20
    max_path_nodes: int = 32
    max_simple_paths: int = 10_000
    max_clique_nodes: int = 1_000
    max_cliques: int = 10_000
    max_query_bytes: int = 64 << 10
    max_rows: int = 100_000
    max_seconds: int = 30
    max_kernel_edges: int = 5_000_000
    allowed_root: str | None = None
    default_predicate: str = "urn:weft:relatedTo"


DEFAULTS = Settings()
