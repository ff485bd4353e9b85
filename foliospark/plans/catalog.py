"""All registered queries; importing the modules registers them."""

from foliospark.plans import (  # noqa: F401
    evaluate_queries,
    ingest_queries,
    maintain_queries,
    read_queries,
    search_queries,
    stream_queries,
)
from foliospark.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
