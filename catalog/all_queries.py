"""Imports every catalog module, which registers its queries."""

from catalog import (  # noqa: F401
    correlation,
    enrichment,
    evidence,
    folds,
    inference,
    metrics,
    models,
    preparation,
    quality,
    ranking,
    scores,
    sources,
    stability,
    studies,
)
