"""Driver queries and their independent SQL, grouped by subject."""

from __future__ import annotations

from . import (
    cleaning,
    explaining,
    exploring,
    expressions,
    features,
    joining,
    modelling,
    preparing,
    quality,
    sources,
)
from .registry import oracles, queries

__all__ = [
    "cleaning",
    "explaining",
    "exploring",
    "expressions",
    "features",
    "joining",
    "modelling",
    "oracles",
    "preparing",
    "quality",
    "queries",
    "sources",
]
