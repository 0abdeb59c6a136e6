"""Keyed entity tables on Spark: declared indexes, narrowing, nested joins, changelogs and recency."""

from .operators.query import Query
from .spec import EntitySpec, ForeignKey, Index, LastUpdate, PredicateIndex, Registry, SpecError

__all__ = ["EntitySpec", "ForeignKey", "Index", "LastUpdate", "PredicateIndex", "Query", "Registry", "SpecError"]
