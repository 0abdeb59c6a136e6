"""Predicates as columns; None stands for "no filter"."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import INVERSE, PredicateIndex


def eq(c: Column, value: object) -> Column | None:
    return None if value is None else c == F.lit(value)


def in_(c: Column, values: Iterable[object] | None) -> Column | None:
    values = list(values or [])
    return c.isin(values) if values else None


def same_key(parts: list[Column], value: Iterable[object]) -> Column:
    """A compound key, part by part, so that every part can reach the scan; a null part equals nothing."""
    return reduce(lambda a, b: a & b, [c == F.lit(v) for c, v in zip(parts, value, strict=True)])


def contains_any(c: Column, values: Iterable[object] | None) -> Column | None:
    """Rows whose collection holds one of the values; a null collection holds none."""
    values = list(values or [])
    if not values:
        return None
    return F.array_contains(c, F.lit(values[0])) if len(values) == 1 else F.arrays_overlap(c, F.array(*map(F.lit, values)))


def between(c: Column, gt: object = None, gte: object = None, lt: object = None, lte: object = None) -> Column | None:
    """At most one bound on each side."""
    if (gt is not None and gte is not None) or (lt is not None and lte is not None):
        raise ValueError("one lower and one upper bound at most")
    parts = [c > F.lit(gt) if gt is not None else None, c >= F.lit(gte) if gte is not None else None, c < F.lit(lt) if lt is not None else None, c <= F.lit(lte) if lte is not None else None]
    return all_of(*parts)


def compare(c: Column, op: str, const: object) -> Column:
    """A comparison that is never null: null differs from every constant, and is neither above nor below it."""
    k = F.lit(const)
    if op == "==":
        return c.eqNullSafe(k)
    if op == "!=":
        return ~c.eqNullSafe(k)
    found = {">": c > k, ">=": c >= k, "<": c < k, "<=": c <= k}[op]
    return F.coalesce(found, F.lit(False))


def named(p: PredicateIndex, boolean: bool = False) -> Column:
    c = F.col(p.column)
    if p.kind == "has":
        return F.coalesce(c, F.lit(False)) if boolean else c.isNotNull()
    if p.kind == "has_not":
        return ~F.coalesce(c, F.lit(False)) if boolean else c.isNull()
    return compare(c, p.op if p.kind == "value" else INVERSE[p.op], p.const)


def all_of(*parts: Column | None) -> Column | None:
    real = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, real) if real else None


def any_of(*parts: Column | None) -> Column | None:
    """A branch without a filter is left out of the union; without any, nothing is filtered."""
    real = [p for p in parts if p is not None]
    return reduce(lambda a, b: a | b, real) if real else None
