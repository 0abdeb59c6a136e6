"""Structural comparison: sets without order, maps by key, structs by field, some fields ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def canonical(c: Column, kind: DataType, sets: tuple[str, ...] = (), ignore: tuple[str, ...] = (), path: str = "") -> Column:
    """A comparable form of a value. ``sets`` and ``ignore`` are dotted paths of arrays that are sets, and of fields left out."""
    if isinstance(kind, StructType):
        parts = []
        for f in kind:
            inner = f"{path}.{f.name}".lstrip(".")
            if inner not in ignore:
                parts.append(canonical(c[f.name], f.dataType, sets, ignore, inner).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else c.isNotNull()
    if isinstance(kind, MapType):
        pair = lambda e: F.struct(canonical(e["key"], kind.keyType, sets, ignore, path).alias("key"), canonical(e["value"], kind.valueType, sets, ignore, path).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), pair))
    if isinstance(kind, ArrayType):
        items = F.transform(c, lambda x: canonical(x, kind.elementType, sets, ignore, path))
        return F.array_sort(F.array_distinct(items)) if path in sets else items
    return c


def same(a: Column, b: Column, kind: DataType, sets: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> Column:
    return canonical(a, kind, sets, ignore).eqNullSafe(canonical(b, kind, sets, ignore))


def fingerprint(c: Column, kind: DataType, sets: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> Column:
    """A hash that equal values share."""
    return F.xxhash64(canonical(c, kind, sets, ignore))
