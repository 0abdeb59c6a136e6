"""The query-string language: ``field=value``, comparisons, ranges and lists, joined by ``&``.

Unknown fields and values that can't be read are no filter. Nothing is decoded. ``from``, ``size`` and ``sort`` are reserved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions.predicates import all_of, between
from ..functions.scalars import parse, Unparsable
from ..spec import EntitySpec

#: Operators as written, longest first at each place.
_OPERATOR = re.compile(r"=>|>=|<=|=<|=|>|<")
_MEANING = {"=": "=", ">": ">", ">=": ">=", "=>": ">=", "<": "<", "<=": "<=", "=<": "<="}
_SUFFIX = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
_ORDERED = (IntegerType, LongType, FloatType, DoubleType, DecimalType, TimestampType, TimestampNTZType, DateType)


@dataclass(frozen=True)
class Param:
    field: str
    op: str = "="
    value: str = ""
    upper: str | None = None  # of a range
    bounds: str = "[]"
    items: tuple[str, ...] | None = None


def tokens(text: str) -> list[Param]:
    return [_param(part) for part in text.removeprefix("?").split("&") if part]


def _param(part: str) -> Param:
    found = _OPERATOR.search(part)
    if not found:
        return Param(part)
    name, op, value = part[: found.start()], _MEANING[found[0]], part[found.end() :]
    if found[0] == "=" and (suffix := re.search(r"\.(gte?|lte?)$", name, re.I)):
        return Param(name[: suffix.start()], _SUFFIX[suffix[1].lower()], value)
    if op == "=" and len(value) > 2 and ".." in value:
        left, right = (value[0] if value[0] in "[(" else ""), (value[-1] if value[-1] in "])" else "")
        low, _, high = value[len(left) : len(value) - len(right)].partition("..")
        if low or high:
            return Param(name, "range", low.strip(), high.strip(), (left or "[") + (right or "]"))
    if op == "=" and (value[:1] == "[" and value[-1:] == "]" or "," in value):
        inner = value[1:-1] if value[:1] == "[" and value[-1:] == "]" else value
        return Param(name, "in", value, items=tuple(x.strip() for x in inner.split(",") if x.strip()))
    return Param(name, op, value)


def condition(spec: EntitySpec, df: DataFrame, param: Param) -> Column | None:
    """The filter that a parameter stands for; None where there is none."""
    name = {c.lower(): c for c in df.columns}.get(param.field.lower())
    if name is None:
        return None
    kind = df.schema[name].dataType
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return None
    index = next((i for i in spec.all_indexes() if i.column == name and not i.expr), None)
    names = spec.ordinals.get(name, ())
    equality = index is not None and index.kind != "range" or name in spec.keys
    ranged = index is not None and index.kind == "range"
    c = F.col(name)
    try:
        if param.op == "in":
            if not (equality or isinstance(kind, StringType)) or ranged or names and not equality:
                return None
            return c.isin([parse(x, kind, names) for x in param.items]) if param.items else None
        if param.op == "range":
            if not (ranged or isinstance(kind, _ORDERED)):
                return None
            low, high = parse(param.value, kind), parse(param.upper, kind)
            inner = (param.bounds[0] == "[", param.bounds[1] == "]")
            return between(c, **{"gte" if inner[0] else "gt": low, "lte" if inner[1] else "lt": high})
        value = parse(param.value, kind, names)
    except Unparsable:
        return None
    if isinstance(kind, (StringType, BooleanType)) and not ranged or names:
        return c == F.lit(value)  # whatever the operator
    if not (ranged or equality or isinstance(kind, _ORDERED)):
        return None
    if param.op == "=":
        return c == F.lit(value)
    return between(c, **{{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[param.op]: value})


def run(spec: EntitySpec, df: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """Rows that meet all parameters, sorted if asked (a sort's name, or ``column`` or ``-column``), one page of them.

    ``compat``: sorting is ignored, and a page is cut only where rows lie beyond it, so one that starts past the end is
    everything; else pages are what they say.
    """
    params = tokens(text)
    found = all_of(*(condition(spec, df, p) for p in params if p.field.lower() not in ("from", "size", "sort")))
    out = df if found is None else df.where(found)
    reserved = {p.field.lower(): p.value for p in params if p.op == "="}
    start, size = (int(reserved[k]) if re.fullmatch(r"\d+", reserved.get(k, "")) else default for k, default in (("from", 0), ("size", 100)))
    if not compat and reserved.get("sort"):
        by = reserved["sort"]
        if by in spec.sorts:
            out = out.orderBy(*spec.sort_columns(by), *spec.keys)
        elif by.lstrip("-") in df.columns:
            c = F.col(by.lstrip("-"))
            out = out.orderBy(c.desc_nulls_last() if by[0] == "-" else c.asc_nulls_first(), *spec.keys)
    if compat:
        # one more row than the page tells whether any lie beyond it; rows are counted by no other action
        beyond = out.select(F.lit(1).alias("n")).limit(start + size + 1).agg(F.count("*").alias("n")).scalar()
        page = out.offset(start).limit(size).where(beyond > start + size)
        return page.unionByName(out.where(beyond <= start + size))
    return out.offset(start).limit(size)


def by_key(spec: EntitySpec, df: DataFrame, text: str) -> DataFrame:
    """The row of a key as JSON (value), from the text of the key, the parts of a compound one apart by commas.

    No row where there is none or the text is no key.
    """
    from .query import Query

    parts = text.split(",") if len(spec.keys) > 1 else [text]
    query = Query(df, spec)
    try:
        key = tuple(parse(t, df.schema[k].dataType) for t, k in zip(parts, spec.keys, strict=True))
    except ValueError:
        return query.where(F.lit(False)).to_json()
    return query.with_("key", key if len(key) > 1 else key[0]).to_json()
