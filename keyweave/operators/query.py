"""A small fluent API over one entity's table; a query is one ordinary logical plan.

Narrowing lanes are ANDed; values on one lane are ORed. A value of None or an empty list given to ``with_`` is no filter.
``use_index`` is the raw form: an empty list is no filter on a many-index, and no row on a unique one or the key; inside
an Or branch it is no row for either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

from ..functions import predicates as p
from ..spec import EntitySpec, ForeignKey, Registry
from . import joins
from .recency import updated_after

#: Joins in one chain, as the data model has it.
MOST_JOINS = 5


@dataclass(frozen=True)
class Narrowing:
    """Filters on an entity, without a way to run: what Or branches and join filters get."""

    df: DataFrame
    spec: EntitySpec
    parts: tuple[Column, ...] = ()
    branch: bool = False

    def _and(self, part: Column | None):
        return self if part is None else replace(self, parts=(*self.parts, part))

    def predicate(self) -> Column | None:
        return p.all_of(*self.parts)

    def _collection(self, column: str) -> bool:
        return column in self.df.columns and isinstance(self.df.schema[column].dataType, ArrayType)

    def _parts_of(self, name: str, column: str) -> list[Column]:
        """The columns of a compound key, or the fields of a struct; none for any other lane."""
        keys = self.spec.keys
        if name == "key" and len(keys) > 1:
            return [F.col(f"`{k}`") for k in keys]
        column = keys[0] if name == "key" and keys else column
        kind = self.df.schema[column].dataType if column in self.df.columns else None
        return [F.col(f"`{column}`.`{f}`") for f in kind.names] if isinstance(kind, StructType) else []

    def with_(self, name: str, values: object = None):
        """Equality or membership on a key or index; on a collection, holding any of the values.

        A value of a compound key (or of a struct) is a tuple, row or dictionary; several are in a list.
        """
        index = self.spec.index(name)
        parts = self._parts_of(name, index.column)
        many = isinstance(values, (list, set, frozenset) if parts else (list, tuple, set, frozenset))
        values = list(values) if many else [] if values is None else [values]
        if not values:
            return self
        if parts:
            rows = [tuple(v.values()) if isinstance(v, dict) else tuple(v) for v in values]
            return self._and(p.any_of(*(p.same_key(parts, v) for v in rows)))
        c = index.value()
        if not index.expr and self._collection(index.column):
            return self._and(p.contains_any(c, values))
        return self._and(p.eq(c, values[0]) if len(values) == 1 else p.in_(c, values))

    def use_index(self, name: str, values: Iterable[object], transform: Callable[[object], object] | None = None):
        index = self.spec.index(name)
        values = [transform(v) if transform else v for v in values]
        if not values:
            return self._and(F.lit(False)) if self.branch or index.kind == "unique" else self
        return self.with_(name, values)

    def with_range(self, name: str, gt: object = None, gte: object = None, lt: object = None, lte: object = None):
        index = self.spec.index(name)
        if index.kind != "range":
            raise ValueError(f"{name} is no range index")
        return self._and(p.between(index.value(), gt, gte, lt, lte))

    def with_predicate(self, name: str):
        """A has, has-not, value or no-value index by its name."""
        found = self.spec.predicate(name)
        return self._and(p.named(found, isinstance(self.df.schema[found.column].dataType, BooleanType)))

    def where(self, condition: Column | Callable[[DataFrame], Column]):
        """Any predicate as a column, ANDed; a callable gets the table and makes one (a Python UDF there is slow)."""
        return self._and(condition if isinstance(condition, Column) else condition(self.df))

    def or_(self, first: Callable, second: Callable, *args: object):
        """Two branches, each a function of a narrowing (and args); a branch without a filter is left out."""
        empty = Narrowing(self.df, self.spec, (), True)
        return self._and(p.any_of(*(b(empty, *args).predicate() for b in (first, second))))


Filter = Callable[..., Narrowing]


@dataclass(frozen=True)
class Query(Narrowing):
    registry: Registry | None = None
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    inner_steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    n_joins: int = 0
    window: tuple[int, int | None] = (0, None)
    order: tuple[Column, ...] = ()

    def __init__(self, df: DataFrame, spec: EntitySpec, registry: Registry | None = None, parts: tuple[Column, ...] = (), branch: bool = False, steps=(), inner_steps=(), n_joins: int = 0, window=(0, None), order=()):
        for name, value in {"df": df, "spec": spec, "registry": registry, "parts": tuple(parts), "branch": branch, "steps": tuple(steps), "inner_steps": tuple(inner_steps), "n_joins": n_joins, "window": window, "order": tuple(order)}.items():
            object.__setattr__(self, name, value)

    # ---- narrowing that needs another table ----

    def with_keys(self, keys: DataFrame, name: str = "key", found: str | None = None) -> Query:
        """Batch lookup by a one-column table of keys, too many for a list; ``found`` gives all keys, and whether each is there."""
        value = self.spec.index(name).value()
        column = keys.columns[0]
        wanted = keys.select(F.col(column).alias("_wanted")).distinct()
        if found:
            here = self._narrowed().select(value.alias("_have"), joins.packed_struct(self.df).alias("row"))
            joined = wanted.join(here, F.col("_wanted") == F.col("_have"), "left")
            return joined.select(F.col("_wanted").alias(column), F.col("_have").isNotNull().alias(found), "row")
        semi = self._narrowed().withColumn("_have", value).join(wanted, F.col("_have") == F.col("_wanted"), "left_semi").drop("_have")
        return replace_query(self, df=semi, parts=())

    def updated_after(self, relation: DataFrame, group: str, after: int, until: int | None = None) -> Query:
        """Rows whose group was last updated in (after, until]."""
        return replace_query(self, df=updated_after(self._narrowed(), relation, group, after, until), parts=())

    # ---- joins ----

    def _right(self, right: str | Query | DataFrame, narrow: Filter | None, args: tuple, slot: Column | None = None, latest: Column | None = None) -> tuple[DataFrame, EntitySpec | None]:
        """The right side; with ``slot``, of rows that share its value only the last writer's, before any filter sees them."""
        if isinstance(right, str):
            right = self.registry.query(right)
        if slot is not None and isinstance(right, Query):
            order = F.struct(latest, right.spec.key_column()) if latest is not None else right.spec.key_column()
            right = replace_query(right, df=joins.last_writers(right.df, slot, order))
        elif slot is not None:
            right = joins.last_writers(right, slot, latest)
        if isinstance(right, Query):
            if narrow:
                flt = narrow(Narrowing(right.df, right.spec), *args).predicate()
                right = right._and(flt)
            return right.to_df(), right.spec
        return (right.where(narrow(right, *args)) if narrow else right), None

    def _joined(self, step: Callable[[DataFrame], DataFrame], inner: bool) -> Query:
        if self.n_joins >= MOST_JOINS:
            raise ValueError(f"{MOST_JOINS} joins at most")
        return replace_query(self, steps=(*self.steps, step), inner_steps=(*self.inner_steps, step) if inner else self.inner_steps, n_joins=self.n_joins + 1)

    def join_one(self, right, left_on: Column | str | None = None, right_on: Column | str | None = None, *, selector: Callable[..., Column] | None = None, selector_args: tuple = (), narrow: Filter | None = None, args: tuple = (), alias: str | None = None, inner: bool = False, latest: Column | None = None, columns: list[str] | None = None) -> Query:
        """1:1 (or N:1) on key to key, a unique column of either side, or any shared value. ``selector`` maps the left value.

        Of right rows that share a value other than their key only the last writer holds it: the greatest by ``latest``,
        then by key (a plain table: by all columns). ``columns`` are what the right side gives.
        """
        spec = self.registry.spec(right) if isinstance(right, str) else right.spec if isinstance(right, Query) else None
        lhs, rhs = self._sides(left_on, right_on, spec)
        by_key = spec is not None and (right_on is None or (isinstance(right_on, str) and spec.keys == (right_on,)))
        df, _ = self._right(right, narrow, args, None if by_key else rhs, latest)
        if selector:
            lhs = selector(lhs, *selector_args)
        name = alias or f"right{self.n_joins + 1}"
        return self._joined(lambda left: joins.join_one(left, df, lhs, rhs, name, inner, columns), inner)

    def inner_join_one(self, *a, **k) -> Query:
        return self.join_one(*a, inner=True, **k)

    def join_many(self, right, right_on: Column | str, left_on: Column | str | None = None, *, selector: Callable[..., Column] | None = None, selector_args: tuple = (), narrow: Filter | None = None, args: tuple = (), nested: Callable[[Query], Query] | None = None, alias: str | None = None, inner: bool = False, columns: list[str] | None = None, aggregates: dict[str, Column] | None = None) -> Query:
        """1:N, or N:M by a shared value; ``nested`` gives the children joins of their own, which run once over all of them.

        ``columns`` are what a child gives; ``aggregates`` give one struct of figures over the children instead of them,
        null without any.
        """
        if nested:
            child = self.registry.query(right) if isinstance(right, str) else right
            right = nested(child)
        df, spec = self._right(right, narrow, args)
        lhs, _ = self._sides(left_on, right_on, spec)
        if selector:
            lhs = selector(lhs, *selector_args)
        rhs = F.col(right_on) if isinstance(right_on, str) else right_on
        name = alias or f"right{self.n_joins + 1}"
        narrowed = bool(self.parts) and not self.steps  # else the joins before would run twice
        return self._joined(lambda left: joins.join_many(left, df, lhs, rhs, name, inner, narrowed, columns, aggregates), inner)

    def inner_join_many(self, *a, **k) -> Query:
        return self.join_many(*a, inner=True, **k)

    def join_many_collection(self, right, collection: str, *, narrow: Filter | None = None, args: tuple = (), alias: str | None = None, inner: bool = False, columns: list[str] | None = None) -> Query:
        df, _ = self._right(right, narrow, args)
        name = alias or f"right{self.n_joins + 1}"
        return self._joined(lambda left: joins.join_collection(left, df, self.spec.key_column(), collection, name, inner, columns), inner)

    def join_many_collection_forward(self, right, collection: str, *, right_on: Column | str | None = None, narrow: Filter | None = None, args: tuple = (), alias: str | None = None, inner: bool = False, columns: list[str] | None = None) -> Query:
        df, spec = self._right(right, narrow, args)
        _, rhs = self._sides(None, right_on, spec)
        name = alias or f"right{self.n_joins + 1}"
        return self._joined(lambda left: joins.join_collection_forward(left, df, list(self.spec.keys), collection, rhs, name, inner, columns), inner)

    def join_with(self, target: str, nested: Callable[[Query], Query] | None = None, *, alias: str | None = None, **options) -> Query:
        """The join that a declared foreign key asks for, of either side; options are those of that join."""
        name = alias or target
        for fk in self.registry.foreign_keys(self.spec.name):
            if fk.target == target:
                return self._forward(fk, nested, alias=name, **options)
        for fk in self.registry.foreign_keys(target):
            if fk.target == self.spec.name:
                return self._reverse(target, fk, nested, alias=name, **options)
        raise KeyError(f"no foreign key between {self.spec.name} and {target}")

    def inner_join_with(self, *a, **k) -> Query:
        return self.join_with(*a, inner=True, **k)

    def _nested(self, target: str, nested) -> Query:
        child = self.registry.query(target)
        return nested(child) if nested else child

    def _forward(self, fk: ForeignKey, nested, **options) -> Query:
        right = self._nested(fk.target, nested)
        if self._collection(fk.column):
            return self.join_many_collection_forward(right, fk.column, **options)
        return self.join_one(right, fk.column, selector=fk.selector, **options)

    def _reverse(self, target: str, fk: ForeignKey, nested, **options) -> Query:
        right = self._nested(target, nested)
        if isinstance(self.registry.df(target).schema[fk.column].dataType, ArrayType):
            return self.join_many_collection(right, fk.column, **options)
        own = fk.selector(F.col(fk.column)) if fk.selector else F.col(fk.column)
        if fk.cardinality == "one_to_one":
            return self.join_one(right, right_on=fk.column if not fk.selector else own, **options)
        return self.join_many(right, own, **options)

    def _sides(self, left_on, right_on, spec: EntitySpec | None) -> tuple[Column, Column]:
        as_column = lambda c, s: s.key_column() if c is None else F.col(c) if isinstance(c, str) else c
        if right_on is None and spec is None:
            raise ValueError("a plain table needs right_on")
        return as_column(left_on, self.spec), as_column(right_on, spec)

    # ---- order, pages, results ----

    def sort(self, by: str | list[Column] | Column) -> Query:
        """By a named sort or columns, at any place in the chain: joins never multiply rows, so the order is kept till the end."""
        columns = self.spec.sort_columns(by) if isinstance(by, str) else [by] if isinstance(by, Column) else by
        return replace_query(self, order=tuple(columns))

    def page(self, skip: int = 0, take: int | None = None) -> Query:
        return replace_query(self, window=(skip, take))

    def _narrowed(self) -> DataFrame:
        found = self.predicate()
        return self.df if found is None else self.df.where(found)

    def _before_page(self) -> DataFrame:
        out = self._narrowed()
        for step in self.steps:
            out = step(out)
        return out

    def to_df(self) -> DataFrame:
        out = self._before_page()
        if self.order:
            out = out.orderBy(*self.order)
        skip, take = self.window
        if skip:
            out = out.offset(skip)
        return out if take is None else out.limit(take)

    def counted(self) -> DataFrame:
        """One row, n: rows before paging. Only inner joins can lower it, so outer ones aren't run."""
        out = self._narrowed()
        for step in self.inner_steps:
            out = step(out)
        return out.agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.counted().first()[0]

    def with_total(self) -> DataFrame:
        """The page with ``total_count``, the rows before paging, as a subquery of the same plan."""
        return self.to_df().withColumn("total_count", self.counted().scalar())

    def map(self, *columns: Column) -> DataFrame:
        return self.to_df().select(*columns)

    def map_or_filter(self, mapped: Column, name: str = "value") -> DataFrame:
        """The mapped values that aren't null."""
        return self.to_df().select(mapped.alias(name)).where(F.col(name).isNotNull())

    def to_dict(self) -> dict:
        """Key to row; for small results."""
        return {(r[self.spec.keys[0]] if len(self.spec.keys) == 1 else tuple(r[k] for k in self.spec.keys)): r for r in self.to_df().collect()}

    def to_json(self) -> DataFrame:
        rows = self.to_df()
        return rows.select(F.to_json(joins.packed_struct(rows)).alias("value"))


def replace_query(q: Query, **changes) -> Query:
    fields = ("df", "spec", "registry", "parts", "branch", "steps", "inner_steps", "n_joins", "window", "order")
    return Query(**({f: getattr(q, f) for f in fields} | changes))


def strict_unique(df: DataFrame, index: Column, sequence: Column) -> DataFrame:
    """Of rows that share a value of a unique index, the last writer holds the slot; the others aren't found by it."""
    rows = df.withColumn("_slot", index).withColumn("_seq", sequence)
    owners = rows.groupBy("_slot").agg(F.max("_seq").alias("_seq"))
    return rows.join(owners, ["_slot", "_seq"], "left_semi").drop("_slot", "_seq")


def index_extreme(df: DataFrame, index: Column, key: Column, least: bool = True) -> DataFrame:
    """(index_value, key) of the least or greatest index value; ties by the least key."""
    rows = df.select(index.alias("index_value"), key.alias("key")).where("index_value IS NOT NULL")
    return rows.orderBy(F.col("index_value").asc() if least else F.col("index_value").desc(), "key").limit(1)


def prefix_page(df: DataFrame, prefix: Column, sort: list[Column], key: Column, skip: int, take: int) -> DataFrame:
    """Seek a prefix of a compound index and take a page by the rest of it."""
    return df.where(prefix).orderBy(*sort, key).offset(skip).limit(take)
