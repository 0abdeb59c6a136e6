"""Declarations of entities: key, indexes, foreign keys, named predicates and sorts, recency.

An index is a logical lane for filters, not a structure: Catalyst pushes the predicates to the scan. Declarations are
checked against a schema at once, with an error code for each rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

KINDS = ("many", "unique", "range")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one")
COMPARE = ("==", "!=", ">", ">=", "<", "<=")
#: The textual inverse of an operator, which a "no value" index uses; for nulls it isn't the complement.
INVERSE = {"==": "!=", "!=": "==", ">": "<=", ">=": "<", "<": ">=", "<=": ">"}


class SpecError(ValueError):
    """A declaration that can't hold; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Index:
    """A secondary index. ``expr`` may compute its value instead of reading ``column``."""

    column: str
    kind: str = "many"
    name: str | None = None
    symmetric: bool = False
    capacity: int | None = None
    expr: Callable[[], Column] | None = None

    @property
    def label(self) -> str:
        return self.name or self.column

    def value(self) -> Column:
        return self.expr() if self.expr else F.col(self.column)


@dataclass(frozen=True)
class PredicateIndex:
    """A named key set: has, has_not, value (op, const) or no_value (the inverse op)."""

    column: str
    kind: str = "has"
    op: str | None = None
    const: object = None
    name: str | None = None

    @property
    def label(self) -> str:
        if self.name:
            return self.name
        if self.kind in ("has", "has_not"):
            return ("with_" if self.kind == "has" else "without_") + self.column
        op = self.op if self.kind == "value" else INVERSE[self.op]
        return f"with_{self.column}{op}{self.const}"


@dataclass(frozen=True)
class ForeignKey:
    """``column`` refers to ``target``. Dual form: declared on the target's side with ``right_property`` naming the other.

    ``selector`` maps the column to the target's key, for keys that hold more than the reference.
    """

    target: str
    column: str
    cardinality: str = "one_to_many"
    right_property: str | None = None
    selector: Callable[[Column], Column] | None = None
    capacity: int | None = None

    @property
    def index_kind(self) -> str:
        return "unique" if self.cardinality == "one_to_one" else "many"


@dataclass(frozen=True)
class LastUpdate:
    """A recency relation by ``group``: the message's time, or ``ts``; only rows that meet ``where``."""

    name: str
    group: str
    ts: str | None = None
    where: Callable[[str], Column] | None = None


@dataclass(frozen=True)
class EntitySpec:
    name: str
    key: str | tuple[str, ...] | None = None
    key_expr: Callable[[], Column] | None = None
    indexes: tuple[Index, ...] = ()
    predicates: tuple[PredicateIndex, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    sorts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    last_update: tuple[LastUpdate, ...] = ()
    ignore_equality: tuple[str, ...] = ()
    headers: dict[str, str] = field(default_factory=dict)  # column -> header name
    timestamp_columns: tuple[str, ...] = ()
    topic: str | None = None
    ordinals: dict[str, tuple[str, ...]] = field(default_factory=dict)  # enum column -> names in order

    # ---- lookups ----

    @property
    def keys(self) -> tuple[str, ...]:
        return () if self.key is None else (self.key,) if isinstance(self.key, str) else self.key

    def key_column(self) -> Column:
        if self.key_expr:
            return self.key_expr()
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)

    def all_indexes(self) -> tuple[Index, ...]:
        """Declared ones and those that foreign keys imply; only a many-to-one key is symmetric."""
        declared = {i.column: i for i in self.indexes}
        implied = []
        for fk in self.foreign_keys:
            if fk.right_property:
                continue
            own = declared.get(fk.column)
            if own is None and fk.column not in self.keys:
                implied.append(Index(fk.column, fk.index_kind, symmetric=fk.cardinality == "many_to_one", capacity=fk.capacity))
            elif own is not None and fk.cardinality == "many_to_one" and not own.symmetric:
                declared[fk.column] = replace(own, symmetric=True)
        return (*(declared[i.column] if i is not declared[i.column] and i.column in {f.column for f in self.foreign_keys} else i for i in self.indexes), *implied)

    def index(self, label: str) -> Index:
        for i in self.all_indexes():
            if i.label == label:
                return i
        if label in self.keys and len(self.keys) > 1:
            return Index(label)  # a part of the key
        if label in self.keys or label == "key":
            return Index(label, "unique", expr=self.key_column)
        raise KeyError(f"{self.name} has no index {label}")

    def predicate(self, label: str) -> PredicateIndex:
        for p in self.predicates:
            if p.label == label:
                return p
        raise KeyError(f"{self.name} has no predicate index {label}")

    def sort_columns(self, name: str) -> list[Column]:
        """A named sort, "column:1" or "column:-1" each; nulls come first ascending."""
        out = []
        for part in self.sorts[name]:
            column, _, direction = part.partition(":")
            by = F.col(column)
            if column in self.ordinals:
                by = F.array_position(F.lit(list(self.ordinals[column])), by)
            out.append(by.desc_nulls_last() if direction.strip().startswith("-") else by.asc_nulls_first())
        return out

    # ---- validation ----

    def validate(self, schema: StructType, registry: Registry | None = None) -> EntitySpec:
        """Raise SpecError for the first rule broken; else the spec itself."""
        names = set(schema.names)
        if not self.keys and not self.key_expr:
            raise SpecError("NO_KEY", f"{self.name} has no key")
        if self.keys and self.key_expr:
            raise SpecError("DUPLICATE_KEY", f"{self.name} has a key column and a key expression")
        if len(set(self.keys)) != len(self.keys):
            raise SpecError("DUPLICATE_KEY", f"{self.name} names a key column twice")
        self._known(self.keys, names, "UNKNOWN_KEY")
        labels = [i.label for i in self.indexes]
        if len(set(labels)) != len(labels):
            raise SpecError("DUPLICATE_INDEX", f"{self.name} has two indexes of one name")
        for i in self.indexes:
            if i.kind not in KINDS:
                raise SpecError("INDEX_KIND", f"{i.label}: {i.kind}")
            if not i.expr:
                self._known([i.column], names, "UNKNOWN_INDEX")
            if i.capacity is not None and i.kind != "many":
                raise SpecError("CAPACITY_NOT_MANY", f"{i.label}: capacity hints are for many-indexes")
            if not i.expr and i.kind == "range" and isinstance(schema[i.column].dataType, (ArrayType, MapType, BooleanType)):
                raise SpecError("RANGE_TYPE", f"{i.label} can't be ordered")
        for p in self.predicates:
            self._known([p.column], names, "UNKNOWN_PREDICATE")
            kind = schema[p.column]
            if p.kind in ("has", "has_not") and not kind.nullable and not isinstance(kind.dataType, BooleanType):
                raise SpecError("HAS_VALUE_NOT_NULLABLE", f"{p.label}: the column is never null")
            if p.kind in ("value", "no_value") and p.op not in COMPARE:
                raise SpecError("COMPARE_OP", f"{p.label}: {p.op}")
        for sort, parts in self.sorts.items():
            columns = [x.partition(":")[0] for x in parts]
            self._known(columns, names, "UNKNOWN_SORT")
            if not parts or len(set(columns)) != len(columns):
                raise SpecError("DUPLICATE_SORT", f"{sort} repeats a column or has none")
            if any(x.partition(":")[2].strip() not in ("1", "+1", "-1") for x in parts):
                raise SpecError("SORT_DIRECTION", f"{sort}: 1 or -1")
        for u in self.last_update:
            self._known([u.group, *([u.ts] if u.ts else [])], names, "UNKNOWN_LAST_UPDATE")
            if u.ts and not isinstance(schema[u.ts].dataType, (NumericType, TimestampType, TimestampNTZType)):
                raise SpecError("LAST_UPDATE_TYPE", f"{u.ts} is no time")
        self._known([*self.ignore_equality, *self.headers, *self.timestamp_columns], names, "UNKNOWN_COLUMN")
        for fk in self.foreign_keys:
            self._foreign_key(fk, schema, registry)
        return self

    def _known(self, columns, names: set[str], code: str) -> None:
        for c in columns:
            if c not in names:
                raise SpecError(code, f"{self.name} has no column {c}")

    def _foreign_key(self, fk: ForeignKey, schema: StructType, registry: Registry | None) -> None:
        if fk.cardinality not in CARDINALITIES:
            raise SpecError("CARDINALITY", f"{fk.target}: {fk.cardinality}")
        self._known([fk.column], set(schema.names), "UNKNOWN_FOREIGN_KEY")
        collection = isinstance(schema[fk.column].dataType, ArrayType)
        if collection and fk.cardinality != "many_to_one":
            raise SpecError("COLLECTION_CARDINALITY", f"{fk.column}: a collection refers many to one")
        if collection and fk.selector:
            raise SpecError("COLLECTION_SELECTOR", f"{fk.column}: a collection takes no selector")
        own = next((i for i in self.indexes if i.column == fk.column), None)
        if own is not None and fk.cardinality == "many_to_one" and own.kind != "many":
            raise SpecError("MANY_TO_ONE_INDEX", f"{fk.column}: a many-to-one key needs a many-index, not {own.kind}")
        if fk.selector and fk.cardinality == "one_to_many":
            raise SpecError("SELECTOR_CARDINALITY", f"{fk.column}: selectors are for one-to-one and many-to-one")
        if registry is None:
            return
        if fk.target not in registry:
            raise SpecError("UNKNOWN_TARGET", f"{fk.target} is no entity")
        target, df = registry.spec(fk.target), registry.df(fk.target)
        if fk.right_property and fk.right_property not in df.columns:
            raise SpecError("RIGHT_PROPERTY_MISSING", f"{fk.target} has no column {fk.right_property}")
        if fk.selector or (not fk.right_property and len(target.keys) != 1):
            return
        here: DataType = schema[fk.column].dataType
        here = here.elementType if collection else here
        there = df.schema[fk.right_property or target.keys[0]].dataType
        there = there.elementType if isinstance(there, ArrayType) else there
        whole = all(isinstance(t, NumericType) for t in (here, there))
        if here != there and not whole:
            raise SpecError("RIGHT_PROPERTY_TYPE" if fk.right_property else "FOREIGN_KEY_TYPE", f"{fk.column} is {here.simpleString()}, its target {there.simpleString()}")

    # ---- introspection ----

    def queryable_fields(self, df: DataFrame) -> DataFrame:
        """(field, type, indexed, ops) of what a query string can name; collections and maps can't be."""
        by = {i.column: i for i in self.all_indexes() if not i.expr}
        rows = []
        for f in df.schema:
            if isinstance(f.dataType, (ArrayType, MapType, StructType)):
                continue
            indexed = by.get(f.name)
            ordered = isinstance(f.dataType, (NumericType, TimestampType, TimestampNTZType))
            if indexed is not None and indexed.kind == "range":
                ops = "=,>,>=,<,<=,range"
            elif indexed is not None or f.name in self.keys:
                ops = "=,in" + (",>,>=,<,<=,range" if ordered else "")
            elif ordered:
                ops = "=,>,>=,<,<=,range"
            else:
                ops = "=,in" if isinstance(f.dataType, StringType) and f.name not in self.ordinals else "="
            rows.append((f.name, f.dataType.simpleString(), indexed is not None or f.name in self.keys, ops))
        return df.sparkSession.createDataFrame(rows, "field string, type string, indexed boolean, ops string")


class Registry:
    """Entities by name with their tables; dual-form keys become direct ones on the other side."""

    def __init__(self) -> None:
        self._specs: dict[str, EntitySpec] = {}
        self._dfs: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._specs

    def add(self, spec: EntitySpec, df: DataFrame, view: bool = False) -> Registry:
        if spec.name in self._specs:
            raise SpecError("DUPLICATE_ENTITY", spec.name)
        self._specs[spec.name], self._dfs[spec.name] = spec, df
        if view:
            df.createOrReplaceTempView(spec.name)
        return self

    def validated(self) -> Registry:
        for name, spec in self._specs.items():
            spec.validate(self.df(name).schema, self)
        return self

    def spec(self, name: str) -> EntitySpec:
        return self._specs[name]

    def df(self, name: str) -> DataFrame:
        return self._dfs[name]

    def names(self) -> list[str]:
        return list(self._specs)

    def foreign_keys(self, name: str) -> list[ForeignKey]:
        """Direct keys of an entity, with dual-form ones of others turned around."""
        own = [fk for fk in self._specs[name].foreign_keys if not fk.right_property]
        turned = {"one_to_one": "one_to_one", "one_to_many": "many_to_one", "many_to_one": "one_to_many"}
        for other, spec in self._specs.items():
            own += [ForeignKey(other, fk.right_property, turned[fk.cardinality]) for fk in spec.foreign_keys if fk.right_property and fk.target == name]
        return own

    def visit(self, mapper: Callable[[EntitySpec, DataFrame], object]) -> list[object]:
        return [mapper(self._specs[n], self.df(n)) for n in self._specs]

    def query(self, name: str):
        from .operators.query import Query

        return Query(self.df(name), self._specs[name], self)


def projected(df: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The columns of another entity that a new one takes over."""
    return df.select(*only) if only is not None else df.drop(*(exclude or []))


def session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
