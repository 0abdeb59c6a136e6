"""Changelogs: envelopes (topic, partition, offset, ts_ms, key, value, headers) folded to rows and change feeds.

A null value is a tombstone. Arrival order (offset) decides, never event time. A value equal to what is held, but for
ignored fields, changes nothing: not the row, nor its time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions.equality import canonical
from ..functions.scalars import from_millis, header, header_bytes, header_value
from ..spec import EntitySpec

PRODUCER_HEADER = "X-Producer-Id"


# ---- filters on the way in ----


@dataclass(frozen=True)
class HeaderFilter:
    """exists, not_exists, equals or not_equals (one value or several), or a predicate on the header's value.

    An absent header passes equals and not_equals; several exists filters are met by any one of their headers.
    """

    name: str
    kind: str
    values: tuple = ()
    type: str = "string"
    predicate: Callable[[Column], Column] | None = None
    pass_on_null: bool = True

    def condition(self, headers: Column) -> Column:
        value = header_value(headers, self.name, self.type)
        absent = header(headers, self.name).isNull()
        if self.kind == "not_exists":
            return absent
        if self.kind == "equals":
            return absent | F.coalesce(value.isin(list(self.values)), F.lit(False))
        if self.kind == "not_equals":
            return absent | ~F.coalesce(value.isin(list(self.values)), F.lit(False))
        if self.kind == "predicate":
            return F.when(absent, F.lit(self.pass_on_null)).otherwise(F.coalesce(self.predicate(value), F.lit(False)))
        raise ValueError(self.kind)


@dataclass(frozen=True)
class RowFilter:
    """A predicate on key or value; rejected rows are skipped, or count as deletes."""

    condition: Column
    treat_as_delete: bool = False


def decided(rows: DataFrame, header_filters: tuple[HeaderFilter, ...] = (), key_filters: tuple[RowFilter, ...] = (), value_filters: tuple[RowFilter, ...] = (), producer_id: str | None = None) -> DataFrame:
    """The envelopes with ``decision`` keep, skip or delete: headers first, then key, then value; the first reject wins.

    A predicate that is null (or fails in try_ functions) skips. Value filters don't see tombstones.
    """
    headers = F.col("headers")
    exists = [f for f in header_filters if f.kind == "exists"]
    checks: list[tuple[Column, str]] = []
    if producer_id is not None:
        checks.append((~F.coalesce(F.decode(header(headers, PRODUCER_HEADER), "UTF-8") == producer_id, F.lit(False)), "skip"))
    if exists:
        any_there = F.lit(False)
        for f in exists:
            any_there = any_there | header(headers, f.name).isNotNull()
        checks.append((any_there, "skip"))
    checks += [(f.condition(headers), "skip") for f in header_filters if f.kind != "exists"]
    checks += [(f.condition, "delete" if f.treat_as_delete else "skip") for f in key_filters]
    checks += [(F.col("value").isNull() | f.condition, "delete" if f.treat_as_delete else "skip") for f in value_filters]
    decision = F.when(F.col("value").isNull(), "delete").otherwise("keep")
    for ok, otherwise in reversed(checks):
        decision = F.when(ok.isNull(), "skip").when(~ok, otherwise).otherwise(decision)
    return rows.withColumn("decision", decision)


def header_kind(value: StructType, column: str, kinds: dict[str, str] | None = None) -> str:
    """How a header column is written: int, long, bytes or string by its type, or as ``kinds`` says (uuid)."""
    by_type = {"int": "int", "bigint": "long", "binary": "bytes"}
    return (kinds or {}).get(column) or by_type.get(value[column].dataType.simpleString(), "string")


def enriched(rows: DataFrame, spec: EntitySpec, kinds: dict[str, str] | None = None) -> DataFrame:
    """Header and timestamp columns of the value set from the envelope; after the filters, which see the value as sent."""
    value = F.col("value")
    for column, name in spec.headers.items():
        kind = header_kind(rows.schema["value"].dataType, column, kinds)
        value = F.when(value.isNull(), value).otherwise(value.withField(column, F.coalesce(header_value(F.col("headers"), name, kind), value[column])))
    for column in spec.timestamp_columns:
        kind = rows.schema["value"].dataType[column].dataType
        stamp = F.col("ts_ms") if kind.simpleString() == "bigint" else from_millis(F.col("ts_ms")).cast(kind)
        value = F.when(value.isNull(), value).otherwise(value.withField(column, stamp))
    return rows.withColumn("value", value)


def applied(rows: DataFrame) -> DataFrame:
    """Decisions carried out: skipped rows go, deletes become tombstones."""
    return rows.where("decision <> 'skip'").withColumn("value", F.when(F.col("decision") == "keep", F.col("value")))


#: A decoder gets envelopes, the schema of values and the column that holds them raw, and gives them with ``value``
#: read, null for a tombstone, and ``quarantine``, the raw text (or hexadecimal bytes) of what it couldn't read.
Decoder = Callable[[DataFrame, StructType, str], DataFrame]


def parsed(rows: DataFrame, schema: StructType, column: str = "value", decoder: Decoder | None = None) -> DataFrame:
    """Raw values to ``value``, by default as JSON text; what can't be read is in ``quarantine`` and is no tombstone."""
    return (decoder or json_decoder)(rows, schema, column)


def json_decoder(rows: DataFrame, schema: StructType, column: str) -> DataFrame:
    text = F.col(column).cast("string")
    read = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    bad = text.isNotNull() & (F.try_parse_json(text).isNull() | ~F.startswith(F.ltrim(text), F.lit("{")) | read.isNull())
    return rows.withColumn("quarantine", F.when(bad, text)).withColumn("value", F.when(~bad, read))


# ---- folds ----


def _comparable(kind: StructType, c: Column, spec: EntitySpec, sets: tuple[str, ...]) -> Column:
    return canonical(c, kind, sets, spec.ignore_equality)


#: Arrivals of one stretch of a changelog: the most rows of a key that one task orders at a time.
STRETCH = 1 << 20


def transitions(rows: DataFrame, spec: EntitySpec, sets: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """Every envelope with what it did: ``update_type`` Add, Update, Same, Delete or Filtered, ``new`` and ``old`` values.

    Filtered: a tombstone of a key that isn't there; ``seq`` is the arrival order. The history of a key is cut into
    stretches of arrivals, each ordered in a task of its own; what a key holds at the end of a stretch, a row for each,
    is carried to the next ones. So a key with most of the rows is as many tasks as it has stretches.
    """
    kind = rows.schema["value"].dataType
    parts = ["key", "_stretch"]
    within = Window.partitionBy(*parts).orderBy("seq")
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    staged = rows.withColumn("seq", F.col("offset")) if "seq" not in rows.columns else rows
    form = F.struct(F.col("value").isNotNull().alias("there"), _comparable(kind, F.col("value"), spec, sets).alias("form"))
    staged = staged.select("key", "value", "seq", "ts_ms", form.alias("_form"), F.expr(f"seq div {stretch}").alias("_stretch"))
    staged = staged.withColumn("_before", F.lag("_form").over(within))
    # within a stretch: the first arrival, and those unlike the one before them; null for the others
    staged = staged.withColumn("_turn", F.when(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("_form")), F.struct("value")))
    ends = staged.groupBy(*parts).agg(
        F.min_by(F.struct(F.col("_form").alias("form"), "value"), "seq").alias("first"),
        F.max_by("_form", "seq").alias("last_form"),
        F.max_by("_turn", F.when(F.col("_turn").isNotNull(), F.col("seq"))).alias("last_turn"),
    )
    over = Window.partitionBy("key").orderBy("_stretch")
    ends = ends.withColumn("form_in", F.lag("last_form").over(over))
    turned = F.when(F.col("form_in").isNull() | ~F.col("form_in").eqNullSafe(F.col("first.form")), F.struct(F.col("first.value").alias("value")))
    ends = ends.withColumn("_held", F.coalesce("last_turn", turned))
    # what is held when a stretch begins: the value that began the run of equal ones
    held_in = F.last("_held", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*(F.col(c).alias(f"{c}_") for c in parts), "form_in", held_in.alias("held_in"))
    staged = staged.join(carried, F.col("key").eqNullSafe(F.col("key_")) & (F.col("_stretch") == F.col("_stretch_")))
    before = F.coalesce("_before", "form_in")
    staged = staged.withColumn("_changed", before.isNull() | ~before.eqNullSafe(F.col("_form")))
    held = F.coalesce(F.last(F.when(F.col("_changed"), F.struct("value")), ignorenulls=True).over(so_far), F.col("held_in"))
    staged = staged.withColumn("old", held["value"])
    there, was = F.col("value").isNotNull(), F.col("old").isNotNull()
    update = F.when(there & ~was, "Add").when(there & ~F.col("_changed"), "Same").when(there, "Update").when(was, "Delete").otherwise("Filtered")
    return staged.select("key", update.alias("update_type"), F.col("value").alias("new"), "old", "seq", "ts_ms")


def change_feed(rows: DataFrame, spec: EntitySpec, sets: tuple[str, ...] = (), keep_same: bool = False) -> DataFrame:
    """What handlers get: adds, updates and deletes (and, if asked, Same and Filtered)."""
    feed = transitions(rows, spec, sets)
    return feed if keep_same else feed.where(F.col("update_type").isin("Add", "Update", "Delete"))


def latest_by_key(rows: DataFrame, tombstones: bool = True) -> DataFrame:
    """(key, value, ts_ms, seq): the last arrival of each key; deleted keys are gone. One aggregation, combined map-side."""
    seq = F.col("seq") if "seq" in rows.columns else F.col("offset")
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "ts_ms", seq.alias("seq")), seq).alias("x"))
    out = last.select("key", "x.value", "x.ts_ms", "x.seq")
    return out.where("value IS NOT NULL") if tombstones else out


def held(rows: DataFrame, spec: EntitySpec, sets: tuple[str, ...] = ()) -> DataFrame:
    """(key, value, ts_ms, seq) as conditional updates leave it: an equal value keeps the row and the time it had."""
    feed = change_feed(rows, spec, sets)
    last = feed.groupBy("key").agg(F.max_by(F.struct(F.col("new").alias("value"), "ts_ms", "seq"), "seq").alias("x"))
    return last.select("key", "x.value", "x.ts_ms", "x.seq").where("value IS NOT NULL")


def compacted(rows: DataFrame) -> DataFrame:
    """The last envelope of each key, tombstones too: what a load buffer hands on."""
    seq = F.col("seq") if "seq" in rows.columns else F.col("offset")
    return rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "key")), seq).alias("x")).select("key", "x.*")


# ---- writes ----


def upserts(df: DataFrame, spec: EntitySpec, first_offset: Column | int = 0, ts_ms: Column | int = 0, topic: str = "") -> DataFrame:
    """Rows as envelopes to append to a changelog."""
    return _envelope(df, spec, F.struct(*df.columns), first_offset, ts_ms, topic)


def deletes(keys: DataFrame, spec: EntitySpec, value: StructType, first_offset: Column | int = 0, ts_ms: Column | int = 0, topic: str = "") -> DataFrame:
    return _envelope(keys, spec, F.lit(None).cast(value), first_offset, ts_ms, topic)


def _envelope(df: DataFrame, spec: EntitySpec, value: Column, offset, ts_ms, topic: str) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    no_headers = F.array().cast("array<struct<key:string,value:binary>>")
    return df.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), as_column(offset).alias("offset"), as_column(ts_ms).alias("ts_ms"), spec.key_column().alias("key"), value.alias("value"), no_headers.alias("headers"))


def to_produce(feed: DataFrame, spec: EntitySpec, producer_id: str, topic: str = "", kinds: dict[str, str] | None = None) -> DataFrame:
    """Only what changed, as (topic, key, value, headers): deletes are tombstones, header columns go back to headers.

    ``enriched`` reads the headers back to the same values; numbers are raw little-endian bytes.
    """
    def entry(name: str, value: Column, kind: str = "string") -> Column:
        return F.struct(F.lit(name).alias("key"), header_bytes(value, kind).alias("value"))

    rows = feed.where(F.col("update_type").isin("Add", "Update", "Delete"))
    form = feed.schema["new"].dataType
    headers = [entry(PRODUCER_HEADER, F.lit(producer_id))]
    derived = [F.when(F.col(f"new.{c}").isNotNull(), entry(h, F.col(f"new.{c}"), header_kind(form, c, kinds))) for c, h in spec.headers.items()]
    value = F.col("new")
    if spec.headers:
        value = value.dropFields(*spec.headers)
    return rows.select(F.lit(topic).alias("topic"), "key", value.alias("value"), F.filter(F.array(*headers, *derived), lambda h: h.isNotNull()).alias("headers"))


def fan_in(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def map_form(c: Column, kind: MapType) -> Column:
    return canonical(c, kind)
