"""Joins that never multiply left rows: the right side is packed first, as a struct or an array of structs.

Only the columns asked for are packed, so the scan reads no others; a "many" side may come as aggregates, which are
combined before the shuffle and need no array at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def packed_struct(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in columns or df.columns))


def last_writers(df: DataFrame, on: Column, order: Column | None = None) -> DataFrame:
    """Of rows that share a value, the last writer's: the greatest by ``order``, or else by all columns; without null values.

    A column that isn't used later isn't read, as each is an aggregate of its own.
    """
    by = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)]
    rank = F.struct(*([order.alias("_order")] if order is not None else by))
    rows = df.withColumn("_on", on).where("_on IS NOT NULL").withColumn("_rank", rank)
    return rows.groupBy("_on").agg(*(F.max_by(F.col(f"`{c}`"), F.col("_rank")).alias(c) for c in df.columns)).drop("_on")


def pack_one(right: DataFrame, on: Column, alias: str, columns: list[str] | None = None) -> DataFrame:
    """(_on, alias struct) of a right side that has a value once."""
    return right.select(on.alias("_on"), packed_struct(right, columns).alias(alias))


def pack_many(right: DataFrame, on: Column, alias: str, columns: list[str] | None = None, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """(_on, alias array of structs, or one struct of aggregates); Spark combines partial results before the shuffle."""
    if aggregates:
        found = right.withColumn("_on", on).where("_on IS NOT NULL").groupBy("_on").agg(*(c.alias(name) for name, c in aggregates.items()))
        return found.select("_on", F.struct(*aggregates).alias(alias))
    rows = right.select(on.alias("_on"), packed_struct(right, columns).alias("_row")).where("_on IS NOT NULL")
    return rows.groupBy("_on").agg(F.collect_list("_row").alias(alias))


def attach(left: DataFrame, packed: DataFrame, left_on: Column, alias: str, inner: bool, many: bool) -> DataFrame:
    """left with one more column; an outer collection without matches is empty, not null."""
    keyed = left.withColumn("_left_on", left_on)
    joined = keyed.join(packed, F.col("_left_on") == F.col("_on"), "inner" if inner else "left").drop("_left_on", "_on")
    if many and not inner:
        empty = F.array().cast(packed.schema[alias].dataType)
        joined = joined.withColumn(alias, F.coalesce(alias, empty))
    return joined


def join_one(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, alias: str, inner: bool = False, columns: list[str] | None = None) -> DataFrame:
    return attach(left, pack_one(right, right_on, alias, columns), left_on, alias, inner, False)


def join_many(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, alias: str, inner: bool = False, survivors: bool = False, columns: list[str] | None = None, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """``survivors``: only children of left rows are grouped, worth it when the left side is a narrowed scan."""
    if survivors:
        keys = left.select(left_on.alias("_key")).where("_key IS NOT NULL").distinct()
        right = right.withColumn("_own", right_on).join(keys, F.col("_own") == F.col("_key"), "left_semi")
        right_on, columns = F.col("_own"), columns or [c for c in right.columns if c != "_own"]
    return attach(left, pack_many(right, right_on, alias, columns, aggregates), left_on, alias, inner, not aggregates)


def join_collection(left: DataFrame, right: DataFrame, left_key: Column, collection: str, alias: str, inner: bool = False, columns: list[str] | None = None) -> DataFrame:
    """M:N, the right side holds a collection of left keys; an element counts once."""
    rows = right.select(packed_struct(right, columns).alias("_row"), F.explode(F.array_distinct(F.col(collection))).alias("_on")).where("_on IS NOT NULL")
    packed = rows.groupBy("_on").agg(F.collect_list("_row").alias(alias))
    return attach(left, packed, left_key, alias, inner, True)


def join_collection_forward(left: DataFrame, right: DataFrame, left_key: list[str], collection: str, right_key: Column, alias: str, inner: bool = False, columns: list[str] | None = None) -> DataFrame:
    """M:N, the left side holds a collection of right keys. Left rows are identified by their key."""
    ties = left.select(F.struct(*left_key).alias("_id"), F.explode(F.array_distinct(F.col(collection))).alias("_ref"))
    rows = right.select(right_key.alias("_on"), packed_struct(right, columns).alias("_row"))
    packed = ties.join(rows, F.col("_ref") == F.col("_on")).groupBy(F.col("_id").alias("_on")).agg(F.collect_list("_row").alias(alias))
    return attach(left, packed, F.struct(*left_key), alias, inner, True)
