"""Figures about entities, indexes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..spec import EntitySpec, Registry


def index_stats(spec: EntitySpec, df: DataFrame) -> DataFrame:
    """(index_name, n_keys, n_values) for every index: distinct values, and rows (or elements) that have one; one pass."""
    parts = []
    for i in spec.all_indexes():
        c = i.value()
        if not i.expr and isinstance(df.schema[i.column].dataType, ArrayType):
            c = F.array_distinct(c)
            parts.append(F.transform(c, lambda x, label=i.label: F.struct(F.lit(label).alias("i"), x.cast("string").alias("v"))))
        else:
            parts.append(F.array(F.struct(F.lit(i.label).alias("i"), c.cast("string").alias("v"))))
    rows = df.select(F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<struct<i:string,v:string>>")) for x in parts))).alias("x"))
    by_value = rows.where("x.v IS NOT NULL").groupBy(F.col("x.i").alias("index_name"), F.col("x.v").alias("v")).agg(F.count("*").alias("n"))
    return by_value.groupBy("index_name").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_values"))


def registry_stats(registry: Registry) -> DataFrame:
    """(entity, n_rows, n_indexes) of every entity."""
    out = None
    for name in registry.names():
        part = registry.df(name).agg(F.lit(name).alias("entity"), F.count("*").alias("n_rows"), F.lit(len(registry.spec(name).all_indexes())).alias("n_indexes"))
        out = part if out is None else out.unionByName(part)
    return out


def registry_json(registry: Registry) -> DataFrame:
    """One row, value: the figures of all entities as a JSON array."""
    rows = registry_stats(registry)
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("entity", "n_rows", "n_indexes")))).alias("value"))  # a row for each entity


#: What a stream's health is judged by.
LIMITS = {"stall_ms": 60_000, "handler_ms": 30_000, "brokers": 1}


def stream_stats(spark: SparkSession) -> DataFrame:
    """A row for every active stream, from its last progress."""
    rows = []
    for q in spark.streams.active:
        p = q.lastProgress or {}
        state = (p.get("stateOperators") or [{}])[0] if p else {}
        rows.append((q.name or str(q.id), bool(q.isActive), int(p.get("batchId", -1)), float(p.get("inputRowsPerSecond") or 0), int(state.get("numRowsTotal") or 0), str(q.exception() or "")))
    return spark.createDataFrame(rows, "stream string, active boolean, batch long, input_rows_per_second double, state_rows long, failure string")


def health(stats: dict, now_ms: int, expected: tuple[str, ...] = (), limits: dict[str, int] | None = None) -> list[str]:
    """Names of what is wrong with streams given as {name: {...}}; what a stream doesn't tell counts as well.

    failure (fatal), active (stopped), last_ms (stalled), lost_partitions, brokers_up (brokers down), loaded (loading),
    faulted (its loop failed), partitions (none assigned), handler_since_ms (a handler that is at work for too long).
    """
    at = LIMITS | (limits or {})
    found = []
    for name, s in sorted(stats.items()):
        checks = {
            "fatal": bool(s.get("failure")),
            "stopped": not s.get("active", True),
            "stalled": now_ms - s.get("last_ms", now_ms) >= at["stall_ms"],
            "partitions lost": bool(s.get("lost_partitions")),
            "brokers down": s.get("brokers_up", at["brokers"]) < at["brokers"],
            "loading": not s.get("loaded", True),
            "faulted": bool(s.get("faulted")),
            "no partition": s.get("partitions", 1) < 1,
            "slow handler": bool(s.get("handler_since_ms")) and now_ms - s["handler_since_ms"] >= at["handler_ms"],
        }
        found += [f"{name}: {what}" for what, wrong in checks.items() if wrong]
    return found + [f"{name}: missing" for name in expected if name not in stats]
