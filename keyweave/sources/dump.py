"""Dumps of changelogs, and of whole registries, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import Registry
from .changelog import upserts

COLUMNS = ("topic", "partition", "offset", "ts_ms", "key", "value", "headers")


def create_dump(rows: DataFrame, path: str) -> None:
    rows.select(*COLUMNS).write.mode("overwrite").parquet(path)


def create_dumps(registry: Registry, folder: str) -> dict[str, str]:
    """Every entity's rows as envelopes; entity to path."""
    paths = {}
    for name in registry.names():
        paths[name] = f"{folder}/{name}"
        create_dump(upserts(registry.df(name), registry.spec(name), topic=name), paths[name])
    return paths


def load_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
