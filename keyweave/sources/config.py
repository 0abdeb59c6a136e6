"""Where changelogs come from: topic templates, and readers for files and (if its connector is there) Kafka."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from .changelog import Decoder, parsed

_PART = re.compile(r"\[(v|e):([^\]]+)\]", re.I)


def topic_name(template: str | None, entity: str, variables: dict[str, str] | None = None) -> str:
    """``[v:x]`` is a variable, ``[e:X]`` an environment variable; what isn't known stays as it is. Default: the entity's name."""
    def value(m: re.Match) -> str:
        found = (variables or {}).get(m[2]) if m[1].lower() == "v" else os.environ.get(m[2])
        return m[0] if found is None else found

    return _PART.sub(value, template or entity).strip()


def read_changelog(spark: SparkSession, path: str, schema: StructType | None = None, stream: bool = False) -> DataFrame:
    """A folder of Parquet envelopes, at rest or as a stream (which needs the schema)."""
    if stream:
        return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, value: StructType, stream: bool = False, options: dict[str, str] | None = None, key: DataType | None = None, decoder: Decoder | None = None) -> DataFrame:
    """A topic from its earliest offset to the latest (or on and on), as envelopes. Needs Spark's Kafka connector."""
    reader = spark.readStream if stream else spark.read
    settings = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true"}
    return from_kafka(reader.format("kafka").options(**settings | (options or {})).load(), value, key, decoder)


def from_kafka(rows: DataFrame, value: StructType, key: DataType | None = None, decoder: Decoder | None = None) -> DataFrame:
    """Rows as Kafka's source has them, as envelopes: JSON values (or what the decoder reads), keys as text of their type.

    A message that can't be read, value or key, has its text in ``quarantine``; it is neither an upsert nor a tombstone, so
    keep the rows where that is null.
    """
    key = key or StringType()
    text = F.col("key").cast("string")
    named = F.from_json(text, key) if isinstance(key, StructType) else text.try_cast(key)
    lost = text.isNotNull() & named.isNull()
    read = parsed(rows, value, "value", decoder)
    quarantine = F.coalesce("quarantine", F.when(lost, text))
    return read.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms"), named.alias("key"), F.when(quarantine.isNull(), F.col("value")).alias("value"), "headers", quarantine.alias("quarantine"))
