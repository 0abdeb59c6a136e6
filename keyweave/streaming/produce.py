"""The write side: what changed goes out as envelopes, to files or to Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.changelog import to_produce
from ..spec import EntitySpec


class Producer:
    """A handler of change feeds (for ``Follower.on_change`` or ``foreachBatch``) that writes adds, updates and tombstones.

    Files go to a folder for each batch, which a batch that comes again overwrites. Kafka gets keys as text and values as
    JSON, at least once; Spark's connector must be there, and retries are its own (``kafka.retries``).
    """

    def __init__(self, spec: EntitySpec, producer_id: str, topic: str = "", folder: str | None = None, kafka: dict[str, str] | None = None, kinds: dict[str, str] | None = None):
        if (folder is None) == (kafka is None):
            raise ValueError("either a folder or options for Kafka")
        self.spec, self.producer_id, self.topic, self.folder, self.kafka, self.kinds = spec, producer_id, topic, folder, kafka, kinds

    def __call__(self, feed: DataFrame, batch_id: int) -> None:
        out = to_produce(feed, self.spec, self.producer_id, self.topic, self.kinds)
        if self.folder is not None:
            out.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        else:
            wire(out).write.format("kafka").options(**self.kafka).save()


def wire(out: DataFrame) -> DataFrame:
    """Envelopes as Kafka's sink takes them; a tombstone has no value."""
    return out.select("topic", F.col("key").cast("string").alias("key"), F.when(F.col("value").isNotNull(), F.to_json("value")).alias("value"), "headers")
