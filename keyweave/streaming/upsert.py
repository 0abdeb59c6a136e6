"""The live side: a stateful upsert by key that emits the change feed, and a driver for loading, then following.

State is one value for each key in RocksDB. Within a micro-batch the rows of a key are taken in arrival order, and each
transition is emitted. Loading runs over what is there with handlers silent; following goes on from the same checkpoint,
so nothing between the two is lost.
"""

from __future__ import annotations

import json
import re
import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from ..functions.equality import canonical
from ..spec import EntitySpec

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("value", StringType()), StructField("form", StringType())])


# The processor is sent as a whole: the machines that run it need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Upsert(StatefulProcessor):
    """Holds the last value of a key as JSON, and its comparable form."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        old, form = self.held.get() if self.held.exists() else (None, None)
        out = []
        for seq, ts, new, new_form in batch[["seq", "ts_ms", "new", "form"]].itertuples(index=False):
            new, new_form = (None, None) if new is None or new != new else (new, new_form)
            if new is None:
                kind = "Filtered" if old is None else "Delete"
            elif old is None:
                kind = "Add"
            else:
                kind = "Same" if form == new_form else "Update"
            out.append((key[0], kind, new, old, int(seq), int(ts)))
            if kind in ("Add", "Update", "Delete"):
                old, form = new, new_form
        if old is None:
            self.held.clear()
        else:
            self.held.update((old, form))
        yield pd.DataFrame(out, columns=["key", "update_type", "new", "old", "seq", "ts_ms"])

    def close(self) -> None:
        pass


def stream_feed(rows: DataFrame, spec: EntitySpec, sets: tuple[str, ...] = (), keep_same: bool = False) -> DataFrame:
    """The change feed (key, update_type, new, old, seq, ts_ms) of a stream of envelopes."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    value: DataType = rows.schema["value"].dataType
    key: DataType = rows.schema["key"].dataType
    text = F.when(F.col("value").isNotNull(), F.to_json("value", {"ignoreNullFields": "false"}))
    form = F.when(F.col("value").isNotNull(), F.to_json(F.struct(canonical(F.col("value"), value, sets, spec.ignore_equality).alias("f")), {"ignoreNullFields": "false"}))
    staged = rows.select("key", F.col("offset").alias("seq"), "ts_ms", text.alias("new"), form.alias("form"))
    schema = StructType([StructField("key", key), StructField("update_type", StringType()), StructField("new", StringType()), StructField("old", StringType()), StructField("seq", LongType()), StructField("ts_ms", LongType())])
    feed = staged.groupBy("key").transformWithStateInPandas(Upsert(), schema, "Update", "None")
    if not keep_same:
        feed = feed.where(F.col("update_type").isin("Add", "Update", "Delete"))
    return feed.withColumn("new", F.from_json("new", value)).withColumn("old", F.from_json("old", value))


class Follower:
    """Loads what a changelog holds, then follows it, upserting a table and calling handlers when live."""

    def __init__(self, feed: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None] | None = None, name: str = "follower"):
        self.feed, self.checkpoint, self.apply, self.name = feed, checkpoint, apply, name
        self.handlers: list[Callable[[DataFrame, int], None]] = []
        self.failures: list[str] = []
        self.query = None

    def on_change(self, handler: Callable[[DataFrame, int], None]) -> Follower:
        self.handlers.append(handler)
        return self

    def _batch(self, live: bool) -> Callable[[DataFrame, int], None]:
        def run(rows: DataFrame, batch_id: int) -> None:
            if self.apply:
                self.apply(rows, batch_id)
            for handler in self.handlers if live else ():
                try:
                    handler(rows.orderBy("seq"), batch_id)
                except Exception as e:  # a handler's failure is noted and doesn't stop the stream
                    self.failures.append(f"{getattr(handler, '__name__', type(handler).__name__)}: {e}")

        return run

    def load(self, seconds: int | None = None) -> Follower:
        """All that is there now, handlers silent; TimeoutError names what is pending after so many seconds."""
        load_all([self], seconds)
        return self

    def follow(self, **trigger) -> Follower:
        self.query = self._start(True, trigger or {"processingTime": "1 second"})
        return self

    def follow_available(self) -> Follower:
        self._start(True, {"availableNow": True}).awaitTermination()
        return self

    def _start(self, live: bool, trigger: dict):
        writer = self.feed.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).outputMode("update")
        return writer.foreachBatch(self._batch(live)).trigger(**trigger).start()

    def stop(self, seconds: int = 30) -> list[str]:
        """Drain and stop; names what didn't stop in time."""
        if self.query is None:
            return []
        self.query.processAllAvailable()
        self.query.stop()
        return [] if self.query.awaitTermination(seconds) else [self.name]


def load_all(followers: list[Follower], seconds: int | None = None) -> None:
    """Load several at once; TimeoutError names those that aren't done in time, which are stopped."""
    running = [(f.name, f._start(False, {"availableNow": True})) for f in followers]
    end = None if seconds is None else time.monotonic() + seconds
    pending = []
    for name, query in running:
        if end is None:
            query.awaitTermination()
        elif not query.awaitTermination(max(0.001, end - time.monotonic())):
            progress = query.lastProgress
            pending.append(f"{name} (batch {progress['batchId'] if progress else 'none yet'})")
            query.stop()
    if pending:
        raise TimeoutError("still loading: " + ", ".join(pending))


class ParquetTable:
    """A keyed table in ``buckets`` by a hash of the key; a batch of a feed writes only the buckets that it touches.

    A manifest for each batch names the version of every bucket and is put in place last. So a batch that failed midway
    leaves no trace, one that comes again changes nothing, and a new instance on the folder goes on where the last one
    was. Files that a batch supersedes go with the next one.
    """

    def __init__(self, spark: SparkSession, folder: str, key: DataType, value: DataType, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schema = StructType([StructField("key", key), StructField("value", value), StructField("ts_ms", LongType())])
        jvm = spark.sparkContext._jvm
        self._path = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join((folder, *names)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def manifest(self) -> dict:
        """{batch, versions by bucket, stale}: what the last complete batch has left."""
        place = self._path("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []
        batches = [int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)]
        if not batches:
            return {"batch": -1, "versions": {}, "stale": []}
        stream = self._fs.open(self._path("manifests", f"{max(batches)}.json"))
        try:
            return json.loads(self._text(stream))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        draft, place = (self._path("manifests", f"{'.' * hidden}{manifest['batch']}.json") for hidden in (1, 0))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.rename(draft, place)

    def _read(self, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/v{v}/bucket={b}" for b, v in sorted(versions.items())))

    def read(self) -> DataFrame:
        return self._read(self.manifest()["versions"])

    def apply(self, feed: DataFrame, batch_id: int) -> None:
        before = self.manifest()
        if batch_id <= before["batch"]:
            return
        for name in before["stale"]:
            self._fs.delete(self._path(name), True)
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        last = feed.groupBy("key").agg(F.max_by(F.struct("new", "ts_ms"), "seq").alias("x"))
        staged = last.select("key", F.col("x.new").alias("value"), F.col("x.ts_ms").alias("ts_ms"), bucket.alias("bucket"))
        staged.write.mode("overwrite").parquet(f"{self.folder}/staged")  # the feed runs once
        staged = self.spark.read.schema(staged.schema).parquet(f"{self.folder}/staged")
        touched = {str(r.bucket) for r in staged.select("bucket").distinct().collect()}  # ``buckets`` at most
        rest = self._read({b: v for b, v in before["versions"].items() if b in touched}).join(staged.select("key"), "key", "left_anti")
        rows = rest.withColumn("bucket", bucket).unionByName(staged.where("value IS NOT NULL"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{batch_id}")
        there = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"v{batch_id}"))]
        versions = {b: v for b, v in before["versions"].items() if b not in touched}
        versions |= {n.removeprefix("bucket="): batch_id for n in there if n.startswith("bucket=")}
        stale = [f"v{v}/bucket={b}" for b, v in before["versions"].items() if b in touched]
        self._commit({"batch": batch_id, "versions": versions, "stale": stale})
