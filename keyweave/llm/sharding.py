"""Sharding by fixed virtual slots (operator 6); DataFrame functions only.

Records are hashed into thousands of slots, whose number never changes. The bytes of each slot are summed, and a map
sends slots to shards: largest slot first, each to the shard with the fewest bytes so far (law ``bytes``: shards come
out near equal). The map is a table of a row for each slot, stored by version; rebalancing writes an edited version, in
which a new shard takes slots from those above the new mean and nothing else moves.

A record's place in its shard is gapless from 0: records before its slot in the shard, then its rank in the slot. So
numbering needs a window over one slot only, and only ids, sizes and checksums are shuffled. The slot table has
``slots`` rows whatever the data, so it is broadcast.

Defined results: a null text has 0 bytes, so size 8, and checksum 0; repeated rows each get a place of their own; a null
id is hashed like a value; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, vslot) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows"))


def _greedy(slots: Column, start: Column, choose) -> Column:
    """Walk over slots, keeping the bytes of shards and the shard chosen for each slot."""
    state = F.struct(start.alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def step(acc: Column, slot: Column) -> Column:
        shard = choose(acc["loads"], slot)
        gains = lambda x, i: x + F.when(i == shard, slot["n_bytes"]).otherwise(0) - F.when(i == slot["shard"], slot["n_bytes"]).otherwise(0)
        moved = F.transform(acc["loads"], gains)
        return F.struct(moved.alias("loads"), F.concat(acc["chosen"], F.array(shard)).alias("chosen"))

    return F.aggregate(slots, state, step, lambda acc: acc["chosen"])


def _exploded(listed: DataFrame, version: int) -> DataFrame:
    pairs = F.arrays_zip("slots", "chosen")
    rows = listed.select(F.explode(pairs).alias("x"))
    return rows.select(F.lit(version).alias("version"), F.col("x.slots.vslot").alias("vslot"), F.col("x.chosen").alias("shard"), F.col("x.slots.n_bytes").alias("n_bytes"), F.col("x.slots.n_rows").alias("n_rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of a map (version, vslot, shard, n_bytes, n_rows). The list it walks over has a row for each slot."""
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("n_bytes", "vslot", "n_rows", F.lit(-1).alias("shard"))), asc=False).alias("slots"))

    def lightest(loads: Column, slot: Column) -> Column:
        return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")

    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    return _exploded(listed.withColumn("chosen", _greedy(F.col("slots"), zero, lightest)), 1)


def grown_map(old: DataFrame, version: int) -> DataFrame:
    """The next version, with one more shard: it takes slots of shards above the new mean, until it has the mean."""
    listed = old.agg(F.sort_array(F.collect_list(F.struct("n_bytes", "vslot", "n_rows", "shard")), asc=False).alias("slots"))
    listed = listed.withColumn("n", F.array_max(F.transform("slots", lambda x: x["shard"])) + 1)
    none = F.lit(0).cast("long")
    load = lambda which: F.aggregate(which, none, lambda n, x: n + x["n_bytes"])
    start = F.transform(F.sequence(F.lit(0), F.col("n")), lambda s: load(F.filter("slots", lambda x: x["shard"] == s)))
    listed = listed.withColumn("start", start).withColumn("mean", load(F.col("slots")) / (F.col("n") + 1))

    def choose(loads: Column, slot: Column) -> Column:
        takes = (F.element_at(loads, slot["shard"] + 1) > F.col("mean")) & (F.element_at(loads, F.col("n") + 1) + slot["n_bytes"] <= F.col("mean"))
        return F.when(takes, F.col("n")).otherwise(slot["shard"])

    return _exploded(listed.withColumn("chosen", _greedy(F.col("slots"), F.col("start"), choose)), version)


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version; versions that are there stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    versions = spark.read.schema("vslot int, shard int, n_bytes bigint, n_rows bigint, version int").parquet(folder)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, slot being its place in the shard."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(id_col), "text_crc32", "size"))
    numbered = rows.withColumn("rank", rank).join(F.broadcast(bases), "vslot")  # a row for each slot: a fixed size
    return numbered.select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def shard(docs: DataFrame, shards: int, map_folder: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Make and store version 1 of the map, then place every row by the stored one."""
    rows = slotted(docs, slots, id_col, text_col)
    save_map(first_map(slot_sizes(rows), shards), map_folder)
    return placed(rows, load_map(docs.sparkSession, map_folder), id_col)
