"""Last-update relations: for each group the time of its last update and the number of its entities.

A change feed is folded in order: adding or updating raises a group's time to the change's, never lowers it; removing an
entity, or moving it to another group, sets the time of a group that has entities left to that of the removal, which may
be earlier; a group without entities is gone. The fold is two aggregations, so no group's history meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events(feed: DataFrame, group: str, ts: Column | None = None, where=None) -> DataFrame:
    """(grp, seq, ts, delta, kind) from a change feed (update_type, old, new, seq, ts_ms).

    ``where`` makes a membership condition from "new" or "old"; ``ts`` is a time of the new row instead of the message's.
    """
    member = lambda side: (where(side) if where else F.lit(True)) & F.col(f"{side}.{group}").isNotNull()
    alive = feed.where(F.col("update_type").isin("Add", "Update", "Delete"))
    was = F.col("update_type").isin("Update", "Delete") & F.coalesce(member("old"), F.lit(False))
    now = F.col("update_type").isin("Add", "Update") & F.coalesce(member("new"), F.lit(False))
    stays = was & now & F.col(f"old.{group}").eqNullSafe(F.col(f"new.{group}"))
    own = F.coalesce(ts, F.col("ts_ms")) if ts is not None else F.col("ts_ms")
    nothing = F.lit(None).cast("struct<grp:string,delta:int>")
    gone = F.when(was & ~stays, F.struct(F.col(f"old.{group}").cast("string").alias("grp"), F.lit(-1).alias("delta"))).otherwise(nothing)
    come = F.when(now, F.struct(F.col(f"new.{group}").cast("string").alias("grp"), F.when(stays, 0).otherwise(1).alias("delta"))).otherwise(nothing)
    both = alive.select("seq", "ts_ms", own.cast("long").alias("own"), F.explode(F.filter(F.array(gone, come), lambda e: e.isNotNull())).alias("e"))
    return both.select(F.col("e.grp").alias("grp"), "seq", F.when(F.col("e.delta") < 0, F.col("ts_ms")).otherwise(F.col("own")).alias("ts"), F.col("e.delta").alias("delta"))


def last_update(changes: DataFrame) -> DataFrame:
    """(grp, last_ts, n) by the exact fold of events (grp, seq, ts, delta)."""
    resets = changes.where("delta < 0").groupBy("grp").agg(F.max("seq").alias("reset_seq"), F.max_by("ts", "seq").alias("reset_ts"))
    joined = changes.join(resets, "grp", "left")
    up_to = F.col("reset_seq").isNotNull() & (F.col("seq") <= F.col("reset_seq"))
    folded = joined.groupBy("grp").agg(
        F.sum("delta").alias("n"),
        F.sum(F.when(up_to, F.col("delta")).otherwise(0)).alias("left"),
        F.max(F.when(~up_to, F.col("ts"))).alias("since"),
        F.first("reset_ts").alias("reset_ts"),
    )
    last = F.when(F.col("left") > 0, F.greatest("since", "reset_ts")).otherwise(F.col("since"))
    return folded.where("n > 0").select("grp", last.alias("last_ts"), F.col("n").cast("long").alias("n"))


def last_update_simple(*tables: tuple[DataFrame, Column, Column]) -> DataFrame:
    """(grp, last_ts, n) over several tables (rows, group, time) that only ever add: one aggregation of their union."""
    out = None
    for df, group, ts in tables:
        part = df.select(group.cast("string").alias("grp"), ts.cast("long").alias("ts")).where("grp IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("grp").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def in_window(ts: Column, after: int, until: int | None = None) -> Column:
    """Strictly after, up to and including until."""
    return ts > after if until is None else (ts > after) & (ts <= until)


def updated_after(df: DataFrame, relation: DataFrame, group: str, after: int, until: int | None = None) -> DataFrame:
    hit = relation.where(in_window(F.col("last_ts"), after, until)).select(F.col("grp").alias("_grp"))
    return df.withColumn("_own", F.col(group).cast("string")).join(hit, F.col("_own") == F.col("_grp"), "left_semi").drop("_own")


def newest_walked(relation: DataFrame, after: int, until: int | None = None) -> DataFrame:
    """One row, max_ts: the greatest time among the groups walked, 0 without any."""
    return relation.where(in_window(F.col("last_ts"), after, until)).agg(F.coalesce(F.max("last_ts"), F.lit(0).cast("long")).alias("max_ts"))


def lookups(relation: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """One row over some groups or all: least and greatest time, entities."""
    rows = relation.where(F.col("grp").isin([str(g) for g in groups])) if groups else relation
    return rows.agg(F.min("last_ts").alias("min_ts"), F.max("last_ts").alias("max_ts"), F.sum("n").alias("entities"))
