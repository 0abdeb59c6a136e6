"""Exact deduplication by composable polynomial fingerprints (operator 3).

A text is normalised (each run of blanks and control spaces becomes one space) and cut into chunks. Every chunk has a
polynomial hash modulo two primes, and the chunks of a text combine by length-shifted arithmetic: the hash of ab is
hash(a) * base ** len(b) + hash(b), in any grouping. Texts over SEGMENT bytes become a row for each segment, which any
task may hash: what a segment adds, shifted by the bytes behind it, is summed up by document. Texts with equal
fingerprints and lengths are then compared, segment by segment, with the first text of their group. Texts that differ in
spite of equal fingerprints form the next round, until every text has met an equal one or is the first of its kind.

Ids, fingerprints and digests of all rows are shuffled; texts once, by id and a hash, as they are in the table, to find
those of groups; only these are normalised again, stored, and dealt once by fingerprint and segment. What groups have
one row of (first segment, size) is stored before it is joined to their members, so that an adaptive join can split the
members of a large group.

Defined results: null texts count as empty and equal the empty text; among equal texts the row with the smallest id
stays, a null id only among null ids; of rows that repeat an id and a text, one stays (if that id stays); an empty
table gives an empty table; extra columns are ignored (drop_duplicates passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRIMES, batch_bytes, partitions, prepared, stored

#: A base for each prime.
BASES = (1103515245, 1664525)
#: Bytes hashed at a time; bytes of a text in one row.
CHUNK, SEGMENT = 4096, 1 << 20
SPACES = r"[\x20\x09-\x0D]+"


class Polynomial:
    """Hashes of byte strings modulo a prime; hash and length of a chunk are all that combining needs."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base = prime, base % prime
        powers = [1]
        for _ in range(CHUNK):
            powers.append(powers[-1] * self.base % prime)
        self.powers = np.array(powers[:CHUNK][::-1], dtype=np.uint64)
        self.shift = powers[CHUNK]

    def chunk(self, data: np.ndarray) -> int:
        """The hash of up to CHUNK bytes; a byte counts as its value plus one."""
        return int(((data.astype(np.uint64) + np.uint64(1)) * self.powers[CHUNK - len(data) :]).sum() % np.uint64(self.prime))

    def combine(self, a: int, b: int, length_b: int) -> int:
        return (self.shifted(a, length_b) + b) % self.prime

    def shifted(self, a: int, behind: int) -> int:
        """What a stretch adds to the hash of a text that has so many bytes behind it."""
        return a * pow(self.base, behind, self.prime) % self.prime if behind else a

    def text(self, data: np.ndarray) -> int:
        whole = len(data) // CHUNK
        found = 0
        if whole:
            chunks = ((data[: whole * CHUNK].reshape(whole, CHUNK).astype(np.uint64) + np.uint64(1)) * self.powers).sum(axis=1) % np.uint64(self.prime)
            for h in chunks.tolist():
                found = (found * self.shift + h) % self.prime
        rest = data[whole * CHUNK :]
        return self.combine(found, self.chunk(rest), len(rest)) if len(rest) else found


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _key(id_col: Column) -> Column:
    """An id to join by that is never null."""
    return F.coalesce(id_col.cast("string"), F.lit("null"))


def _raw(text: Column) -> list[Column]:
    """128 bits of a text as it is, to find a row again."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2")]


def _segments(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row for each segment of the bytes of a text: ``segment``, its number, and how many bytes are ``behind`` it."""
    rows = rows.withColumn("_bytes", F.col(text).cast("binary")).drop(text)
    rows = rows.withColumn("number", F.explode(F.expr(f"sequence(0, cast(greatest(0, (n - 1) div {SEGMENT}) as int))")))
    cut = F.expr(f"substring(_bytes, cast(cast(number as long) * {SEGMENT} + 1 as int), {SEGMENT})")
    return rows.withColumn("segment", cut).withColumn("behind", F.expr(f"greatest(0, cast(n as long) - (number + 1L) * {SEGMENT})")).drop("_bytes")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, primes: tuple[int, int]) -> DataFrame:
    """(id, sha, n, r1, r2, tag, number, h1, h2) of every segment of every row; ``tag`` is another for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Polynomial(p, b) for p, b in zip(primes, BASES, strict=True)]
        for batch in batches:
            data, ends = batch_bytes(batch["segment"])
            starts = np.append(0, ends)[:-1]
            added = [[h.shifted(h.text(data[a:b]), behind) for a, b, behind in zip(starts.tolist(), ends.tolist(), batch["behind"].to_pylist(), strict=True)] for h in hashes]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(x, pa.int64()) for x in added)], [*names, "h1", "h2"])

    names = ["id", "sha", "n", "r1", "r2", "tag", "number"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, sha string, n int, r1 long, r2 long, tag long, number int, h1 long, h2 long"
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def rows(chosen: Column, branch: int) -> DataFrame:
        found = docs.where(chosen).select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("text"), *_raw(F.col(f"`{text_col}`")))
        return found.select("id", "text", "r1", "r2", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"), (F.monotonically_increasing_id() * 2 + branch).alias("tag"))

    fields = ["segment", "behind", *names]
    short = rows(size <= SEGMENT, 0).select(F.col("text").cast("binary").alias("segment"), F.lit(0).cast("long").alias("behind"), F.lit(0).alias("number"), *(c for c in names if c != "number")).select(*fields)
    long = _segments(rows(size > SEGMENT, 1)).select(*fields).repartition(partitions(docs.sparkSession), "r1", "number")
    return short.mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))


def _groups(docs: DataFrame, id_col: str, text_col: str, primes: tuple[int, int]) -> DataFrame:
    """(id, keep, size, kept, sha, r1, r2) of every row; r1 and r2 name its text as it is."""
    prepared(docs.sparkSession)
    hashed = stored(_fingerprints(docs, id_col, text_col, primes), "fingerprints")
    rows = hashed.where("number = 0").select("id", _key(F.col("id")).alias("key"), "sha", "r1", "r2", "tag")
    # a repeated row adds the same again, so the sum is divided by how often its first segment is there
    summed = hashed.groupBy(_key(F.col("id")).alias("key"), "sha", "n").agg(
        F.first("id").alias("id"),
        F.sum(F.when(F.col("number") == 0, 1).otherwise(0)).alias("repeats"),
        F.min("tag").alias("tag"),
        F.min(F.when(F.col("number") == 0, F.struct("r1", "r2"))).alias("raw"),
        F.sum("h1").alias("h1"),
        F.sum("h2").alias("h2"),
    )
    fp = [F.expr(f"({h} div repeats) % {p}") for h, p in zip(("h1", "h2"), primes, strict=True)]
    rest = stored(summed.select("key", "id", "sha", "n", "repeats", "tag", "raw.r1", "raw.r2", F.shiftleft(fp[0], 31).bitwiseOR(fp[1]).alias("fp")), "documents")
    texts, solved = None, None
    while True:
        first = rest.groupBy("fp", "n").agg(F.min("id").alias("keep"), F.sum("repeats").alias("size")).where("size > 1").drop("size")
        members = rest.join(stored(first, "first"), ["fp", "n"])
        if texts is None:
            # dealt by id and hash at every size, so that the plan doesn't change as the corpus grows
            raw = docs.select(F.col(f"`{text_col}`").alias("text"), _key(F.col(f"`{id_col}`")).alias("key"), *_raw(F.col(f"`{text_col}`")))
            found = raw.join(members.hint("merge"), ["key", "r1", "r2"]).withColumn("text", normalised(F.col("text")))
            found = found.where(F.sha2("text", 256) == F.col("sha"))
            # of each (id, text) of a group one row, as segments
            texts = stored(_segments(found.dropDuplicates(["key", "sha"])).drop("behind", "r1", "r2"), "texts")
            own = texts
        else:
            own = texts.drop("keep").join(members.select("key", "sha", "keep"), ["key", "sha"])
        heads = own.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("fp", "n", "number").agg(F.min_by("segment", "sha").alias("first_segment"))
        compared = own.join(stored(heads, "heads"), ["fp", "n", "number"]).withColumn("same", F.col("segment") == F.col("first_segment"))
        compared = compared.groupBy("key", "sha", "fp", "n").agg(F.first("id").alias("id"), F.first("keep").alias("keep"), F.first("repeats").alias("repeats"), F.first("tag").alias("tag"), F.every("same").alias("same"))
        compared = stored(compared, "compared")
        equal = compared.where("same").drop("same", "fp", "n")
        solved = equal if solved is None else solved.unionByName(equal)
        rest = compared.where("NOT same").drop("same", "keep")
        if rest.isEmpty():
            break
    solved = solved.withColumn("keep_key", _key(F.col("keep"))).drop("id")
    sizes = stored(solved.groupBy("sha", "keep_key").agg(F.sum("repeats").alias("size")), "sizes")
    found = solved.join(sizes, ["sha", "keep_key"]).select("key", "sha", "keep", "size", F.col("tag").alias("first_tag"))
    joined = rows.join(found, ["key", "sha"], "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    kept = F.col("size").isNull() | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("tag") == F.col("first_tag")))
    return joined.select("id", keep.alias("keep"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), kept.alias("kept"), "sha", "r1", "r2")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    groups = _groups(docs, id_col, text_col, primes)
    return groups.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    stay = _groups(docs, id_col, text_col, PRIMES).where("kept").select(_key(F.col("id")).alias("key"), "r1", "r2")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _key(F.col(f"`{id_col}`")).alias("key"), *_raw(F.col(f"`{text_col}`")))
    joined = packed.join(stay.hint("merge"), ["key", "r1", "r2"])
    # what is kept is unique by these, so this takes one of repeated rows, where the join has put them
    return joined.dropDuplicates(["key", "r1", "r2"]).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
