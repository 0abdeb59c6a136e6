"""What the operators of this subpackage share: sessions, shared tables, hashing of words."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

#: An Arrow batch handed to Python ends at so many rows or bytes, so very long texts stay bounded.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_sent: set[str] = set()


def _send_package(spark: SparkSession) -> None:
    """Once for each application: give executors this package, which may be installed on the driver alone."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent.parent
    folder = os.path.realpath(tempfile.mkdtemp())  # served by the driver to executors as they come, so it stays
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)


def prepared(spark: SparkSession) -> SparkSession:
    """Send this package to the executors; bound the Arrow batches of this session unless the user has set them."""
    _send_package(spark)
    for key, value, default in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, str(2**31 - 1)),
    ):
        if spark.conf.get(key, default) in (default, f"{default}b", f"{default}B"):
            spark.conf.set(key, str(value))
    return spark


def integer_id(docs: DataFrame, id_col: str) -> None:
    """Refuse ids that are no integers, for operators that order documents by them."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see; it goes when the session ends.

    Only where that setting is absent and the master is local, so one machine is all there is, it is in the temp folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/keyweave-checkpoints"
    if "://" not in top:
        top = f"file://{top}" if top.startswith("/") else top
    folder = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/table"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the write goes with it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches, rows: int = 128):
    """Batches cut small, so that what a worker makes of one stays small: workers live on and keep what they once took."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---- words and their hashes, a whole batch of texts at a time ----

_rng = np.random.default_rng(20240229)
#: An odd number for each byte, for hashes modulo 2 ** 64 of short strings.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words may be long, and modulo 2 ** 64 there are pairs of long words that collide for every base; so they are hashed
#: modulo two primes, with bases that each family of hashes has for itself.
PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = _rng.integers(1 << 29, 1 << 30, (8, 2))
#: Terms below 2 ** 40 of up to so many bytes add up without a reduction.
_SUMMED = 1 << 23
_tables: dict[tuple[int, int], np.ndarray] = {}


def prime_powers(prime: int, base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo a prime below 2 ** 31."""
    out = np.ones(1, dtype=np.uint64)
    step = base % prime
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    held = _tables.get((prime, base))
    if held is None or len(held) < n:
        held = _tables[prime, base] = prime_powers(prime, base, max(n, 4096))
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(is_word) -> np.ndarray:
    """A table of 256 booleans from a predicate on bytes."""
    return np.array([bool(is_word(b)) for b in range(256)])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes that are hashed at a time, so that the arrays of a block stay in cache and memory stays bounded.
BLOCK = 1 << 20


def word_hashes(data: np.ndarray, ends: np.ndarray, word: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end in the byte array ``data``; text i ends at ``ends[i]``.

    Words are maximal runs of bytes b with word[b], cut at text ends; A-Z count as a-z. Returns for every word its
    hash (62 bits, spread over 64), first byte, end byte and text index. Hashes of another family are unrelated.
    """
    parts, at = [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and word[data[stop]]:  # to the end of a word or of a text
            gap = np.flatnonzero(~word[data[stop : stop + 4096]])
            limit = int(ends[np.searchsorted(ends, stop)])
            stop = min(limit, stop + (int(gap[0]) if len(gap) else 4096))
            if stop == limit:
                break
        parts.append((at, *_block_hashes(data[at:stop], ends[(ends > at) & (ends < stop)] - at, word, family)))
        at = stop
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    hashes = np.concatenate([p[1] for p in parts])
    starts = np.concatenate([p[2] + p[0] for p in parts])
    stops = np.concatenate([p[3] + p[0] for p in parts])
    return hashes, starts, stops, np.searchsorted(ends, starts, side="right")


def _block_hashes(data: np.ndarray, cuts: np.ndarray, word: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), starts, starts
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    values, longest = LOWER[data[at]].astype(np.uint64) + np.uint64(1), int(lengths.max())
    found = np.zeros(len(starts), dtype=np.uint64)
    for prime, base in zip(PRIMES, _BASES[family].tolist(), strict=True):
        terms = values * _powers(prime, base, longest)[place]
        if longest > _SUMMED:
            terms %= np.uint64(prime)
        found = found << np.uint64(31) | np.add.reduceat(terms, begin) % np.uint64(prime)
    return mix(found + lengths.astype(np.uint64)), starts, starts + lengths


def batch_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (all bytes, end offset of each text); nulls are empty."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
