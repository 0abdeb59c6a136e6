"""Removal of repeated byte strings by a sparse, range-partitioned suffix array (operator 4).

Every byte is removed that lies in a string of SIZE bytes which also starts earlier: in a smaller document, or in the
same one further to the front. A full suffix array has an entry for each byte, many times the input on disk; here only
suffixes at content-defined places are sorted, which loses nothing: the anchor of a window is the place in it whose
GRAM leading bytes have the least hash, so equal windows have their anchors at the same offset, and it is enough to
compare suffixes at anchors, with the bytes before them.

1. Anchors (about one in 35 bytes) are range-partitioned by a hash of their leading bytes, then of their core (all bytes
   of all windows of that anchor), with splitters that Spark samples; each bucket is sorted and read once. Of equal cores
   only the first stays, the later ones are covered whole. Anchors whose leading bytes no other core shares are done.
2. The suffixes of the cores that are left are range-partitioned by their bytes, again by sampled splitters, and sorted
   bucket by bucket with multikey quicksort, forwards from the anchor and backwards before it. Common prefixes of
   neighbours in both orders tell which windows are equal; of those the first stays.
3. A group of equal leading bytes at a bucket's border, or too large for a bucket, is compared across borders. Each of
   its suffixes sends the runs of windows that are the first of their kind in its bucket, as bytes: equal runs of other
   buckets are covered whole, a run that shares no window with another is done, and only what is left is cut into
   shorter runs (LEVELS) and compared again. A suffix sends a row or two, not one for each window.
4. Spans are gathered by document and cut out of its text.

Cores are named by 126 bits in all, of two unrelated kinds of hash; suffixes and runs are compared byte by byte.

Defined results: a null text counts as empty; texts shorter than SIZE lose nothing; rows that repeat an id and a text
are one document and get the same row each; where texts differ under one id, their order is that of a hash of the text;
a null id comes before all others; an empty table gives an empty table; extra columns are ignored; ids that are no
integers are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE, PRIMES, batch_bytes, integer_id, mix, partitions, prepared, prime_powers, stored

#: Bytes of a string that may not repeat, and leading bytes that anchors are chosen and dealt by.
SIZE, GRAM = 100, 32
REACH = SIZE - GRAM  # an anchor is so far behind the start of its window at most
#: Windows searched for anchors at a time; rows of a bucket sorted at a time.
BLOCK, BUCKET = 1 << 18, 1 << 16
#: Windows that a run compared across buckets may have, round by round.
LEVELS = (REACH + 1, 16, 4, 1)
_LOW = np.uint64((1 << 20) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_ODD = 0x9E3779B97F4A7C15
_UP = _powers(BLOCK + 2 * SIZE + 1, _ODD)
_DOWN = _powers(BLOCK + 2 * SIZE + 1, pow(_ODD, -1, 1 << 64))
#: For cores, beside the hashes modulo 2 ** 64: powers of a base and of its inverse modulo each of two primes.
_BASES = (1_294_967_291, 1_710_612_743)
_MODULAR = [(np.uint64(p), prime_powers(p, b, BLOCK + 2 * SIZE + 1), prime_powers(p, pow(b, -1, p), BLOCK + 2 * SIZE + 1)) for p, b in zip(PRIMES, _BASES, strict=True)]


# ---- anchors ----


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each anchor its gram hash, core hash, text, place, and first and last window."""
    starts = np.append(0, ends)[:-1]
    parts = []
    pending: list[int] = []
    size = 0
    for k, n in enumerate((ends - starts).tolist()):
        if n < SIZE:
            continue
        if n > BLOCK or size + n > BLOCK:
            parts += _block(data, starts, ends, pending)
            pending, size = [], 0
        if n > BLOCK:  # a long text in pieces that share no window
            for at in range(0, n - SIZE + 1, BLOCK):
                piece = data[starts[k] + at : min(starts[k] + at + BLOCK + SIZE - 1, ends[k])]
                parts.append((*_anchors(piece, np.array([0]), np.array([len(piece)]), np.array([k])), at))
        else:
            pending.append(k)
            size += n
    parts += _block(data, starts, ends, pending)
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty, empty
    columns = list(zip(*[(h, c, t, a + at, lo + at, hi + at) for h, c, t, a, lo, hi, at in parts], strict=True))
    return tuple(np.concatenate(c) for c in columns)


def _block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: list[int]) -> list[tuple]:
    if not texts:
        return []
    joined = np.concatenate([data[starts[k] : ends[k]] for k in texts])
    stops = np.cumsum(ends[texts] - starts[texts])
    return [(*_anchors(joined, np.append(0, stops)[:-1], stops, np.array(texts)), 0)]


def _anchors(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * _UP[:n], out=prefix[1:])
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * _DOWN[: n - GRAM + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= REACH + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = REACH + 1 - reach
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & _LOW).astype(np.int64)  # of the window that starts here
    owner = np.repeat(np.arange(len(starts)), stops - starts)[: len(at)]
    real = np.arange(len(at)) + SIZE <= stops[owner]
    windows = np.flatnonzero(real)
    at, owner = at[windows], owner[windows]
    fresh = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    low, high, place, owner = windows[first], windows[last], at[first], owner[first]
    cores = _core_names(data, low, high + SIZE) + ((high - low) << 7 | (place - low)).astype(np.uint64) * np.uint64(_ODD)
    base = starts[owner]
    return grams[place].view(np.int64), mix(cores).view(np.int64), texts[owner], place - base, low - base, high - base


def _core_names(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """62 bits of each stretch of bytes: its polynomials modulo two primes."""
    found = np.zeros(len(start), dtype=np.uint64)
    values = data.astype(np.uint64) + np.uint64(1)
    for prime, up, down in _MODULAR:
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)  # below 2 ** 58
        np.cumsum(values * up[: len(data)], out=prefix[1:])
        found = found << np.uint64(31) | (prefix[stop] - prefix[start]) % prime * down[start] % prime
    return found


def packed(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place, first and last window of an anchor in one integer, ordered by place: fewer bytes to shuffle."""
    return (place << 14) | ((place - low) << 7) | (place - high)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = at >> 14
    return place, place - ((at >> 7) & 127), place - (at & 127)


# ---- buckets of anchors ----


def _groups(batches: Iterator[pa.RecordBatch], by: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by a column, as tables of whole groups; True where a group may go on outside this table."""
    held: pa.Table | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < most // 4:
            continue
        keys = np.asarray(held[by].combine_chunks())
        fresh = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(fresh):
            if held.num_rows >= most:  # one group larger than memory should hold
                yield held.combine_chunks(), True
                held, first = None, True
            continue
        cut, begin = int(fresh[-1]), 0
        if first:
            begin = int(fresh[0])
            yield held.slice(0, begin).combine_chunks(), True
            first = False
        if cut > begin:
            yield held.slice(begin, cut - begin).combine_chunks(), False
        held = held.slice(cut)
    if held is not None and held.num_rows:
        keys = np.asarray(held[by].combine_chunks())
        fresh = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        cuts = [0, *([int(fresh[0])] if first and len(fresh) else []), *([int(fresh[-1])] if len(fresh) else []), held.num_rows]
        cuts = sorted(set(cuts))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield held.slice(a, b - a).combine_chunks(), (first and k == 0) or b == held.num_rows


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table[name].combine_chunks())


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by (gram, core, id, th, place): those covered whole (check false), and those to compare."""
    for rows, open_ in _groups(batches, "gram", 1 << 19):
        gram, core = _column(rows, "gram"), _column(rows, "core")
        ident, th, at = (_column(rows, c) for c in ("id", "th", "at"))
        same = (gram[1:] == gram[:-1]) & (core[1:] == core[:-1])
        again = same & (ident[1:] == ident[:-1]) & (th[1:] == th[:-1]) & (at[1:] == at[:-1])  # a repeated row
        head = np.append(True, ~same)
        covered = np.append(False, same & ~again)
        # groups of a gram with two cores or more
        fresh = np.append(True, gram[1:] != gram[:-1])
        number = np.cumsum(fresh) - 1
        cores = np.bincount(number, weights=head)
        check = head & ((cores[number] > 1) | open_)
        # a repeated row of an anchor that is covered is covered too, that of a head is a head's
        keep = np.flatnonzero(covered | check)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ident[keep], th[keep], check[keep], *unpacked(at[keep]))], ["id", "th", "check", "place", "low", "high"])


# ---- suffixes ----


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit characters, by multikey quicksort: three-way splits, the middle one deeper."""
    n, depth = words.shape
    out = np.empty(n, dtype=np.int64)
    stack = [(np.arange(n), 0, 0)]
    while stack:
        rows, level, at = stack.pop()
        if level == depth or len(rows) == 1:
            out[at : at + len(rows)] = rows
            continue
        if len(rows) <= 512:
            out[at : at + len(rows)] = rows[np.lexsort([words[rows, k] for k in range(depth - 1, level - 1, -1)])]
            continue
        chars = words[rows, level]
        pivot = np.partition(chars[:: max(1, len(chars) // 64)], len(chars[:: max(1, len(chars) // 64)]) // 2)[len(chars[:: max(1, len(chars) // 64)]) // 2]
        less, more = rows[chars < pivot], rows[chars > pivot]
        equal = rows[chars == pivot]
        stack += [part for part in ((less, level, at), (equal, level + 1, at + len(less)), (more, level, at + len(less) + len(equal))) if len(part[0])]
    return out


def _ordered(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows, and bytes that each row has in common with the one before it in that order."""
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = matrix
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    unlike = matrix[order[1:]] != matrix[order[:-1]]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    return order, np.append(0, common)


def _compare(rows: pa.Table, open_: bool) -> tuple[list[tuple], list[tuple]]:
    """Spans of windows that are not the first of their kind here; runs of windows that are, if their group is open."""
    ident, th, place, low, high = (_column(rows, c) for c in ("id", "th", "place", "low", "high"))
    earlier = np.lexsort((place, th, ident))
    ident, th, place, low, high = ident[earlier], th[earlier], place[earlier], low[earlier], high[earlier]
    cores = rows["core"].combine_chunks().take(pa.array(earlier))
    data, ends = batch_bytes(cores)
    n = len(ident)
    context = np.zeros((n, REACH + SIZE), dtype=np.uint8)  # the anchor is at REACH
    lengths = high - low + SIZE
    into = np.repeat(np.arange(n) * (REACH + SIZE) + REACH - (place - low) - np.append(0, ends)[:-1], lengths) + np.arange(len(data))
    context.ravel()[into] = data
    right_order, right_common = _ordered(context[:, REACH:])
    left_order, left_common = _ordered(context[:, REACH - 1 :: -1])
    dup, fresh = np.zeros((n, REACH + 2), dtype=bool), np.zeros((n, REACH + 2), dtype=bool)
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for back in range(REACH + 1):  # the window starts so many bytes before the anchor
        valid = np.flatnonzero((place - back >= low) & (place - back <= high))
        if not len(valid) or (len(valid) == 1 and not open_):
            continue
        right_class[right_order] = np.cumsum(right_common < SIZE - back)
        left_class[left_order] = np.cumsum(left_common < back) if back else 0
        _, firsts = np.unique(right_class[valid] * (n + 1) + left_class[valid], return_index=True)
        later = np.ones(len(valid), dtype=bool)
        later[firsts] = False
        dup[valid[later], back] = True
        fresh[valid[firsts], back] = True

    def stretches(marks: np.ndarray) -> tuple[np.ndarray, ...]:
        edge = np.diff(marks.astype(np.int8), axis=1, prepend=0)
        who, begin = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        return who, place[who] - after + 1, place[who] - begin + SIZE

    who, start, stop = stretches(dup)
    spans = (ident[who], th[who], start, stop)
    if not open_:
        return spans, None
    who, start, stop = stretches(fresh)
    at = REACH - place[who]
    sent = [context[k, a:b].tobytes() for k, a, b in zip(who.tolist(), (start + at).tolist(), (stop + at).tolist(), strict=True)]
    return spans, (ident[who], th[who], start, stop, place[who], sent)


_SPAN = "id long, th long, start long, stop long"
#: ``run`` holds the bytes of windows to compare elsewhere, place their anchor; for a span both are null.
_SUFFIXES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("place", pa.int64()), ("run", pa.binary())])


def _sorted_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes sorted by their leading bytes: spans to cut, and runs of windows to compare with other buckets."""
    for rows, open_ in _groups(batches, "gram", BUCKET):
        spans, runs = _compare(rows, open_)
        n = len(spans[0])
        if n:
            yield pa.RecordBatch.from_arrays([*map(pa.array, spans), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_SUFFIXES)
        if runs and len(runs[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(runs, _SUFFIXES, strict=True)], schema=_SUFFIXES)


def _later_runs(runs: DataFrame) -> DataFrame:
    """Spans of windows that another bucket has earlier, from runs (id, th, start, stop, place, run).

    A window starts ``back`` bytes before its anchor, and equal windows have the same back. Every round cuts the runs at
    multiples of its level in back, so equal windows are in runs of one block of backs. Of equal runs the first stays; a
    run is cut further only while another one shares the bytes that all windows of its block have in common.
    """
    found = None
    for size in LEVELS:
        low, high = F.expr(f"place + {SIZE} - stop"), F.expr("place - start")
        cut = runs.withColumn("low", low).withColumn("high", high)
        cut = cut.withColumn("block", F.explode(F.expr(f"sequence(low div {size}, high div {size})")))
        cut = cut.withColumn("first", F.expr(f"greatest(low, block * {size})")).withColumn("last", F.expr(f"least(high, block * {size} + {size - 1})"))
        cut = cut.select("id", "th", "place", "block", F.col("first").alias("back"), F.expr("place - last").alias("start"), F.expr(f"place - first + {SIZE}").alias("stop"), F.expr(f"substring(run, cast(high - last + 1 as int), cast(last - first + {SIZE} as int))").alias("run"))
        # equal runs are one from each bucket at most, so this window is as narrow as the buckets are many
        nth = F.row_number().over(Window.partitionBy("run", "back").orderBy("id", "th", "place"))
        marked = stored(cut.withColumn("nth", nth), "runs")
        later = marked.where("nth > 1").select("id", "th", "start", "stop")
        found = later if found is None else found.unionByName(later)
        if size == 1:
            break
        firsts = marked.where("nth = 1").drop("nth", "back")
        begin, end = f"block * {size}", f"least(block * {size} + {size - 1}, {REACH})"
        common = F.xxhash64("block", F.expr(f"substring(run, cast(place - start - {begin} + 1 as int), cast({SIZE} + {begin} - {end} as int))"))
        firsts = firsts.withColumn("common", common)
        shared = stored(firsts.groupBy("common").count().where("count > 1").select("common"), "shared")
        if shared.isEmpty():
            break
        runs = firsts.join(shared, "common", "left_semi").drop("common", "block")
    return found


# ---- the operator ----

_NULL_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    integer_id(docs, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), text.alias("text"))
    return rows.select("id", F.xxhash64("text").alias("th"), "text")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): for each document that has any, where to cut, as arrays of (start, stop) in bytes."""
    spark = prepared(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    n = partitions(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "core", "id", "th", "at"]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                gram, core, text, place, low, high = anchors(*batch_bytes(part["text"]))
                ids, th = part["id"].to_numpy()[text], part["th"].to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, core, ids, th, packed(place, low, high))], names)

    fields = "id long, th long, check boolean, place long, low long, high long"
    found = texts.mapInArrow(find, "gram long, core long, id long, th long, at long")
    dealt = found.repartitionByRange(n, "gram", "core", "id").sortWithinPartitions("gram", "core", "id", "th", "at")
    anchors_of = dealt.mapInArrow(_resolve, fields).groupBy("id", "th").agg(
        F.collect_set(F.when(F.col("check"), F.struct("place", "low", "high"))).alias("checks"),
        F.collect_set(F.when(~F.col("check"), F.struct(F.col("low").alias("start"), (F.col("high") + SIZE).alias("stop")))).alias("spans"),
    )
    anchors_of = stored(anchors_of, "anchors")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.binary()), ("rest", pa.binary()), ("id", pa.int64()), ("th", pa.int64()), ("place", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("core", pa.binary())])
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in schema.names}
            for i, t, text, checks in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["checks"].to_pylist(), strict=True):
                for c in checks:
                    place, low, high = c["place"], c["low"], c["high"]
                    for name, value in zip(schema.names, (text[place : place + GRAM], text[place + GRAM : high + SIZE], i, t, place, low, high, text[low : high + SIZE]), strict=True):
                        columns[name].append(value)
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    checked = anchors_of.where(F.size("checks") > 0).select(F.col("id").alias("c_id"), F.col("th").alias("c_th"), "checks")
    once = texts.dropDuplicates(["id", "th"])  # else a copy of a row would make its own windows later ones
    unique = once.join(checked.hint("merge"), (F.col("id") == F.col("c_id")) & (F.col("th") == F.col("c_th"))).select("id", "th", "text", "checks")
    suffixes = unique.mapInArrow(contexts, "gram binary, rest binary, id long, th long, place long, low long, high long, core binary")
    bucketed = suffixes.repartitionByRange(n, "gram", "rest").sortWithinPartitions("gram")
    compared = stored(bucketed.mapInArrow(_sorted_suffixes, f"{_SPAN}, place long, run binary"), "compared")
    later = _later_runs(compared.where("run IS NOT NULL"))
    pieces = compared.where("run IS NULL").select("id", "th", "start", "stop").unionByName(later)
    pieces = pieces.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return anchors_of.select("id", "th", "spans").unionByName(pieces).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")).where(F.size("spans") > 0)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans) of every row, with kept_sha256, or else the kept bytes as ``kept``."""
    spans = repeated_spans(docs, id_col, text_col).select(F.col("id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    texts = _keyed(docs, id_col, text_col)
    last, kind = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
                runs = merged(spans or [])
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True))], ["id", "n_bytes", "n_removed", "n_spans", last])

    joined = texts.join(spans.hint("merge"), (F.col("id") == F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("id", "text", "spans")
    done = joined.mapInArrow(cut, f"id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")
    return done.select(F.nullif("id", F.lit(_NULL_ID)).cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", last)
