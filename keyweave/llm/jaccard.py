"""Join of documents whose word shingles overlap by Jaccard similarity, and the classes it makes (operator 9).

A document is the set of its distinct shingles as 64-bit hashes; documents with equal sets are one node.

1. Candidates. Two sets with similarity t or more differ in at most D elements, D following from their sizes. Hash
   space is cut into D + 3 ranges, so such sets agree on three ranges at least. A set has one signature for each range
   (and size class, its own and the next); sharing a signature makes two sets candidates. Sets that share a signature
   are tied to the first of them (a star, not all pairs), and the components of these ties are closed under links.
   At low similarities ranges hold few shingles, so a shared passage would tie everything; then candidates come from
   prefixes (3.) of all documents at once.
2. Links, inside each such block of candidates, by T-occurrence search: sets go by size, each is a query against the
   inverted lists of those before it. A set similar to it shares T elements; of its lists the T - 1 longest are left
   aside, the short ones merged (with a heap, or by counting where they are many), and the sets met there, likeliest
   first, are looked up in the long lists by binary search. Once a set has joined a class, the rest of that class is
   skipped, and sets that others were linked to lately are tried before any merge; after PROBES vain look-ups all lists
   are merged. A link found by hashes is confirmed on the words.
3. Documents of a block with more than UNIT shingles in all (shared passages can chain many) are tied anew, by prefixes:
   with shingles ordered by how many of these documents have them, rare ones first, similar sets share one among their
   first |x| - T + 1. Components of those ties are the blocks then. Any order of shingles will do, as long as all sets
   use the same; so those that a sample shows to be very common come last, uncounted, and no task counts them.
4. A block that is still too large is cut into chunks; each pair of chunks is a unit of work, and the ties found are
   contracted again. So no task holds more than UNIT shingles, and no candidate is dropped.

Defined results: null texts count as empty; a set without shingles is empty and linked with nothing, its class is its
own id; where an id repeats, each row has the class of its text; a null id counts as smaller than any other; an empty
table gives an empty table; extra columns are ignored. Sets are named by 64 bits; a second, unrelated name shows whether
two sets share one, and then all are named anew.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, batch_bytes, byte_class, mix, partitions, prepared, stored, word_hashes
from .components import connected

WORD = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
#: Shingles that a unit of work may hold; ranges beyond those that can differ, less one.
UNIT, SPARE = 2_000_000, 2
#: Shingles that a range must hold on average for signatures to tell documents apart that merely share a passage.
RANGE = 8
#: Look-ups of candidates in long lists before all lists are merged; entries of short lists that a heap merges.
PROBES, HEAP, RECENT = 16, 48, 4
#: Documents looked at, and shingles kept, to find the very common ones; seeds of names that are tried.
SAMPLE, COMMON, SEEDS = 4_000, 4096, 4
_STEP = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(0xA0761D6478BD642F)


# ---- sets ----


def shingle_sets(texts: pa.Array, width: int, family: int = 0) -> list[np.ndarray]:
    """For each text its distinct shingles, as sorted hashes of a family."""
    data, ends = batch_bytes(texts)
    words, _, _, owner = word_hashes(data, ends, WORD, family)
    first = np.searchsorted(owner, np.arange(len(ends) + 1))
    rolled = words.copy()
    for k in range(1, width):
        rolled[: len(words) - k] = mix(rolled[: len(words) - k] * _STEP + words[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                whole = mix(whole * _STEP + w)
            out.append(whole)
        else:
            out.append(words[:0])
    return out


def node_of(s: np.ndarray, seed: int = 0) -> int:
    """A 64-bit name of a set."""
    return int((mix(mix(s ^ (_EMPTY + np.uint64(seed))).sum(dtype=np.uint64).reshape(1) + np.uint64(len(s)))).view(np.int64)[0])


_LOWER = bytes(LOWER.tolist())
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def spelled_shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text as words."""
    words = [w for w in _SPACES.split(text.translate(_LOWER)) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def alike(a: bytes, b: bytes, width: int, percent: int) -> bool:
    """Whether two texts are linked, by their words."""
    x, y = spelled_shingles(a, width), spelled_shingles(b, width)
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


# ---- signatures ----


class Classes:
    """Size classes and what two sets of a class, or of a class and the one before, can differ in."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]
        self.bounds: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        """The class of a size; class j holds the sizes from tops[j - 1] + 1 to tops[j]."""
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * 100 // self.percent))
        return int(np.searchsorted(self.tops, size))

    def differ(self, j: int) -> int:
        self.of(self.tops[-1] + 1) if j >= len(self.tops) else None
        return 2 * self.tops[j] * (100 - self.percent) // (100 + self.percent)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        total = np.append(np.uint64(0), np.cumsum(mix(s), dtype=np.uint64))
        own, found = self.of(len(s)), []
        for j in (own, own + 1):
            d = self.differ(j)
            if not d:
                continue  # only equal sets are similar, and they are one node
            m = d + 1 + SPARE
            if m not in self.bounds:
                self.bounds[m] = np.array([(k << 64) // m for k in range(1, m)], dtype=np.uint64)
            cut = np.concatenate([[0], np.searchsorted(s, self.bounds[m]), [len(s)]])
            names = mix(np.arange(m, dtype=np.uint64) + np.uint64(j << 32))
            keys = mix((total[cut[1:]] - total[cut[:-1]]) ^ names)
            empty = cut[1:] == cut[:-1]
            found.append(keys[~empty])
            if empty.sum() > SPARE:  # all ranges that agree may be empty ones
                found.append(mix(names[empty] ^ _EMPTY))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


# ---- T-occurrence search ----


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))


def _merged(lists: np.ndarray, begins: np.ndarray, sizes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from low to high - 1 in these ascending lists, and in how many lists each is."""
    total = int(sizes.sum())
    if total <= HEAP:
        runs = [lists[a : a + n].tolist() for a, n in zip(begins.tolist(), sizes.tolist(), strict=True) if n]
        found = [(y, len(list(same))) for y, same in groupby(heapq.merge(*runs)) if y >= low]
        return np.array([y for y, _ in found], dtype=np.int64), np.array([t for _, t in found], dtype=np.int64)
    met = lists[_expand(begins, sizes)]
    met = met[met >= low]
    if len(met) * 8 < high - low:
        met, times = np.unique(met, return_counts=True)
        return met.astype(np.int64), times
    times = np.bincount(met - low, minlength=high - low)
    met = np.flatnonzero(times)
    return met + low, times[met]


def _held_by(lists: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: int) -> int:
    """How many of these ascending lists hold a number: a binary search in all of them at once."""
    low, high = begins.copy(), ends.copy()
    for _ in range(int((ends - begins).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (lists[np.minimum(middle, len(lists) - 1)] < wanted) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    there = low < ends
    return int((lists[low[there]] == wanted).sum())


def classes_in(sets: list[np.ndarray], percent: int, confirm: Callable[[int, int], bool] = lambda x, y: True) -> np.ndarray:
    """For each set the number of a member of its class of linked sets, the same for all members.

    ``confirm`` has the last word on a link that hashes show.
    """
    n = len(sets)
    root = np.arange(n)  # of each set, always that of its class
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    at = np.append(0, np.cumsum(sizes))
    tokens = np.concatenate([np.zeros(0, dtype=np.uint64), *(sets[i] for i in order)])
    by_token = np.argsort(tokens, kind="stable").astype(np.int32)
    lists = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_token]  # each inverted list ascends
    tokens = tokens[by_token]
    numbers = np.arange(len(tokens), dtype=np.int32)
    list_start = np.maximum.accumulate(np.where(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)], numbers, 0)) if n else numbers
    del tokens
    place = np.empty_like(numbers)
    place[by_token] = numbers
    del by_token

    recent: list[int] = []  # sets that others were linked to lately

    def tied(x: int, y: int) -> bool:
        if not confirm(int(order[x]), int(order[y])):
            return False
        root[root == root[x]] = root[y]
        if y in recent:
            recent.remove(y)
        recent.insert(0, y)
        del recent[RECENT:]
        return True

    for x in range(1, n):
        size = int(sizes[x])
        need = -(-percent * size // 100)  # T: any similar set, not larger, shares so many
        low = int(np.searchsorted(sizes[:x], need))
        if low == x or not size:
            continue
        ends = place[at[x] : at[x + 1]].astype(np.int64)
        begins = list_start[ends].astype(np.int64)
        held = ends - begins
        long = np.zeros(size, dtype=bool)
        if need > 1:
            long[np.argpartition(held, size - need + 1)[size - need + 1 :]] = True
        for y in list(recent):
            if y >= low and root[y] != root[x] and 100 * (shared := _held_by(lists, begins, ends, y)) >= percent * (size + int(sizes[y]) - shared):
                tied(x, y)
        if (root[low:x] == root[x]).all():
            continue
        met, times = _merged(lists, begins[~long], held[~long], low, x)
        wanted = -(-percent * (size + sizes[met]) // (100 + percent))
        able = (times + need - 1 >= wanted) & (root[met] != root[x])
        met, times, wanted = met[able], times[able], wanted[able]
        long_begins, long_ends, vain = begins[long], ends[long], 0
        while len(met):
            if vain == PROBES:
                shared = np.bincount(lists[_expand(begins, held)], minlength=x)[met]
                good = shared >= wanted
                met, times, wanted, vain = met[good], shared[good], wanted[good], vain + 1
                continue
            likely = int(times.argmax())
            y = int(met[likely])
            linked = vain > PROBES or int(times[likely]) + _held_by(lists, long_begins, long_ends, y) >= int(wanted[likely])
            if linked and tied(x, y):
                rest = root[met] != root[x]
            else:
                vain += vain < PROBES
                rest = np.arange(len(met)) != likely
            met, times, wanted = met[rest], times[rest], wanted[rest]
    out = np.empty(n, dtype=np.int64)
    out[order] = order[root]
    return out


# ---- the join ----


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield part, shingle_sets(part["text"], width)


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(id, n_shingles, component_id) of every row; two sets link when 100 * shared >= percent * all."""
    spark = prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            others = [node_of(s) for s in shingle_sets(batch["text"], width, family=1)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([node_of(s, seed) for s in sets], pa.int64()), pa.array(others, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["id", "node", "other", "n"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(percent), set()
        for _, sets in _sets(batches, width):
            nodes, keys = [], []
            for s in sets:
                node = node_of(s, seed)
                if len(s) and node not in seen:
                    seen.add(node)
                    keys.append(classes.signatures(s))
                    nodes.append(node)
            if len(seen) > 1_000_000:
                seen.clear()
            counts = [len(k) for k in keys]
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(nodes, dtype=np.int64), counts))], ["key", "node"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit: a block, or two chunks of a large one."""
        held: dict[int, np.ndarray] = {}
        spelled: list[bytes] = []
        current = None

        def ties() -> pa.RecordBatch:
            names = np.array(list(held), dtype=np.int64)
            found = classes_in(list(held.values()), percent, lambda x, y: alike(spelled[x], spelled[y], width, percent))
            tied = found != np.arange(len(names))
            return pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[found[tied]])], ["a", "b"])

        for batch, sets in _sets(batches, width):
            units = zip(batch["block"].to_pylist(), batch["one"].to_pylist(), batch["two"].to_pylist(), strict=True)
            raw = batch["text"].cast(pa.binary())
            for k, (u, node, s) in enumerate(zip(units, batch["node"].to_pylist(), sets, strict=True)):
                if u != current:
                    if len(held) > 1:
                        yield ties()
                    held, spelled, current = {}, [], u
                if node not in held and node_of(s, seed) == node:  # else another text under the same id
                    held[node] = s
                    spelled.append(raw[k].as_py())
        if len(held) > 1:
            yield ties()

    for seed in range(SEEDS):  # noqa: B007  the functions above use it
        rows = stored(texts.mapInArrow(name, f"id {kind}, node long, other long, n long"), "sets")
        nodes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("unnamed"), F.first("n").alias("n"), (F.min("other") != F.max("other")).alias("two"))
        nodes = stored(nodes.withColumn("first", F.when(F.col("unnamed"), F.lit(None)).otherwise(F.col("first"))).drop("unnamed"), "nodes")
        if nodes.where("two").isEmpty():
            break
    else:
        raise ValueError("sets share names with every seed")
    rows, nodes = rows.drop("other"), nodes.drop("two")

    own = texts.select("text", F.lit(0).alias("id"))
    if RANGE * 2 * (100 - percent) <= 100 + percent:
        signed = "key long, node long"
        blocks = connected(_ties(own.mapInArrow(sign, signed), _common(own.sample(_share(rows), seed=1).mapInArrow(sign, signed))))
    else:
        shingles = lambda some: some.mapInArrow(_exploded(width, False, seed), "key long, node long")
        common = _common(shingles(own.sample(_share(rows), seed=1)))
        blocks = connected(_ties(_prefixes(shingles(own), nodes, percent, common), common))
    members = stored(blocks.join(nodes, "node").select("node", F.col("root").alias("block"), "first", "n"), "members")
    sizes = members.groupBy("block").agg(F.sum("n").alias("total"))
    large = sizes.where(F.col("total") > unit).select("block")
    if RANGE * 2 * (100 - percent) <= 100 + percent and not large.isEmpty():
        rest = members.join(large, "block", "left_anti")
        wide = stored(members.join(large, "block", "left_semi"), "large")
        shingles = lambda some: _with_texts(texts, some.select("node", "first")).mapInArrow(_exploded(width, True, seed), "key long, node long")
        common = _common(shingles(wide.sample(_share(wide), seed=1)))
        tied = connected(_ties(_prefixes(shingles(wide), wide, percent, common), common))
        again = tied.join(wide.drop("block"), "node").select("node", F.col("root").alias("block"), "first", "n")
        members = stored(rest.select("node", "block", "first", "n").unionByName(again), "members")
        sizes = members.groupBy("block").agg(F.sum("n").alias("total"))
    # two chunks make a unit
    sizes = sizes.select("block", F.when(F.col("total") > unit, F.ceil(2 * F.col("total") / unit)).otherwise(1).cast("int").alias("chunks"))
    units = members.join(sizes, "block")
    if not sizes.where("chunks > 1").isEmpty():
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        units = units.withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        units = units.select("node", "block", "first", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    else:
        units = units.select("node", "block", "first", F.lit(0).alias("one"), F.lit(0).alias("two"))
    work = _with_texts(texts, units)
    work = work.repartition(partitions(spark), "block", "one", "two").sortWithinPartitions("block", "one", "two")
    ties = stored(work.mapInArrow(search, "a long, b long"), "ties")
    roots = connected(ties)
    firsts = roots.join(nodes.select("node", "first"), "node")
    # a null counts as smallest
    least = firsts.groupBy("root").agg(F.min("first").alias("least"), F.max(F.col("first").isNull()).alias("unnamed"))
    least = least.select("root", F.when(F.col("unnamed"), F.lit(None)).otherwise(F.col("least")).alias("least"))
    named = nodes.join(roots, "node", "left").join(least, "root", "left").select("node", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component"))
    # stored, so that an adaptive join can split the copies of a hot set
    joined = rows.join(stored(named, "named"), "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _with_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the text of their first document; dealt by id at every size, so that the plan is the same for any corpus."""
    return texts.join(nodes.hint("merge"), F.col("id").eqNullSafe(F.col("first"))).drop("id", "first")


def _ties(keys: DataFrame, common: list[int]) -> DataFrame:
    """Edges (a, b) from (key, node): what shares a key is tied to the first of it, or, if the key is common, to the key.

    A common key is thus one more node of the graph and its rows are dealt by key and node, so no task has them all.
    """
    rows = _spread(keys, common).repartition(partitions(keys.sparkSession), "key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(_stars, "a long, b long").distinct()


def _spread(rows: DataFrame, common: list[int]) -> DataFrame:
    """The key of a row that has a common one is that of key and node; the common one is in ``often``, else null."""
    if not common:
        return rows.withColumn("often", F.lit(None).cast("long"))
    rows = rows.withColumn("often", F.when(F.col("key").isin(common), F.col("key")))
    return rows.withColumn("key", F.when(F.col("often").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node")))


def _share(counted: DataFrame) -> float:
    """The share of rows that makes a sample of SAMPLE."""
    return min(1.0, SAMPLE / max(1, counted.count()))


def _common(sampled: DataFrame) -> list[int]:
    """Up to COMMON keys that the most rows of a sample have: a bounded guess, used to balance work only."""
    least = max(3, SAMPLE // (8 * partitions(sampled.sparkSession)))
    found = sampled.groupBy("key").count().where(F.col("count") >= least).orderBy(F.col("count").desc(), "key").limit(COMMON)
    return [r.key for r in found.collect()]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, node): each further node of a key with the first one; a common key's nodes with the key."""
    last_key, center = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
        fresh = np.append(last_key is None or keys[0] != last_key, keys[1:] != keys[:-1])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        centers = np.where(at >= 0, nodes[np.maximum(at, 0)], center if center is not None else 0)
        last_key, center = keys[-1], centers[-1]
        often = batch["often"].is_valid().to_numpy(zero_copy_only=False)
        centers = np.where(often, batch["often"].fill_null(0).to_numpy(), centers)
        apart = centers != nodes
        if apart.any():
            pairs = np.unique(np.column_stack([nodes[apart], centers[apart]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _exploded(width: int, named: bool, seed: int):
    """A function of batches that gives (key, node): every shingle of every set; named: of these nodes only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            held = [(node_of(s, seed), s) for s in sets if len(s)]
            if named:
                held = [(node, s) for node, s in zip(batch["node"].to_pylist(), sets, strict=True) if node_of(s, seed) == node]
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *(s for _, s in held)]).view(np.int64)
            sizes = [len(s) for _, s in held]
            names = np.array([n for n, _ in held], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(names, sizes))], ["key", "node"])

    return run


def _prefixes(rows: DataFrame, sizes: DataFrame, percent: int, common: list[int]) -> DataFrame:
    """(key, node) of the shingles that a set must share one of with any similar set, by how rare they are among these.

    Rows may repeat (documents with equal sets); ``sizes`` has n, the shingles of each node; ``shared`` are a set's shingles that other documents have too. Those in
    ``common`` come last in the order of all sets, so they need no count.
    """
    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (node, df, key, n) sorted by node, df and key, without shingles of one document: the first ones."""
        last, left = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n, shared = (batch[c].to_numpy() for c in ("node", "n", "shared"))
            fresh = np.append(node[0] != last, node[1:] != node[:-1])
            first = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            # |x| - T + 1 places, the rarest shingles (of one document) have taken theirs
            room = n - -(-percent * n // 100) + 1 - (n - shared)
            nth = np.arange(len(node)) - np.append(0, first)[group + 1] if len(first) else np.arange(len(node))
            carried = group < 0
            nth = np.where(carried, np.arange(len(node)) + left, nth)
            keep = nth < room
            last = node[-1]
            left = int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch["key"].filter(pa.array(keep)), batch["node"].filter(pa.array(keep))], ["key", "node"])

    n = partitions(rows.sparkSession)
    counted = _spread(rows, common).withColumn("df", F.count("*").over(Window.partitionBy("key")))
    counted = counted.select(F.coalesce("often", "key").alias("key"), "node", F.when(F.col("often").isNull(), F.col("df")).otherwise(1 << 62).alias("df")).where("df > 1")
    once = counted.repartition(n, "node").dropDuplicates(["node", "key"])
    by_node = once.join(sizes.select("node", "n").hint("merge"), "node").withColumn("shared", F.count("*").over(Window.partitionBy("node")))
    return by_node.select("node", "df", "key", "n", "shared").sortWithinPartitions("node", "df", "key").mapInArrow(shortest, "key long, node long")


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of linked documents, the one with the smallest id, with all its columns.

    Of rows that repeat an id and a text one stays; texts that differ under the smallest id of a class all stay.
    """
    named = similarity_classes(docs.select(f"`{id_col}`", f"`{text_col}`"), width, percent, id_col, text_col)
    first = named.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("stay")).agg(F.count("*").alias("rows"))
    first = stored(first, "stay")
    kept = docs.join(first, docs[id_col].eqNullSafe(first["stay"]), "left_semi")
    # ids seldom repeat, and then texts need not be dealt anew
    return kept if first.where("rows > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])
