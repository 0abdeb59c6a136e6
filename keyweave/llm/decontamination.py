"""Benchmark decontamination with an FM-index per training shard (operator 7).

A shard is a slice of documents in a task. Its words become symbols of the benchmark's vocabulary; words outside it are
separators, and stretches shorter than the shortest window are left out, since no window lies in them. What remains is
indexed: suffix array, Burrows-Wheeler transform, ranks in a wavelet matrix, and every eighth text position sampled.
All windows of the benchmark are searched backwards at once, their occurrences located from the sampled positions, and
overlapping ones merged into spans of words and of bytes.

The benchmark is the stated query set. Its items are cut into pieces of PIECE words that overlap, so that no window is
lost, and searched in blocks of about BLOCK_BYTES (by a hash of the piece), one narrow pass over the documents for each
block, so what the driver and a task hold has a bound at any size of benchmark or item; nothing is shuffled.

Words are looked up by hash and then compared byte by byte with the word of the vocabulary. Windows with the same items
share one list of items; documents meet a list once, however many of its windows they hold.

Defined results: null or empty texts have no words, no hits and are clean; an item without words has no window; items
that repeat an item_id count as one item; a null item_id is named by the empty string; repeated documents each give a
row; empty tables give an empty or clean result; other columns of documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, batch_bytes, byte_class, prepared, word_hashes

WORD = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Words of a benchmark item in Spark: lower-cased by ASCII, runs of letters, digits and all beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of benchmark texts and names searched in one pass; windows that begin in a piece of an item.
BLOCK_BYTES, PIECE = 4 << 20, 2000
#: Bytes of documents in a shard; distance of sampled positions; pairs of document and item held at a time.
SHARD_BYTES, SAMPLE, PAIRS = 4 << 20, 8, 1 << 20


class FMIndex:
    """Backward search in a sequence of symbols from 1 on; 0 separates and is never searched."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols.astype(np.int64) + 1, 0)
        self.n = len(text)
        order = self._suffixes(text)
        self.bwt = text[order - 1]
        self.width = max(1, int(text.max()).bit_length())
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=1 << self.width)))
        self.levels: list[tuple[int, np.ndarray]] = []
        row = self.bwt
        for bit in range(self.width - 1, -1, -1):
            ones = (row >> bit) & 1
            self.levels.append((int(self.n - ones.sum()), np.append(0, np.cumsum(ones))))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        sampled = order % SAMPLE == 0
        self.sampled, self.samples, self.number = sampled, order[sampled], np.cumsum(sampled) - 1

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array, by prefix doubling."""
        n, k = len(text), 1
        order = np.argsort(text, kind="stable")
        while True:
            if k == 1:
                key = text
            else:
                after = np.zeros(n, dtype=np.int64)
                after[: n - k // 2] = rank[k // 2 :] + 1
                key = rank * (n + 1) + after
                order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
            if rank[order[-1]] == n - 1:
                return order
            k *= 2

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often a symbol occurs in the transform before end."""
        start = np.zeros_like(end)
        for (zeros, ones), bit in zip(self.levels, range(self.width - 1, -1, -1), strict=True):
            up = ((symbol >> bit) & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (one a row, of equal length) among the sorted suffixes."""
        codes = patterns + 1
        low, high = np.zeros(len(codes), dtype=np.int64), np.full(len(codes), self.n)
        live = np.flatnonzero((codes < 1 << self.width).all(axis=1))
        high[np.setdiff1d(np.arange(len(codes)), live)] = 0
        for j in range(codes.shape[1] - 1, -1, -1):
            c = codes[live, j]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back by last-to-first steps to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        left = np.flatnonzero(~self.sampled[rows])
        while len(left):
            c = self.bwt[rows[left]]
            rows[left] = self.before[c] + self.rank(c, rows[left])
            steps[left] += 1
            left = left[~self.sampled[rows[left]]]
        return self.samples[self.number[rows]] + steps


class Windows(NamedTuple):
    """The windows of a block of the benchmark, as symbols, and the items they are from."""

    family: int  # of the hashes
    vocabulary: np.ndarray  # sorted hashes; symbol k is vocabulary[k - 1]
    spelling: np.ndarray  # bytes of the vocabulary's words, one after the other
    spelled: np.ndarray  # where each begins, and the end
    shortest: int
    patterns: list[tuple[np.ndarray, np.ndarray]]  # of equal lengths: distinct windows, and the list of items of each
    first: np.ndarray  # list k is members[first[k] : first[k + 1]]
    members: np.ndarray
    items: list[str]


def windows(items: list[tuple[str, str]], size: int = 10) -> Windows:
    """Of (name, text); two words of equal hash move all to another family of hashes."""
    names = sorted({name for name, _ in items})
    place = {name: k for k, name in enumerate(names)}
    raw = [np.frombuffer((text or "").encode(), dtype=np.uint8) for _, text in items]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    data = np.concatenate([np.zeros(0, dtype=np.uint8), *raw])
    for family in range(8):
        hashes, begin, stop, owner = word_hashes(data, ends, WORD, family)
        vocabulary, sample, symbol = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (stop - begin)[sample]
        spelled = np.append(0, np.cumsum(lengths))
        spelling = LOWER[data[_expand(begin[sample], lengths)]]
        if _spelled_so(data, begin, stop, symbol, spelling, spelled).all():
            break
    else:
        raise ValueError("words of the benchmark collide in every family of hashes")
    head = np.searchsorted(owner, np.arange(len(items) + 1))
    words = np.diff(head)
    item = np.array([place[name] for name, _ in items], dtype=np.int64)
    patterns, lists, known = [], [], {}
    for n in np.unique(np.minimum(words[words > 0], size)).tolist():
        texts = np.flatnonzero(np.minimum(words, size) == n)
        count = words[texts] - n + 1
        at = _expand(head[texts], count)
        rows = np.ascontiguousarray((symbol[at[:, None] + np.arange(n)] + 1).astype(np.int32))
        distinct, which = np.unique(rows.view(f"V{4 * n}").ravel(), return_inverse=True)
        pairs = np.unique(which * max(1, len(names)) + np.repeat(item[texts], count))
        which, members = pairs // max(1, len(names)), pairs % max(1, len(names))
        cuts = np.searchsorted(which, np.arange(len(distinct) + 1)).tolist()
        number = np.empty(len(distinct), dtype=np.int64)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            key = members[a:b].tobytes()
            if key not in known:
                known[key] = len(lists)
                lists.append(members[a:b])
            number[k] = known[key]
        patterns.append((distinct.view(np.int32).reshape(-1, n).astype(np.int64), number))
    first = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    members = np.concatenate([np.zeros(0, dtype=np.int64), *lists])
    return Windows(family, vocabulary, spelling, spelled, min((p.shape[1] for p, _ in patterns), default=0), patterns, first, members, names)


def _spelled_so(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, at: np.ndarray, spelling: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """Whether each word data[begin:stop] has, but for case, the bytes of word ``at`` of a vocabulary."""
    right = stop - begin == spelled[at + 1] - spelled[at]
    same = np.flatnonzero(right)
    sizes = np.cumsum((stop - begin)[same])
    k = 0
    while k < len(same):  # a megabyte or a word at a time
        to = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + (1 << 20))))
        part = same[k:to]
        n = (stop - begin)[part]
        unlike = LOWER[data[_expand(begin[part], n)]] != spelling[_expand(spelled[at[part]], n)]
        right[part] = ~np.logical_or.reduceat(unlike, np.append(0, np.cumsum(n)[:-1]))
        k = to
    return right


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))


def occurrences(texts: pa.Array, w: Windows) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], tuple[np.ndarray, np.ndarray]]:
    """For the texts of a shard: words of each, its merged hits as (first word, end word, first byte, end byte), and
    the distinct pairs (text, list of items) that occur."""
    data, ends = batch_bytes(texts)
    n = len(ends)
    hashes, begin, stop, owner = word_hashes(data, ends, WORD, w.family)
    words = np.bincount(owner, minlength=n)
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    if not len(w.vocabulary) or not len(hashes):
        return words, spans, none
    at = np.minimum(np.searchsorted(w.vocabulary, hashes), len(w.vocabulary) - 1)
    known = w.vocabulary[at] == hashes
    first, size = _stretches(known, owner, w.shortest)
    held = _expand(first, size)
    spelled = _spelled_so(data, begin[held], stop[held], at[held], w.spelling, w.spelled)
    if not spelled.all():
        known[held[~spelled]] = False
        first, size = _stretches(known, owner, w.shortest)
    if not len(first):
        return words, spans, none
    # laid out with a separator after each
    word_of = _expand(first, size + 1)
    last = np.cumsum(size + 1) - 1
    word_of[last] = -1
    index = FMIndex(np.where(word_of < 0, 0, at[word_of] + 1))
    hit = np.zeros(len(hashes) + 1, dtype=np.int64)
    pairs, lists = [], len(w.first)
    for patterns, number in w.patterns:
        low, high = index.search(patterns)
        count = high - low
        word = word_of[index.locate(_expand(low, count))]
        np.add.at(hit, word, 1)
        np.add.at(hit, word + patterns.shape[1], -1)
        pairs.append(np.unique(owner[word] * lists + np.repeat(number, count)))
    covered = np.cumsum(hit)[:-1] > 0
    start = covered & ~np.append(False, covered[:-1] & (owner[1:] == owner[:-1]))
    end = covered & ~np.append(covered[1:] & (owner[1:] == owner[:-1]), False)
    head = np.searchsorted(owner, np.arange(n))
    text_at = np.append(0, ends)
    for a, b in zip(np.flatnonzero(start).tolist(), np.flatnonzero(end).tolist(), strict=True):
        k = int(owner[a])
        spans[k].append((a - int(head[k]), b + 1 - int(head[k]), int(begin[a] - text_at[k]), int(stop[b] - text_at[k])))
    pairs = np.unique(np.concatenate(pairs))
    return words, spans, (pairs // lists, pairs % lists)


def _stretches(known: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of runs of known words of one text, not shorter than the shortest window."""
    same = owner[1:] == owner[:-1]
    first = np.flatnonzero(known & ~np.append(False, known[:-1] & same))
    size = np.flatnonzero(known & ~np.append(known[1:] & same, False)) + 1 - first
    return first[size >= shortest], size[size >= shortest]


def _named(n: int, pairs: tuple[np.ndarray, np.ndarray], w: Windows) -> Iterator[tuple[int, int, list[list[str]]]]:
    """The items of texts 0 to n - 1, sorted, as (from, to, lists of names): so many texts at a time as hold PAIRS."""
    text, number = pairs
    size = w.first[number + 1] - w.first[number]
    load = np.cumsum(np.bincount(text, weights=size, minlength=n)) if n else np.zeros(0)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + PAIRS, side="right")))
        a, b = np.searchsorted(text, [at, to])
        members = w.members[_expand(w.first[number[a:b]], size[a:b])]
        both = np.unique(np.repeat(text[a:b] - at, size[a:b]) * max(1, len(w.items)) + members)
        found: list[list[str]] = [[] for _ in range(to - at)]
        for pair in both.tolist():
            found[pair // len(w.items)].append(w.items[pair % len(w.items)])
        yield at, to, found
        at = to


SPAN = "struct<first_word:long,end_word:long,first_byte:long,end_byte:long>"


def _merge(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] < out[-1][1]:
            out[-1] = (*out[-1][:1], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def _shards(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SHARD_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, result: str = "spans") -> DataFrame:
    """The other columns of docs as struct ``doc``, ``n_words``, merged ``spans``, the sorted names of ``items``; the text if asked.

    ``result``: spans; text (the text besides); or cut, where the text has every hit span replaced by one blank, and documents
    without another word are left out.
    """
    prepared(docs.sparkSession)
    queries = _pieces(benchmark, size, item_col, item_text_col)
    total = queries.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    out = docs.select(F.struct(*others).alias("doc"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for k in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("name", "piece"), F.lit(blocks)) == k).select("name", "text").collect()  # a bounded part of the query set
        search = docs.sparkSession.sparkContext.broadcast(windows([tuple(r) for r in block], size))
        last = k == blocks - 1
        schema = StructType([f for f in out.schema if not (last and result == "spans" and f.name == "text")])

        def run(batches: Iterator[pa.RecordBatch], search=search, names=tuple(schema.names), begun=k > 0, cut=last and result == "cut") -> Iterator[pa.RecordBatch]:
            w = search.value
            for batch in batches:
                at = 0
                for shard in _shards(batch["text"]):
                    words, spans, pairs = occurrences(shard, w)
                    for a, b, items in _named(len(shard), pairs, w):
                        part = batch.slice(at + a, b - a)
                        yield _extended(part, words[a:b].tolist(), spans[a:b], items, names, begun, cut)
                    at += len(shard)

        out = out.mapInArrow(run, schema)
    return out


def _pieces(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(name, piece, text): the words of each item, in pieces that share size - 1 words with the next."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWERED)
    words = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.regexp_extract_all(lowered, F.lit(f"({WORD_PATTERN})")).alias("words"))
    pieces = words.where("size(words) > 0").withColumn("piece", F.explode(F.expr(f"sequence(0, greatest(0, (size(words) - {size}) div {PIECE}))")))
    return pieces.select("name", "piece", F.array_join(F.expr(f"slice(words, cast(piece * {PIECE} + 1 as int), {PIECE + size - 1})"), " ").alias("text"))


def _extended(batch: pa.RecordBatch, words: list[int], spans: list, items: list, names: tuple[str, ...], begun: bool, cut: bool) -> pa.RecordBatch:
    """A batch with what this block found beside what earlier ones did."""
    kind = batch.schema.field("spans").type
    fields = [f.name for f in kind.value_type]
    if begun:
        earlier = [[tuple(s[f] for f in fields) for s in row] for row in batch["spans"].to_pylist()]
        spans = [_merge(a + b) for a, b in zip(earlier, spans, strict=True)]
        items = [sorted({*a, *b}) for a, b in zip(batch["items"].to_pylist(), items, strict=True)]
    new = {"n_words": pa.array(words, pa.int64()), "spans": pa.array([[dict(zip(fields, s, strict=True)) for s in row] for row in spans], kind), "items": pa.array(items, batch.schema.field("items").type)}
    if cut:
        new["text"] = _cut(batch["text"], spans)
    done = pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in names], names)
    if cut:
        done = done.filter(pa.array([not row or sum(s[1] - s[0] for s in row) < n for row, n in zip(spans, words, strict=True)], pa.bool_()))
    return done


def _cut(texts: pa.Array, spans: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    if not any(spans):
        return texts
    out = texts.to_pylist()
    for k, row in enumerate(spans):
        if row:
            raw, parts, at = out[k].encode(), [], 0
            for _, _, first, end in row:
                parts.append(raw[at:first])
                at = end
            out[k] = b" ".join([*parts, raw[at:]]).decode()
    return pa.array(out, texts.type)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    names = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(F.col(f"doc.{id_col}"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents, all columns, with hit spans cut out of the texts; where a text is cut, ``length_col`` is set anew."""
    found = find(docs, benchmark, size, text_col, result="cut", **options)

    def column(c: str):
        if c == text_col:
            return F.col("text").alias(c)
        own = F.col(f"doc.`{c}`")
        return (F.when(F.size("spans") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own) if c == length_col else own).alias(c)

    return found.select(*map(column, docs.columns))
