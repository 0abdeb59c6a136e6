"""Token ids as Arrow IPC files of equal-length sequences (operator 10).

The ids of all documents, in ascending order of their ids, each followed by an end id, are laid end to end and cut into
sequences. A file holds record batches with two fixed-size-list columns, ``ids`` and ``mask`` (false on padding), so
sequence i of a memory-mapped file is an offset away: nothing is copied or parsed. A second record-batch file beside it
lists the documents (doc_id, first id within the file, number of ids). A file pads only its own last sequence.

Texts are range-partitioned by doc_id before they are tokenised, so only texts are shuffled, and each task writes one
pair of files under a name of its own and renames it at the end: a retried or speculative task leaves the same files.
Ids are stored in 16 bits if the vocabulary allows, else 32.

Defined results: a null text counts as empty and is one end id; a null doc_id sorts first; repeated rows are written
once each; an empty table gives no documents; extra columns are ignored. ``files`` must be an URI that pyarrow.fs can
write (file, s3, gs, hdfs with libhdfs), shared by all machines.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import integer_id, prepared

LONGEST = 64
#: Sequences in a record batch.
BATCH = 1024
MANIFEST = "part int, name string, n_docs long, n_tokens long"
#: Letters of Latin scripts, lower case; anything outside ASCII and these scripts; what ends a word after its letters.
_LETTERS = re.compile("[a-zß-öø-ɏ]+").fullmatch
_OTHER = re.compile("[^\\x00-\u00a9\u00ab-\u0129\u0131-\u024f]").search
_STOPS = re.compile(r"(?<=[a-zß-öø-ɏ])([!-/:-@\[-`{-~]+)(?=[ \n]|\Z)")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct word met once in a while.

    Only for tokenizers that drop white space first, so that what stands between blanks is independent (checked on the
    tokenizer's description and on samples); else whole texts are encoded. Where a text has Latin letters only, it is
    lowered and marks at the ends of words are set off first, which such a tokenizer does anyhow, so fewer words are
    distinct; and new words of letters alone are encoded many at a time and told apart by their word-end tokens.

    The words known are two generations of ``entries`` at most: those not met since the older one was young are dropped.
    """

    def __init__(self, path: str, entries: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.entries = Tokenizer.from_file(path), entries
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        rules = json.loads(self.model.to_str())
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers") or []]
        suffix = rules["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        ids = lambda text: self.model.encode(text, add_special_tokens=False).ids
        parts = ("ab", "Ab,", "é", "Σ.", "'", "5", "", "n't", "s", "\u0301x", "b...", "<|a")
        self.by_word = first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed" and all(ids(a + c + b) == ids(a) + ids(b) for a in parts for b in parts for c in (" ", "\n", " \n "))
        self.lowers = self.by_word and "Lowercase" in steps and all(ids(f"x{a}{p} y") == ids(f"x{a.lower()} {p} y") for a in ("b", "É", "ß", "Ž", "'S") for p in (".", ",!", "###", "''"))

    @classmethod
    def get(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain, rest = [], []
        for w in words:
            (plain if _LETTERS(w) else rest).append(w)
        if not self.lowers or not self.ends.any():
            plain, rest = [], words
        for at in range(0, len(plain), 5000):
            part = plain[at : at + 5000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(cuts) != len(part):
                rest += part
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            self.known.update(zip(part, self._each(part), strict=True))

    def _words(self, text: str) -> list[str]:
        if self.lowers and not _OTHER(text) and "<|" not in text:
            text = _STOPS.sub(r" \1", text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._each(texts)
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            split = [self._words(t) for t in texts[at : at + 512]]
            if len(self.known) > self.entries:
                self.known, self.older = {}, self.known
            new = set().union(*split).difference(self.known)
            again = {w: self.older[w] for w in new & self.older.keys()}
            self.known |= again
            self._learn(list(new.difference(again)))
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
            for word in new:
                if len(word) > LONGEST:
                    del self.known[word]
        return out


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them to one Arrow IPC file, its documents to another."""

    def __init__(self, files: str, name: str, length: int, dtype: np.dtype):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(files)
        self.name, self.own, self.length, self.dtype = name, f"{name}.{os.getpid()}-{os.urandom(4).hex()}", length, dtype
        self.fs.create_dir(self.folder, recursive=True)
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.own}.ids.tmp")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index_out = self.fs.open_output_stream(f"{self.folder}/{self.own}.docs.tmp")
        self.index_writer = pa.ipc.new_file(self.index_out, self.index)
        self.rest, self.total, self.docs = np.zeros(0, dtype=dtype), 0, 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, doc_ids: pa.Array, codes: list[bytes]) -> None:
        sizes = np.array([len(x) for x in codes], dtype=np.int64) // self.dtype.itemsize
        firsts = self.total + np.append(0, np.cumsum(sizes))[:-1]
        self.index_writer.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(firsts.astype(np.int64)), pa.array(sizes)], schema=self.index))
        self.total, self.docs = self.total + int(sizes.sum()), self.docs + len(codes)
        ids = np.concatenate([self.rest, np.frombuffer(b"".join(codes), dtype=self.dtype)])
        step = self.length * BATCH
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._write(ids[at : at + step], step)
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        if real := len(self.rest):
            padded = np.zeros(-(-real // self.length) * self.length, dtype=self.dtype)
            padded[:real] = self.rest
            self._write(padded, real)
        for x in (self.writer, self.out, self.index_writer, self.index_out):
            x.close()
        for kind in ("ids", "docs"):
            self.fs.move(f"{self.folder}/{self.own}.{kind}.tmp", f"{self.folder}/{self.name}.{kind}.arrow")


class SequenceFile:
    """Random access to the sequences of one file; memory-mapped where it is local, so slices copy nothing."""

    def __init__(self, files: str, name: str):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(files)
        path = f"{folder}/{name}"
        opened = pa.memory_map if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.reader = pa.ipc.open_file(opened(f"{path}.ids.arrow"))
        self.documents = pa.ipc.open_file(opened(f"{path}.docs.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids and the mask of sequence i."""
        batch = self.reader.get_batch(i // BATCH)
        row = i % BATCH
        return batch["ids"][row].values.to_numpy(), batch["mask"][row].values

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the first one on, counted without padding (only a file's end is padded)."""
        step, parts = self.length * BATCH, []
        while n:
            batch, at = divmod(first, step)
            values = self.reader.get_batch(batch)["ids"].flatten().to_numpy()[at : at + n]
            parts.append(values)
            first, n = first + len(values), n - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype="<u2")])


def write_sequences(docs: DataFrame, tokenizer_path: str, files: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> DataFrame:
    """Write all documents and return the manifest (part, name, n_docs, n_tokens); lazy: the files appear when it runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder.get(tokenizer_path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            writer = writer or SequenceWriter(files, f"part-{part:06d}", length, encoder.dtype)
            writer.add(batch[0], [x + end for x in encoder.encode(batch[1].fill_null("").to_pylist())])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [writer.name], "n_docs": [writer.docs], "n_tokens": [writer.total]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    prepared(docs.sparkSession)
    integer_id(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = n_files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, MANIFEST)


def read_documents(manifest: DataFrame, files: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                file = SequenceFile(files, name)
                for k in range(file.documents.num_record_batches):
                    index = file.documents.get_batch(k)
                    spans = zip(index["first"].to_pylist(), index["n_tokens"].to_pylist(), strict=True)
                    sums = [zlib.crc32(file.ids(first, n).astype("<u4").tobytes()) for first, n in spans]
                    starts = pa.array(index["first"].to_numpy() + before)
                    yield pa.RecordBatch.from_arrays([index["doc_id"], starts, index["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file, so this window over all of them stays small.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("name", "before").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequences_of(spark: SparkSession, docs: DataFrame, tokenizer_path: str, files: str, manifest_path: str, **options) -> DataFrame:
    """Write the files and their manifest, then read the documents back."""
    write_sequences(docs, tokenizer_path, files, **options).write.parquet(manifest_path)
    return read_documents(spark.read.schema(MANIFEST).parquet(manifest_path), files)
