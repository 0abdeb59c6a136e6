"""SentencePiece encoding and decoding through a table of distinct chunks (operator 2).

A model whose pieces never hold a whitespace marker after another character can't merge across the start of a run
of markers. The text is cut there, each distinct chunk of a batch is segmented once by the library, and the ids
are joined back by position. A model of another kind (checked on its vocabulary and normaliser) is refused.

The table belongs to a Python worker and holds at most ``table_entries`` chunks, none longer than LONGEST
characters, so memory doesn't grow with the data; a table for the whole corpus would need a shuffle of every word.

Defined results: a null text counts as empty and gives begin and end ids only; repeated rows each give a row; extra
columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, prepared

MARK = "▁"
LONGEST = 64
_CHUNK = re.compile(" +[^ ]*")
_tables: dict[str, ChunkTable] = {}


class ChunkTable:
    """Distinct chunks and their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model_path: str, table_entries: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.entries, self.known = table_entries, {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p)]
        probe = "a  b Ａ "
        if crossing or self.model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("pieces of this model can cross whitespace markers, or it normalises texts")
        # A marker alone, at a text's end: the library gives nothing for an empty text.
        self.known[""] = self.lone = np.array([self.model.piece_to_id(MARK)], dtype="<u4").tobytes()

    @classmethod
    def get(cls, model_path: str) -> ChunkTable:
        if model_path not in _tables:
            _tables[model_path] = cls(model_path)
        return _tables[model_path]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Each chunk without its first marker, which the library adds."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without begin and end ids."""
        split = [self.chunks(t) for t in texts]
        if len(self.known) > self.entries:
            self.known = {"": self.lone}
        new = list(set().union(*split).difference(self.known))
        found = {}
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            for chunk, ids in zip(part, self.model.encode(part, num_threads=1), strict=True):
                found[chunk] = np.array(ids, dtype="<u4").tobytes()
        self.known |= found
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for chunk in new:
            if len(chunk) > LONGEST:
                del self.known[chunk]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(x, dtype="<u4").tolist() for x in ids])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes in _encoded(batches, model_path, begin, end):
            ids = [np.frombuffer(x, dtype="<i4") for x in codes]
            values = np.concatenate([np.zeros(0, dtype="<i4"), *ids])
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch[0], pa.ListArray.from_arrays(offsets, values)], [id_col, "ids"])

    prepared(docs.sparkSession)
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{_field(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = ChunkTable.get(model_path).model.decode([x or [] for x in batch[1].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts or [], pa.string())], [id_col, "text"])

    prepared(encoded.sparkSession)
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{_field(encoded, id_col)}, text string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with begin and end ids, decode, and keep what identifies both: counts and SHA-256 digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes in _encoded(batches, model_path, True, True):
            texts = ChunkTable.get(model_path).decode(codes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0],
                    pa.array([len(x) // 4 for x in codes], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in codes], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    prepared(docs.sparkSession)
    schema = f"{_field(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256): the ids themselves beside what identifies them and the text that
    they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes in _encoded(batches, model_path, True, True):
            texts = ChunkTable.get(model_path).decode(codes)
            offsets = np.append(0, np.cumsum([len(x) // 4 for x in codes])).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(codes), dtype="<i4"))
            digests = ([hashlib.sha256(x).hexdigest() for x in codes], [hashlib.sha256(x.encode()).hexdigest() for x in texts])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(np.diff(offsets).astype(np.int64)), ids, *(pa.array(d, pa.string()) for d in digests)], [id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    prepared(docs.sparkSession)
    schema = f"{_field(docs, id_col)}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _encoded(batches: Iterator[pa.RecordBatch], model_path: str, begin: bool, end: bool) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    chunks = ChunkTable.get(model_path)
    head = np.array([chunks.model.bos_id()] * begin, dtype="<u4").tobytes()
    tail = np.array([chunks.model.eos_id()] * end, dtype="<u4").tobytes()
    for batch in pieces(batches):
        yield batch, [head + x + tail for x in chunks.encode(batch[1].fill_null("").to_pylist())]
