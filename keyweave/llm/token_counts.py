"""Token counts by a compiled finite-state transducer (operator 8).

The tokenizer of a byte-pair model with whitespace markers is compiled, as far as texts need it, into a deterministic
transducer over characters. Chunks begin at a run of markers, which no piece crosses; state 0 is the start of one. A
transition (state, character) -> (state, tokens more) carries the change in the number of tokens, and the changes along
a path add up to the count. The token that a prefix ends with is the only piece ending there which, next to the last
token before it, the merges leave as it is. So all that a state must know of what was read is its longest suffix that
begins a piece, and, where in it pieces may begin, the last token before that place and the tokens up to there; chunks
that agree in this are in one state, whatever came before.

Transitions are kept as sorted arrays. The distinct chunks of a batch of texts run through them side by side, a
character of each at a time; those that meet a missing transition are compiled, and the arrays are made anew when they
have grown. Counts go back to texts by position.

A block of text acts on the transducer as a map of states: a block with a chunk border sends every incoming state, after
its head, to one outgoing state; a block without one extends the chunk. So a map is (head, tokens inside, tail) instead
of an array over all states, and maps compose associatively. Texts over SPLIT bytes are cut into blocks, which are rows
of their own that any task may scan; the maps of a text are then composed as a tree. A chunk without a border is walked
as a whole, however many blocks it spans.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; repeated rows each give a row; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pieces, prepared

MARK = "▁"
LONGEST = 64
#: Stands for any character that is in no piece: nothing merges with it.
FOREIGN = "\0"
#: Characters of a block of a text; bytes of a text that is not cut into rows; share by which arrays lag behind.
BLOCK, SPLIT, LAG = 1 << 16, 1 << 17, 0.2
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_compiled: dict[str, Transducer] = {}


class StateMap(NamedTuple):
    """The effect of a block: ``head`` goes on with the chunk that came in; None in ``tail``: it has no border."""

    head: str
    tokens: int
    tail: str | None


class Transducer:
    """Counts tokens; compiled as texts need it, with at most ``states`` states, then begun anew."""

    def __init__(self, model_path: str, states: int = 600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {p: -s for s, p in sorted(((model.get_score(i), model.id_to_piece(i)) for i in ids), reverse=True)}
        probe = "a  b Ａ "
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank) or model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("pieces of this model can cross whitespace markers, or it normalises texts")
        self.bytes = all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
        if not self.bytes:
            raise ValueError("this model has no byte fallback")
        self.longest = max(map(len, self.rank))
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.heads = {p[:i] for p in self.rank for i in range(len(p))}  # what may yet become a piece
        self.ends: dict[str, int] = {}
        self.max_states = states
        self.forms: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self._reset()

    @classmethod
    def get(cls, model_path: str) -> Transducer:
        if model_path not in _compiled:
            _compiled[model_path] = cls(model_path)
        return _compiled[model_path]

    def _reset(self) -> None:
        #: (state, character) in one integer -> next state, and -> tokens more; a state is a number, 0 the start.
        self.move: dict[int, int] = {}
        self.emit: dict[int, int] = {}
        #: Of each state: the suffix it knows, last tokens and tokens less by place in it; None where no piece begins.
        self.known: list[tuple[str, tuple, tuple]] = [("", ("",), (0,))]
        self.number = {self.known[0]: 0}
        self._arrays()

    def _arrays(self) -> None:
        keys = np.fromiter(self.move, np.int64, len(self.move))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], -1)
        self.moves = np.append(np.fromiter(self.move.values(), np.int64, len(keys))[order], 0)
        self.emits = np.append(np.fromiter(self.emit.values(), np.int64, len(keys))[order], 0)

    # ---- what the merges do ----

    def merged(self, text: str) -> list[str]:
        """The pieces that the merges make of a short string, best rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        """Whether the tokens a and b, side by side, stay as they are."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def _whole(self, piece: str) -> bool:
        """Whether the merges really make this piece of its characters."""
        found = self.forms.get(piece)
        if found is None:
            found = self.forms[piece] = len(piece) == 1 or (piece in self.rank and self.merged(piece) == [piece])
        return found

    # ---- the transducer ----

    def last_cut(self, word: str) -> int:
        """Where the last characters that aren't letters begin, if no piece spans that place; else 0."""
        at = len(word)
        while at and not word[at - 1].isalpha():
            at -= 1
        return at if 0 < at < len(word) <= LONGEST and word[at - 1 : at + 1] not in self.joined else 0

    def end(self, text: str) -> int:
        """Tokens of the few kinds of character runs that words end with."""
        found = self.ends.get(text)
        if found is None:
            if len(self.ends) > 100_000:
                self.ends.clear()
            found = self.ends[text] = self.walk(text)
        return found

    def _compile(self, state: int, char: str) -> int:
        """The state after one more character; the transition to it is kept with what it emits."""
        suffix, lasts, less = self.known[state]
        text = suffix + char
        if char not in self.rank and char not in self.heads:
            token, more = FOREIGN, len(char.encode("utf-8", "surrogatepass"))
        else:
            for begin in range(len(suffix), -1, -1):
                piece, before = text[begin:], lasts[begin]
                if before is not None and self._whole(piece) and (not before or self._fits(before, piece)):
                    token, more = piece, less[begin] + (1 if piece in self.rank else len(piece.encode()))
                    break
            else:
                raise ValueError(f"no token ends in {text!r}")
        lasts, less = (*lasts, token), (*(None if n is None else n - more for n in less), 0)
        begin = next(k for k in range(len(text) + 1) if text[k:] in self.heads)
        there = [text[k:] in self.heads for k in range(begin, len(text) + 1)]
        key = (text[begin:], tuple(t if ok else None for t, ok in zip(lasts[begin:], there, strict=True)), tuple(n if ok else None for n, ok in zip(less[begin:], there, strict=True)))
        to = self.number.setdefault(key, len(self.known))
        if to == len(self.known):
            self.known.append(key)
        at = state << 21 | ord(char)
        self.move[at], self.emit[at] = to, more
        return to

    def walk(self, text: str, state: int = 0) -> int:
        """Tokens more after the characters of a text: what its transitions emit. Those that are missing are compiled."""
        move, emit, total = self.move, self.emit, 0
        for char in text:
            at = state << 21 | ord(char)
            state = move.get(at)
            if state is None:
                state = self._compile(at >> 21, char)
            total += emit[at]
        return total

    def run(self, chunks: list[str]) -> np.ndarray:
        """Tokens of chunks of up to LONGEST characters: the compiled transitions, a character of each chunk at a time."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.append(0, np.cumsum(sizes))[:-1]
        state, total = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        live, missing = np.flatnonzero(sizes > 0), []
        for k in range(int(sizes.max(initial=0))):
            key = state[live] << 21 | codes[begin[live] + k]
            at = np.searchsorted(self.keys[:-1], key)
            there = self.keys[at] == key
            missing += [(i, k) for i in live[~there].tolist()]
            live, at = live[there], at[there]
            state[live] = self.moves[at]
            total[live] += self.emits[at]
            live = live[sizes[live] > k + 1]
        for i, k in missing:
            total[i] += self.walk(chunks[i][k:], int(state[i]))
        if len(self.known) > self.max_states:
            self._reset()
        if len(self.move) > (1 + LAG) * len(self.keys):
            self._arrays()
        return total

    def tokens_of(self, chunks: Iterable[str]) -> dict[str, int]:
        """Tokens of distinct chunks, each given without its first marker."""
        chunks = list(chunks)
        # no piece spans a cut, so what is before it is a chunk of its own, met more often
        cuts = [0 if not c or c[-1].isalpha() else self.last_cut(c) for c in chunks]
        bases = [c[:cut] if cut else c for c, cut in zip(chunks, cuts, strict=True)]
        short = list({c for c in bases if len(c) < LONGEST})
        counts = dict(zip(short, self.run([MARK + c for c in short]).tolist(), strict=True))
        found = {}
        for chunk, cut, base in zip(chunks, cuts, bases, strict=True):
            n = counts[base] if len(base) < LONGEST else self.walk(MARK + base)
            found[chunk] = n + self.end(chunk[cut:]) if cut else n
        return found

    def one(self, chunk: str) -> int:
        """Tokens of a chunk that begins with a marker, or of a text's part without one."""
        return self.tokens_of([chunk[1:]])[chunk[1:]] if chunk.startswith(MARK) else self.walk(chunk)

    # ---- blocks ----

    def scan(self, blocks: list[str]) -> list[StateMap]:
        """The state maps of blocks of marked text."""
        split: list[tuple[str, list[str], str | None]] = []
        for block in blocks:
            at = block.find(MARK)
            if at < 0:
                split.append((block, [], None))
                continue
            parts = block[at + 1 :].split(MARK) if MARK + MARK not in block else [c[1:] for c in _CHUNK.findall(block, at)]
            split.append((block[:at], parts, MARK + parts.pop()))
        tokens = self.tokens_of(set().union(*(parts for _, parts, _ in split)))
        return [StateMap(head, sum(map(tokens.__getitem__, parts)), tail) for head, parts, tail in split]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b; b doesn't begin with a marker."""
        if a.tail is None:
            return StateMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.tokens, a.tail + b.head)
        return StateMap(a.head, a.tokens + self.one(a.tail + b.head) + b.tokens, b.tail)

    def composed(self, maps: list[StateMap]) -> int:
        """Tokens of a text, from the maps of its blocks, composed as a tree."""
        while len(maps) > 1:
            maps = [self.compose(*pair) if len(pair) == 2 else pair[0] for pair in (maps[i : i + 2] for i in range(0, len(maps), 2))]
        return sum(m.tokens + (self.one(m.head) if m.head else 0) + (self.one(m.tail) if m.tail else 0) for m in maps)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of texts, a block each."""
        maps = self.scan([marked(t) for t in texts])
        tails = self.tokens_of({m.tail[1:] for m in maps if m.tail})
        return [m.tokens + tails[m.tail[1:]] if m.tail else 0 for m in maps]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text, marked, in blocks none of which begins inside a run of markers."""
    whole, begin = marked(text), 0
    while begin < len(whole):
        end = begin + size
        while end < len(whole) and whole[end] == MARK:
            end += 1
        yield whole[begin:end]
        begin = end


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, without begin, end or other added tokens."""
    n = partitions(prepared(docs.sparkSession))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    result = ["id", "n_bytes", "n_tokens"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Transducer.get(model_path).counts(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], pa.array(counts, pa.int64())], result)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            parts = pa.array(blocks(batch["text"][0].as_py(), block), pa.string())
            same = [pa.repeat(batch[c][0], len(parts)) for c in ("id", "n_bytes", "tag")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(parts)), pa.int32()), parts], ["id", "n_bytes", "tag", "k", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            maps = Transducer.get(model_path).scan(batch["block"].to_pylist())
            columns = [pa.array([m[i] for m in maps], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "n_bytes", "tag", "k")), *columns], ["id", "n_bytes", "tag", "k", "head", "tokens", "tail"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From state maps sorted by text and place."""
        held: list[StateMap] = []
        before = None

        def done() -> pa.RecordBatch:
            total = Transducer.get(model_path).composed(held)
            return pa.RecordBatch.from_arrays([before["id"], before["n_bytes"], pa.array([total], pa.int64())], result)

        for batch in pieces(batches, 1):
            if before is not None and before["tag"][0] != batch["tag"][0]:
                yield done()
                held = []
            before = batch
            held.append(StateMap(*(batch[c][0].as_py() for c in ("head", "tokens", "tail"))))
        if before is not None:
            yield done()

    base = f"id {kind}, n_bytes long"
    short = rows.where(F.col("n_bytes") <= split).mapInArrow(whole, f"{base}, n_tokens long")
    long = rows.where(F.col("n_bytes") > split).withColumn("tag", F.monotonically_increasing_id()).mapInArrow(cut, f"{base}, tag long, k int, block string")
    maps = long.repartition(n, "tag", "k").mapInArrow(scan, f"{base}, tag long, k int, head string, tokens long, tail string")
    long = maps.repartition(n, "tag").sortWithinPartitions("tag", "k").mapInArrow(compose, f"{base}, n_tokens long")
    counted = short.unionByName(long)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
