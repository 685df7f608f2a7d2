"""Vector bin packing of examples for instruction data.

A sequence has limits on its tokens, its segments (pieces of examples) and its
loss-bearing tokens, all at once. Each task packs its own rows, with no shuffle: it
holds a window of examples and fills one sequence after another,

1. of the pieces that still fit under all limits, the one whose demands have the greatest
   dot product with what the sequence has left; each dimension is weighted by the mean
   demand on it in the window, so scarce ones count for more;
2. when none fits, the longest piece is cut so that its head fills the sequence, and its
   rest goes back to the window;
3. a sequence that the limits leave short, as at the end of a task, is cut back to a
   power of two, at which a sequence needs no padding; what is cut off goes back.

So the only padding is in sequences whose limits allow no power of two; there is none
without binding limits on loss. Examples longer than a sequence are cut into full ones
first. A window is refilled when half of it is packed, so that there is always a choice;
it holds a bounded number of tokens besides its largest example.

An example is a text, or a list of parts of which some bear loss (as an assistant's turns
do). The first token of a piece never bears loss: nothing in the piece comes before it.

A task's rows, and so its pieces, are made anew as they were if an executor is lost.

Defined results: null and empty texts and lists are one piece that holds the end id; the
end id bears loss if the example's last part does; repeated rows are packed as often as
they come; rows with a null key are packed too; an empty table gives no rows; columns
other than key and text don't matter; a key called like a column of the result is refused.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType

from tidepool.llm.bpe import MergeTable, merge_table
from tidepool.llm.shared import bounded_batches, offsets, ragged, slices, texts, tidied

CAPACITY, SEGMENTS, END_ID = 2048, 64, 1
#: Tokens of a window, words whose ids a worker keeps before it starts anew, their ids, and bytes of text encoded in one go.
WINDOW, CACHE_WORDS, CACHE_IDS, SLICE = 1 << 20, 600_000, 8_000_000, 1_000_000
#: Fixed by the tokenizer files: pre-tokens, and what \\s is there (str.split() parts at more).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
STOPS = frozenset(".,;:!?")
BREAKS, NO_BREAKS = regex.compile(r"\s+"), "\x1c\x1d\x1e\x1f"


class Codes(dict):
    """Word to code; a new word gets the next code and waits in `pending`."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.pending.append(word)
        return code


class WordEncoder:
    """Texts to ids as a lower-casing tokenizer with word ends gives them. What stands between white space gets its ids from a bounded cache, and that from one of pre-tokens."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")") if table.special else None
        self.forget()

    def forget(self) -> None:
        self.codes, self.pre_tokens = Codes(), Codes()
        self.ids, self.of_pre_token = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.store, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encodes the words that wait: new pre-tokens by merge rounds, words by joining those of theirs."""
        flat: list[int] = []
        counts: list[int] = []
        code = self.pre_tokens.__getitem__
        for word in self.codes.pending:
            normal = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
            if normal.isalpha():
                flat.append(code(normal))
                counts.append(1)
            elif normal[-1] in STOPS and normal[:-1].isalpha():
                flat += (code(normal[:-1]), code(normal[-1]))
                counts.append(2)
            else:
                found = WORDS.findall(normal)
                flat += map(code, found)
                counts.append(len(found))
        self.codes.pending = []
        if self.pre_tokens.pending:
            ids, at = self.table.encode_words([w.encode("utf-8", "replace") for w in self.pre_tokens.pending])
            self.pre_tokens.pending = []
            self.of_pre_token = np.concatenate((self.of_pre_token, len(self.ids) + at[1:]))
            self.ids = np.concatenate((self.ids, ids))
        parts = np.array(flat, np.int64)
        start = self.of_pre_token[parts]
        sizes = self.of_pre_token[parts + 1] - start
        ends = offsets(sizes)[offsets(np.array(counts, np.int64))]
        self.start = np.concatenate((self.start, len(self.store) + ends[:-1]))
        self.length = np.concatenate((self.length, np.diff(ends)))
        self.store = np.concatenate((self.store, self.ids[ragged(start, sizes)]))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch in one array, and each text's start in it with the end at last."""
        if len(self.codes) > CACHE_WORDS or len(self.store) + len(self.ids) > CACHE_IDS:
            self.forget()
        code, special = self.codes.__getitem__, self.table.special
        flat: list[int] = []
        bounds = [0]
        for text in batch:
            for part in self.special.split(text) if any(map(text.__contains__, special)) else (text,):
                if part in special:
                    flat.append(-1 - special[part])
                else:
                    flat.extend(map(code, filter(None, BREAKS.split(part)) if any(map(part.__contains__, NO_BREAKS)) else part.split()))
            bounds.append(len(flat))
        if self.codes.pending:
            self.learn()
        codes = np.array(flat, np.int64)
        marks = np.flatnonzero(codes < 0)
        wanted, codes[marks] = -1 - codes[marks], 0
        sizes, start = (self.length[codes], self.start[codes]) if len(self.start) else (np.ones(len(codes), np.int64), np.zeros(len(codes), np.int64))
        sizes[marks] = 1
        at = offsets(sizes)
        from_store = ragged(start, sizes)
        ids = self.store[np.minimum(from_store, len(self.store) - 1)] if len(self.store) else np.zeros(len(from_store), np.int32)
        ids[at[marks]] = wanted
        return ids, at[np.array(bounds)]


class Example:
    """An example's ids. loss: whether each bears loss; None: all do."""

    def __init__(self, key, ids: np.ndarray, loss: np.ndarray | None = None):
        self.key, self.ids = key, ids
        self.before = None if loss is None or loss.all() else offsets(loss)

    def bearing(self, a: int, b: int) -> int:
        """Loss-bearing tokens of the piece a .. b."""
        return b - a - 1 if self.before is None else int(self.before[b] - self.before[min(a + 1, b)])

    def reach(self, a: int, b: int, tokens: int, loss: int) -> int:
        """Where the longest piece from a ends that has at most so many tokens and loss-bearing ones; at most b."""
        end = min(b, a + tokens)
        if self.before is None:
            return min(end, a + 1 + loss)
        return min(end, int(np.searchsorted(self.before, self.before[min(a + 1, len(self.ids))] + loss, side="right")) - 1)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(tokenizer: str) -> WordEncoder:
    """The one encoder of this worker, kept from task to task; what its cache forgets is encoded again."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = WordEncoder(merge_table(tokenizer))
    return _encoders[tokenizer]


#: A piece: its example and range of ids.
Piece = tuple[Example, int, int]


class Packer:
    """The window of one task. take() gives sequences as lists of pieces."""

    def __init__(self, tokens: int, segments: int, loss: int, window: int = WINDOW):
        if min(tokens, segments) < 1 or loss < 0:
            raise ValueError("limits must allow a sequence of one token")
        self.tokens, self.segments, self.loss, self.window = tokens, segments, loss, window
        self.held = self.pieces = self.bearing = 0
        self.slot: dict[tuple[int, int], int] = {}
        self.waiting: list[list[Piece]] = []
        self.demand = np.zeros((64, 2), np.int64)
        self.count = np.zeros(64, np.int64)

    def add(self, example: Example) -> None:
        """Puts all of an example into the window, in pieces no longer than the limits allow; the shorter piece is the last."""
        at, n = 0, len(example.ids)
        while at < n:
            end = example.reach(at, n, self.tokens, self.loss)
            self.put((example, at, end))
            at = end

    def put(self, piece: Piece) -> None:
        demand = piece[2] - piece[1], piece[0].bearing(*piece[1:])
        k = self.slot.get(demand)
        if k is None:
            k = self.slot[demand] = len(self.waiting)
            self.waiting.append([])
            if k == len(self.count):
                self.demand, self.count = np.concatenate((self.demand, np.zeros_like(self.demand))), np.concatenate((self.count, np.zeros_like(self.count)))
            self.demand[k] = demand
        self.waiting[k].append(piece)
        self.account(k, 1)

    def account(self, k: int, n: int) -> None:
        self.count[k] += n
        self.pieces += n
        self.held += n * int(self.demand[k, 0])
        self.bearing += n * int(self.demand[k, 1])

    def pop(self, k: int) -> Piece:
        self.account(k, -1)
        return self.waiting[k].pop()

    def tidy(self) -> None:
        """Forgets kinds of pieces that no longer wait."""
        left = [p for pieces in self.waiting for p in pieces]
        self.__init__(self.tokens, self.segments, self.loss, self.window)
        for p in left:
            self.put(p)

    def take(self, least: int) -> Iterator[list[Piece]]:
        """Sequences, until no more than `least` tokens wait."""
        while self.held > least:
            yield self.filled()
        self.tidy()

    def filled(self) -> list[Piece]:
        """The next sequence."""
        kinds = len(self.waiting)
        demand, count = self.demand[:kinds], self.count[:kinds]
        left, bearing, room, out = self.tokens, self.loss, self.segments, []
        # mean demand in the window on each limit, as shares of the limit; a piece's demand on segments is always one
        weight = np.array([self.held / self.pieces / self.tokens**2, self.bearing / self.pieces / max(1, self.loss) ** 2])
        while left and room:
            fits = (count > 0) & (demand[:, 0] <= left) & (demand[:, 1] <= bearing)
            worth = np.where(fits, demand @ (weight * (left, bearing)) + 1e-9 * demand[:, 0], -1.0)
            k = int(np.argmax(worth))
            if worth[k] < 0:
                break
            out.append(self.pop(k))
            left, bearing, room = left - int(demand[k, 0]), bearing - int(demand[k, 1]), room - 1
        if left and room and self.pieces:
            k = int(np.argmax(np.where(count > 0, demand[:, 0], -1)))
            example, a, b = self.pop(k)
            end = example.reach(a, b, left, bearing)
            if end > a:
                out.append((example, a, end))
                left -= end - a
            if end < b:
                self.put((example, end, b))
        return self.cut_back(out, self.tokens - left) if left else out

    def cut_back(self, out: list[Piece], used: int) -> list[Piece]:
        """The sequence up to a power of two."""
        surplus = used - (1 << used.bit_length() - 1)
        while surplus:
            example, a, b = out.pop()
            end = max(a, b - surplus)
            if end > a:
                out.append((example, a, end))
            self.put((example, end, b))
            surplus -= b - end
        return out


def with_ids(ids: list[np.ndarray]) -> dict:
    return {"ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))}


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    tokens: int = CAPACITY,
    segments: int = SEGMENTS,
    loss: int | None = None,
    end_id: int = END_ID,
    columns: Callable[[list[np.ndarray]], dict] = with_ids,
    kinds: str = "ids array<int>",
) -> DataFrame:
    """Key, start, length, doc_tokens, loss_tokens, sequence_id and offset of every piece, with its ids or what `columns` makes of them.

    text: a column of texts, or of arrays of structs whose first field is a text and whose
    second tells whether it bears loss. loss: the limit on loss-bearing tokens; none: as many
    as there are tokens.
    """
    own = ("start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")
    if key.lower() in own:
        raise ValueError(f"the key column may not be called {key}")
    bounded_batches(docs.sparkSession)
    kind, in_parts = docs.schema[key].dataType.simpleString(), isinstance(docs.schema[text].dataType, ArrayType)
    limit = tokens if loss is None else loss

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if in_parts:
                for k, parts in zip(keys, batch.column(1).to_pylist(), strict=True):
                    told = [tuple(p.values()) for p in parts or () if p is not None]
                    ids, at = encoder.encode([t or "" for t, _ in told])
                    bears = [bool(x) for _, x in told] or [True]
                    yield Example(k, np.append(ids, end_id).astype(np.int32), np.append(np.repeat(bears, np.diff(at)) if told else np.zeros(0, bool), bears[-1]))
                continue
            sizes = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for a, b in slices(sizes, SLICE):
                ids, at = encoder.encode(texts(batch.column(1).slice(a, b - a)))
                for k, x, y in zip(keys[a:b], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    yield Example(k, np.append(ids[x:y], np.int32(end_id)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 40)
        packer = Packer(tokens, segments, limit)

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            out, ids = defaultdict(list), []
            for sequence in packer.take(least):
                n, at = next(number), 0
                for example, a, b in sequence:
                    for name, x in zip((key, *own), (example.key, a, b - a, len(example.ids), example.bearing(a, b), n, at), strict=True):
                        out[name].append(x)
                    ids.append(example.ids[a:b])
                    at += b - a
            if ids:
                yield pa.RecordBatch.from_pydict({key: pa.array(out[key], key_kind[0]), **{x: pa.array(out[x], pa.int64()) for x in own}, **columns(ids)})

        key_kind: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key_kind[:] = [batch.schema.field(0).type]
                yield batch

        for example in examples(noted()):
            packer.add(example)
            if packer.held > WINDOW:
                yield from rows(WINDOW // 2)
        yield from rows(0)

    out = docs.select(docs[key].alias(key), docs[text].alias("__text")).mapInArrow(tidied(run), f"`{key}` {kind}, {', '.join(f'{x} bigint' for x in own)}, {kinds}")
    return out.select(key, *own, *[x for x in out.columns if x not in (key, *own)])
