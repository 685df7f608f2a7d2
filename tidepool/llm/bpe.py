"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds the rank of
every neighbouring pair by binary search over the sorted pair keys, takes the
lowest rank of each word, and merges all places of that pair, from left to
right. Words without a mergeable pair leave the array. Around this, a worker
keeps bounded caches from text chunks to ids; what they forget is encoded
again, so they never change a result.

Defined results: null and empty texts give no ids; special strings inside a
text become their one id, as in the tokenizers library's default; texts of any
length are taken whole; repeated rows are encoded as often as they come. Columns
to keep that are called like one of the result's are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepool.llm.shared import bounded_batches, offsets, ragged, slices, texts, tidied

#: Fixed by the tokenizer files.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks and ids that a cache holds before it starts anew.
CACHE_ENTRIES, CACHE_IDS = 300_000, 4_000_000
#: Characters of text encoded in one go.
SLICE = 1_000_000
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, to that byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Vocabulary and merge ranks of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        to_byte = byte_alphabet()
        self.first = np.full(256, -1, np.int64)
        self.last = np.full(256, -1, np.int64)
        for c, b in to_byte.items():
            self.first[b], self.last[b] = vocab[c], vocab[c + self.end]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        #: What each pair of bytes merges to at a word's start or middle, and with the word's last byte.
        bytes_, tails = np.repeat(self.first, 256), (np.tile(self.first, 256), np.tile(self.last, 256))
        self.pairs = [self.find(bytes_, x) for x in (tails if self.end else tails[:1])]
        spelled = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.special:
                spelled[i] = bytes(to_byte[c] for c in token.removesuffix(self.end or "\0"))
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_length = np.array([len(x) for x in spelled], np.int64)
        self.token_start = offsets(self.token_length)[:-1]
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE for pairs that don't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32), self.merged[at].astype(np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's start in it with the end at last."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbol = self.first[raw].astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        rank, to = np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        pair = (raw[:-1].astype(np.int32) << 8) | raw[1:]
        rank[:-1], to[:-1] = self.pairs[0][0][pair], self.pairs[0][1][pair]
        tail = np.cumsum(size)[size > 0] - 1
        if self.end:
            symbol[tail] = self.last[raw[tail]]
            before = tail[tail > 0] - 1
            rank[before], to[before] = self.pairs[1][0][pair[before]], self.pairs[1][1][pair[before]]
        rank[tail] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while n := len(symbol):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, n)))
            idle = least == NONE
            chosen = (rank == least) & ~idle
            # aaa: of pairs that share a symbol every second one is merged, the leftmost first
            if np.any(chosen[1:] & chosen[:-1]):
                place = np.arange(n)
                run = place - np.maximum.accumulate(np.where(chosen, -1, place)) - 1
                chosen &= run % 2 == 0
            hit = np.flatnonzero(chosen)
            symbol[hit] = to[hit]
            rank[hit] = rank[hit + 1]  # the pair's end decides whether a pair follows
            stay = ~idle
            stay[hit + 1] = False
            if idle.any():
                done.append((word[idle], symbol[idle]))
            place = np.cumsum(stay)[hit] - 1
            ended = np.zeros(n, bool)
            ended[:-1] = word[1:] != word[:-1]
            ended[-1] = True
            ended[hit] = ended[hit + 1]
            symbol, word, rank, to, ended = symbol[stay], word[stay], rank[stay], to[stay], ended[stay]
            look = np.concatenate((place, place[place > 0] - 1))
            look = look[~ended[look]]
            rank[look], to[look] = self.find(symbol[look], symbol[look + 1])
            rank[ended] = NONE
        word = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])[np.argsort(word, kind="stable")]
        return ids, offsets(np.bincount(word, minlength=len(words)))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes that each range of ids spells."""
        size = self.token_length[ids]
        raw = self.token_bytes[ragged(self.token_start[ids], size)].tobytes()
        ends = offsets(size)[starts]
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Codes(dict):
    """Chunk to code; a new chunk gets the next code and waits in `cache.pending`."""

    def __init__(self, cache: ChunkCache, lead: str):
        super().__init__()
        self.cache, self.lead = cache, lead

    def __missing__(self, chunk: str) -> int:
        pending = self.cache.pending
        code = self[chunk] = self.cache.entries + len(pending)
        pending.append(self.lead + chunk)
        return code


class ChunkCache:
    """The ids of text chunks, in one flat store, by code. One per worker."""

    def __init__(self, table: MergeTable, pattern: str):
        self.table, self.pattern = table, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.start_codes, self.space_codes = Codes(self, ""), Codes(self, " ")  # chunks as they are, and after a space
        self.pending: list[str] = []
        self.store = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.entries = 0

    def trim(self) -> None:
        if self.entries > CACHE_ENTRIES or len(self.store) > CACHE_IDS:
            self.forget()

    def learn(self) -> None:
        """Encodes all pending chunks: single pre-tokens by merge rounds, the others by joining those."""
        pending, found_in = self.pending, self.pattern.findall
        start_codes, space_codes, first = self.start_codes, self.space_codes, self.entries
        joined: list[int] = []
        parts: list[int] = []
        counts: list[int] = []
        k = 0
        while k < len(pending):  # it grows by the parts
            for k, chunk in enumerate(pending[k:], k):  # noqa: B020
                if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
                    continue
                found = (chunk[:-1], chunk[-1]) if chunk[-1] in STOPS and chunk[1:-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else found_in(chunk)
                if len(found) > 1:
                    parts += [space_codes[x[1:]] if x[0] == " " and len(x) > 1 else start_codes[x] for x in found]
                    counts.append(len(found))
                    joined.append(k)
            k += 1
        n = len(pending)
        single = np.ones(n, bool)
        single[joined] = False
        words = pending
        if joined:
            words = [w for w, ok in zip(pending, single.tolist(), strict=True) if ok]
        ids, at = self.table.encode_words([w.encode() for w in words])
        start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        start[single], length[single] = len(self.store) + at[:-1], np.diff(at)
        self.start, self.length = np.concatenate((self.start, start)), np.concatenate((self.length, length))
        self.store = np.concatenate((self.store, ids))
        if joined:
            parts_ = np.array(parts, np.int64)
            sizes = self.length[parts_]
            ends = offsets(sizes)[offsets(np.array(counts, np.int64))]
            self.start[first + np.array(joined)] = len(self.store) + ends[:-1]
            self.length[first + np.array(joined)] = np.diff(ends)
            self.store = np.concatenate((self.store, self.store[ragged(self.start[parts_], sizes)]))
        self.entries += n
        self.pending = []


#: Marks after a word that end a pre-token of their own.
STOPS = frozenset(".,;:!?")
#: All white space but \n and the space; fixed by Unicode.
RARE_SPACE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class ByteLevelEncoder:
    """Texts to ids as a byte-level tokenizer gives them. One per worker.

    A text is cut at single spaces between two visible characters, where a
    pre-token always begins; each chunk's ids come from a cache. Other white
    space next to a space makes the whole text go through the pre-token pattern.
    """

    def __init__(self, table: MergeTable):
        self.table, self.cache = table, ChunkCache(table, BYTE_LEVEL)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")") if table.special else None

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch in one array, and each text's start in it with the end at last."""
        cache = self.cache
        cache.trim()
        begin, after, pattern = cache.start_codes, cache.space_codes, cache.pattern
        flat: list[int] = []
        bounds = [0]
        for text in batch:
            for cut in self.special.split(text) if any(map(text.__contains__, self.table.special)) else (text,):
                if not cut:
                    continue
                if cut in self.table.special:
                    flat.append(-1 - self.table.special[cut])
                elif crowded(cut):
                    flat.extend(map(begin.__getitem__, pattern.findall(cut)))
                else:
                    chunks = cut.split(" ")
                    flat.append(begin[chunks[0]])
                    del chunks[0]
                    flat.extend(map(after.__getitem__, chunks))
            bounds.append(len(flat))
        cache.learn()
        codes = np.array(flat, np.int64)
        marks = np.flatnonzero(codes < 0)
        wanted, codes[marks] = -1 - codes[marks], 0
        if cache.entries:
            sizes, start = cache.length[codes], cache.start[codes]
        else:  # nothing but special strings
            sizes, start = np.ones(len(codes), np.int64), np.zeros(len(codes), np.int64)
        sizes[marks] = 1
        at = offsets(sizes)
        ids = cache.store[ragged(start, sizes)] if cache.entries and len(cache.store) else np.zeros(int(at[-1]), np.int32)
        ids[at[marks]] = wanted
        return ids, at[np.array(bounds)]


#: White space beside a space, or a space at either end.
CROWDED = regex.compile(r"\s | \s|^ | $")


def crowded(text: str) -> bool:
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in RARE_SPACE) and CROWDED.search(text) is not None


_loaded: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    if path not in _loaded:
        _loaded[path] = MergeTable(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """Ids of every whole text (array<int>) and, if asked for, the text that they spell; columns `ids` and `decoded` beside `keep`.

    No shuffle: each task encodes its rows. Null texts give an empty list.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(
        _encoding(tokenizer, keep, decoded, None), ", ".join([*_kinds(docs, keep, ("ids", "decoded")), "ids array<int>", *["decoded string"] * decoded])
    )


def encoded_digests(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode_documents, with ids and text replaced by their length and digests where they arise."""
    bounded_batches(docs.sparkSession)
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(
        _encoding(tokenizer, keep, True, _digest), ", ".join([*_kinds(docs, keep, ("n_tokens", "ids_sha256", "decoded_sha256")), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])
    )


def _kinds(docs: DataFrame, keep: tuple[str, ...], own: tuple[str, ...]) -> list[str]:
    if set(own) & {c.lower() for c in keep}:
        raise ValueError(f"columns to keep may not be called {' or '.join(own)}")
    return [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]


def _digest(ids: np.ndarray, at: np.ndarray, decoded: list[bytes]) -> dict:
    flat = ids.astype("<u4")
    bounds = at.tolist()
    return {
        "n_tokens": pa.array(np.diff(at)),
        "ids_sha256": pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
        "decoded_sha256": pa.array([hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in decoded]),
    }


def _whole(ids: np.ndarray, at: np.ndarray, decoded: list[bytes] | None) -> dict:
    out = {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))}
    if decoded is not None:
        out["decoded"] = pa.array([x.decode("utf-8", "replace") for x in decoded])
    return out


def _encoding(tokenizer: str, keep: tuple[str, ...], decoded: bool, digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(tokenizer)
        encoder = ByteLevelEncoder(table)
        for batch in batches:
            column = batch.column(len(keep))
            sizes = [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
            for a, b in slices(sizes, SLICE):
                ids, at = encoder.encode(texts(column.slice(a, b - a)))
                spelled = table.decode(ids, at) if decoded else None
                out = (digest or _whole)(ids, at, spelled)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *out.values()], [*keep, *out])

    return tidied(run)
