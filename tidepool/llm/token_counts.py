"""Token counts by a map-side lookup in two tiers.

Texts become flat arrays of code points; their pre-tokens are ranges of those,
each with a hash. Tier one is a compact hash table of frequent pre-tokens and
their token counts, broadcast to every worker and read only. It is gathered
over all rows without shuffling pre-tokens: each task sums up its rows to a
bounded summary, and summaries are merged in a tree. Tier two, for what the
table lacks, is a bounded cache of each worker, filled by batched merge rounds.
The tiers decide the speed, never the counts (but for equal hashes of different
pre-tokens; codepoints.run_hashes has the odds).

Defined results: null and empty texts have no bytes and no tokens; special
strings count as one token each; texts are taken whole, long ones in parts that
are cut before white space, where a pre-token ends in any case; repeated rows
are counted as often as they come. Columns `keep` that are called n_bytes or
n_tokens are refused.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe import MergeTable, merge_table
from tidepool.llm.codepoints import NUMBER, OTHER, SPACE, HashTable, classes, code_points, pieces, run_hashes
from tidepool.llm.shared import bounded_batches, offsets, raw_texts, slices, tidied

#: Entries of tier one, its longest pre-token, and what a task's count holds before rare pre-tokens leave it.
FREQUENT, LONGEST, COUNTED = 16_384, 48, 200_000
#: Entries of a worker's cache before it starts anew, summaries merged in one task, and characters in one go.
CACHED, FAN_IN, SLICE = 300_000, 32, 500_000
#: Fixed by the tokenizer files: what follows an apostrophe in a pre-token of its own, if that begins there.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no special final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class PreTokens:
    """The pre-tokens of a normalised text: runs of letters, single numbers, runs of other visible characters, and endings after an apostrophe."""

    def __init__(self, text: str):
        self.text = text
        points = code_points(text)
        kind = classes()[points]
        begins = np.ones(len(points) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero(points == ord("'"))
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != OTHER)]  # others belong to the run that they stand in
        for ending in ENDINGS:
            fits = quotes[quotes + len(ending) < len(points)]
            for i, c in enumerate(ending, 1):
                fits = fits[points[fits + i] == ord(c)]
            begins[fits + 1] = False
            begins[fits + 1 + len(ending)] = True
        edges = np.flatnonzero(begins)
        visible = kind[edges[:-1]] != SPACE
        self.starts, self.ends = edges[:-1][visible], edges[1:][visible]
        self.hashes = run_hashes(points, self.starts, self.ends)

    def strings(self, which: np.ndarray) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


class Special:
    """A tokenizer's special strings, which are cut out of a text before anything else."""

    def __init__(self, table: MergeTable):
        self.strings = tuple(table.special)
        self.pattern = regex.compile("|".join(map(regex.escape, sorted(self.strings, key=len, reverse=True)))) if self.strings else None

    def cut(self, text: str) -> tuple[str, int]:
        """The text with white space in place of special strings, and how many there were."""
        if not any(map(text.__contains__, self.strings)):
            return text, 0
        return self.pattern.subn(" ", text)


def joined(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Batches of texts, normalised and joined by line ends, with each part's text and its end in the batch. Long texts come in parts."""
    parts = [(k, p) for k, t in enumerate(texts) if t for p in pieces(t, SLICE)]
    for a, b in slices((len(p) + 1 for _, p in parts), SLICE):
        normal = [normalise(p) for _, p in parts[a:b]]
        yield "\n".join(normal), np.array([k for k, _ in parts[a:b]]), np.cumsum([len(p) + 1 for p in normal])


def frequent_pre_tokens(docs: DataFrame, tokenizer: str, text: str = "text", size: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens over all rows, as bounded summaries tell; most frequent first."""

    def top(seen: Counter, n: int) -> list[tuple[str, int]]:
        return sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:n]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        special = Special(merge_table(tokenizer))
        counts: dict[int, int] = {}
        names: dict[int, str] = {}
        for batch in batches:
            plain = [special.cut(raw.decode("utf-8", "replace"))[0] for raw in raw_texts(batch.column(0))]
            for whole, _, _ in joined(plain):
                found = PreTokens(whole)
                short = np.flatnonzero(found.ends - found.starts <= LONGEST)
                h, first, n = np.unique(found.hashes[short], return_index=True, return_counts=True)
                first = short[first]
                for k, (x, c) in enumerate(zip(h.tolist(), n.tolist(), strict=True)):
                    if x in counts:
                        counts[x] += c
                    else:
                        counts[x] = c
                        i = first[k]
                        names[x] = whole[found.starts[i] : found.ends[i]]
                if len(counts) > COUNTED:
                    least = sorted(counts.values(), reverse=True)[COUNTED // 4]
                    counts = {x: c for x, c in counts.items() if c > least}
                    names = {x: names[x] for x in counts}
        best = top(Counter({names[x]: c for x, c in counts.items()}), size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([[w for w, _ in best]], pa.list_(pa.string())), pa.array([[c for _, c in best]], pa.list_(pa.int64()))], ["task", "words", "counts"])

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        best = top(total(zip(frame["words"], frame["counts"], strict=True)), size)
        return pd.DataFrame({"task": [key[0]], "words": [[w for w, _ in best]], "counts": [[c for _, c in best]]})

    def total(summaries) -> Counter:
        seen: Counter = Counter()
        for words, counts in summaries:
            seen.update(dict(zip(words, map(int, counts), strict=True)))
        return seen

    kinds = "task int, words array<string>, counts array<bigint>"
    level = docs.select(F.col(text).alias("text")).mapInArrow(tidied(summed), kinds)
    tasks = level.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        level = level.groupBy(F.floor(F.col("task") / F.lit(FAN_IN)).cast("int").alias("to")).applyInPandas(merged, kinds)
    rows = level.collect()  # at most FAN_IN summaries of at most `size` entries
    return [w for w, _ in top(total((r["words"], r["counts"]) for r in rows), size)]


def tier_one(table: MergeTable, words: list[str]) -> HashTable:
    """Hashes of pre-tokens and their token counts."""
    points, sizes = code_points("".join(words)), np.array([len(w) for w in words], np.int64)
    at = offsets(sizes)
    _, ids = table.encode_words([w.encode() for w in words])
    return HashTable(run_hashes(points, at[:-1], at[1:]), np.diff(ids).astype(np.uint16))


class Misses:
    """Tier two: a worker's cache of what tier one lacks, from hash to token count. What it forgets is encoded again."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.known: dict[int, int] = {}

    def counts(self, found: PreTokens, which: np.ndarray) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known = {}
        h, first, inverse = np.unique(found.hashes[which], return_index=True, return_inverse=True)
        new = np.array([k for k, x in enumerate(h.tolist()) if x not in self.known], np.int64)
        if len(new):
            _, at = self.table.encode_words([w.encode() for w in found.strings(which[first[new]])])
            self.known.update(zip(h[new].tolist(), np.diff(at).tolist(), strict=True))
        return np.array([self.known[x] for x in h.tolist()], np.int64)[inverse]


_misses: dict[str, Misses] = {}


def misses(tokenizer: str) -> Misses:
    """The one cache of this worker, kept from task to task."""
    if tokenizer not in _misses:
        _misses[tokenizer] = Misses(merge_table(tokenizer))
    return _misses[tokenizer]


def counted(texts: list[str], first: HashTable, second: Misses, special: Special) -> np.ndarray:
    """Tokens of each text."""
    cut = [special.cut(t) for t in texts]
    out = np.array([n for _, n in cut], np.int64)
    for whole, owner, ends in joined([t for t, _ in cut]):
        found = PreTokens(whole)
        n = first.find(found.hashes)
        lacking = np.flatnonzero(n < 0)
        if len(lacking):
            n[lacking] = second.counts(found, lacking)
        until = offsets(n)[np.searchsorted(found.starts, ends)]
        np.add.at(out, owner, np.diff(until, prepend=0))
    return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), frequent: int = FREQUENT) -> DataFrame:
    """Columns `keep`, n_bytes (UTF-8) and n_tokens of every row; no shuffle of texts or pre-tokens."""
    if {"n_bytes", "n_tokens"} & {c.lower() for c in keep}:
        raise ValueError("columns to keep may not be called n_bytes or n_tokens")
    session = docs.sparkSession
    bounded_batches(session)
    sent = session.sparkContext.broadcast(tier_one(merge_table(tokenizer), frequent_pre_tokens(docs, tokenizer, text, frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, special = sent.value, misses(tokenizer), Special(merge_table(tokenizer))
        for batch in batches:
            raws = raw_texts(batch.column(len(keep)))
            n = counted([raw.decode("utf-8", "replace") for raw in raws], first, second, special)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([len(x) for x in raws], pa.int64()), pa.array(n)], [*keep, "n_bytes", "n_tokens"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(tidied(run), ", ".join([*kinds, "n_bytes bigint", "n_tokens bigint"]))
