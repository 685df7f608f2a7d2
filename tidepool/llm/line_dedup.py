"""Line deduplication across all documents by a join of deletion neighbourhoods.

Two lines are duplicates if their words are equal, or if both have NEAR_WORDS
words or more and one word added, removed or replaced turns one into the other.
A line goes if an earlier one (by document id, then by line) is its duplicate. Lines
with fewer than MIN_WORDS words are left alone, but for those with LETTERS letters and
digits or more (as in scripts without spaces): they go if they are equal to an earlier one.

1. Equal lines: a hash of the words, and the earliest place of each hash.
2. Of the distinct lines only those can have a neighbour that share their first or
   their last half with another line; the halves' hashes tell, without loss.
3. Those emit their deletion variants as hashed keys: the words without word i.
   Two lines with the same variant at the same i differ in that word; a line that
   is another's variant lacks a word. So the earliest line of a key decides for all
   others of it: no pairs within a key are made, however many lines share it.
4. Each line and its decider are verified by their edit distance; if it holds, all
   places of the line go.

Places of lines that come once are dropped before they are joined; lines and keys that
come very often meet their deciders by broadcast (shared.spread_join), so no task gets
all places of one line. Texts without a marked line aren't shuffled.

Lines count as equal by a 64-bit hash of their words: among n distinct lines some two
share one by chance with probability n^2 / 2^65: 3 in 10^5 for 3 x 10^7 lines, one in
four for 3 x 10^9, of which one line would be lost.

Defined results: null texts stay null; empty ones stay empty; documents with a null id
stay as they are; rows of one id count as one document, line by line: of rows that
repeat id and text all stay, as their lines have the same place, and of different
lines at one place that with the lesser hash is the earlier; a text all of whose
lines go is empty; texts of any length are taken whole. Columns of docs stay, but one
called like the result's is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.minhash import CACHED, SPREAD, WordHashes
from tidepool.llm.shared import ASCII_SPACE, bounded_batches, marked, mix64, offsets, prefilter, ragged, raw_texts, salted_join, scratch, slices, spread_join, tidied, unused

MIN_WORDS, NEAR_WORDS, LETTERS, SLICE = 4, 8, 20, 1_000_000
#: The inverse of SPREAD modulo 2^64.
BACK = np.uint64(pow(int(SPREAD), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def lettered(line: bytes, least: int) -> bool:
    """Whether the line has so many letters and digits, however few its words: as in scripts without spaces."""
    return len(line) >= least and sum(map(str.isalnum, line.decode("utf-8", "replace"))) >= least


class Lines:
    """The lines of a batch of texts that have enough words (or letters, if given), as flat arrays of word hashes."""

    def __init__(self, raws: list[bytes], cache: WordHashes, chosen: list | None = None, letters: int | None = None):
        flat: list[int] = []
        owner, number, size = [], [], []
        for d, raw in enumerate(raws):
            lines = raw.split(b"\n")
            for k in range(len(lines)) if chosen is None else chosen[d]:
                words = lines[k].split() if k < len(lines) else ()
                if len(words) >= MIN_WORDS or letters and words and lettered(lines[k], letters):
                    flat.extend(map(cache.__getitem__, words))
                    owner.append(d)
                    number.append(k)
                    size.append(len(words))
            if len(cache) > CACHED:
                cache.clear()
        self.words = np.array(flat, np.uint64)
        self.owner, self.number, self.size = (np.array(x, np.int64) for x in (owner, number, size))
        self.at = offsets(self.size)
        # prefix sums of word times power: any range's hash is a difference, moved to power 0
        n = len(flat)
        self.up, self.down = powers(SPREAD, n + 2), powers(BACK, n + 2)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * self.up[:n], dtype=np.uint64)))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a .. b of the flat array."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def full(self) -> np.ndarray:
        return mix64(self.span(self.at[:-1], self.at[1:]) + self.size.astype(np.uint64))

    def halves(self) -> list[np.ndarray]:
        """Hashes of the first and last words that stay equal if one word changes: for neighbours of as many words or one more, and of one less."""
        out = []
        for shorter in (0, 1):
            n = self.size - shorter
            h = n // 2
            out.append(mix64(self.span(self.at[:-1], self.at[:-1] + h) * np.uint64(4) + np.uint64(1) ^ h.astype(np.uint64)))
            out.append(mix64(self.span(self.at[1:] - (n - h), self.at[1:]) * np.uint64(4) + np.uint64(2) ^ (n - h).astype(np.uint64)))
        return out

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, left-out word and hash of every deletion variant; hashed as full() would hash the shorter line."""
        line = np.repeat(np.arange(len(self.size)), self.size)
        i = ragged(np.zeros(len(self.size), np.int64), self.size)
        start = self.at[line]
        left = self.span(start, start + i)
        right = (self.sums[self.at[line + 1]] - self.sums[start + i + 1]) * self.down[start + 1]
        return line, i, mix64(left + right + (self.size[line] - 1).astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one word must be added, removed or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    apart = np.flatnonzero(a != b[: len(a)])
    if len(a) == len(b):
        return len(apart) <= 1
    at = apart[0] if len(apart) else len(a)
    return bool(np.array_equal(a[at:], b[at + 1 :]))


_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines and words of each text, from the bytes of all; 0 of null texts."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    edges = at - at[0] if len(at) else at
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    some = np.flatnonzero(edges[:-1] < edges[1:])
    first = edges[some]
    begins[first] = ~space[first]  # a text's first byte has none before it
    lines, words = np.zeros((2, len(column)), np.int64)
    if len(some):
        lines[some], words[some] = (np.add.reduceat(x, first, dtype=np.int64) for x in (raw == 10, begins))
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), lines + 1, 0), words


def line_table(docs: DataFrame, key: str, text: str, letters: int | None = None) -> DataFrame:
    """doc, line, h and the hashes of halves k0 .. k3 (null for short lines) of every line with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            raws = raw_texts(batch.column(1))
            for a, b in slices(map(len, raws), SLICE):
                lines = Lines(raws[a:b], cache, letters=letters)
                short = pa.array(lines.size < NEAR_WORDS)
                h = [pa.compute.if_else(short, pa.scalar(None, pa.int64()), signed(k)) for k in lines.halves()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(lines.owner)), pa.array(lines.number.astype(np.int32)), signed(lines.full()), *h], ["doc", "line", "h", "k0", "k1", "k2", "k3"])

    rows = docs.select(docs[key].alias("doc"), docs[text].alias("text")).where("doc is not null and text is not null")
    return rows.mapInArrow(tidied(run), f"doc {docs.schema[key].dataType.simpleString()}, line int, h bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint")


def neighbours(docs: DataFrame, key: str, text: str, distinct: DataFrame) -> DataFrame:
    """Hashes h of distinct lines that have an earlier neighbour. distinct: h, first (struct of doc and line), k0 .. k3."""
    doc_kind = docs.schema[key].dataType.simpleString()
    # lines that share a half with another
    halves = distinct.where("k0 is not null").select("h", "first", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    shared = halves.groupBy("k").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("k")
    # numbered in the order of their first places, which the partitions of a sort follow
    likely = halves.join(shared, "k").select("h", "first").distinct().orderBy("first", "h").select("h", "first", F.monotonically_increasing_id().alias("line"))
    likely = scratch(likely, "likely")
    by_doc = scratch(likely.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct("first.line", "h", F.col("line").alias("n"))).alias("lines")), "by-document")

    def found(batch: pa.RecordBatch, a: int, b: int, cache: WordHashes) -> tuple[Lines, np.ndarray]:
        """The likely lines of some texts and their numbers, -1 for a line of another text with the same id."""
        told = [{x["line"]: (x["h"], x["n"]) for x in rows} for rows in batch.column(2).slice(a, b - a).to_pylist()]
        lines = Lines(raw_texts(batch.column(1).slice(a, b - a)), cache, [sorted(t) for t in told])
        own = [told[d][k] for d, k in zip(lines.owner.tolist(), lines.number.tolist(), strict=True)]
        h, n = (np.array([x[i] for x in own], np.int64) for i in (0, 1))
        return lines, np.where(h == lines.full().view(np.int64), n, -1)

    def spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        return slices((n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()), SLICE // 8)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for a, b in spans(batch):
                lines, n = found(batch, a, b, cache)
                line, i, v = lines.variants()
                # 0: same variant at the same word; 1: the variant as a line; 2: the line itself
                place = mix64(v ^ (i.astype(np.uint64) + np.uint64(1)) * SPREAD)
                k = np.concatenate((place, v, lines.full()))
                role = np.concatenate((np.zeros(len(line)), np.ones(len(line)), np.full(len(n), 2))).astype(np.int8)
                of = np.concatenate((n[line], n[line], n))
                some = of >= 0
                yield pa.RecordBatch.from_arrays([signed(k[some]), pa.array(role[some]), pa.array(of[some])], ["k", "role", "line"])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for a, b in spans(batch):
                lines, n = found(batch, a, b, cache)
                words = pa.ListArray.from_arrays(pa.array(lines.at.astype(np.int32)), signed(lines.words))
                yield pa.RecordBatch.from_arrays([pa.array(n), words], ["line", "words"]).filter(pa.array(n >= 0))

    rows = prefilter(docs.select(docs[key].alias("doc"), docs[text].alias("text")).where("doc is not null and text is not null"), "doc", by_doc)
    rows = scratch(rows.join(by_doc, "doc"), "near-lines")
    keys = scratch(rows.mapInArrow(tidied(emit), "k bigint, role tinyint, line bigint"), "variants")
    least = keys.groupBy("k").agg(*(F.min(F.when(F.col("role") == r, F.col("line"))).alias(f"m{r}") for r in (0, 1, 2)), F.count(F.lit(1)).alias("n"))
    least = scratch(least.where("n > 1"), "deciders")
    decider = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    met = spread_join(prefilter(keys, "k", least), least, "k", "n", keys.count()).withColumn("by", decider).where("by < line")
    pairs = scratch(met.select("line", "by").distinct(), "decided")
    words = rows.mapInArrow(tidied(words_of), "line bigint, words array<bigint>").groupBy("line").agg(F.first("words").alias("words"))
    words = scratch(words, "words")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    both = salted_join(scratch(pairs.join(words, "line"), "pairs"), words.select(F.col("line").alias("by"), F.col("words").alias("others")), "by", "line")
    return both.where(verified("words", "others")).select("line").distinct().join(likely, "line").select("h").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", at: str = "line_dedup", letters: int | None = LETTERS) -> DataFrame:
    """docs with a struct column `at`: the new text, n_lines, n_removed, n_words and n_words_removed. Other columns stay as they are."""
    bounded_batches(docs.sparkSession)
    lines = scratch(line_table(docs, key, text, letters), "lines")
    firsts = lines.groupBy("h").agg(F.min(F.struct("doc", "line")).alias("first"), *(F.max(f"k{i}").alias(f"k{i}") for i in range(4)), F.count(F.lit(1)).alias("n"))
    firsts = scratch(firsts, "distinct")
    near = neighbours(docs, key, text, firsts).withColumn("near", F.lit(True))
    decided = scratch(firsts.select("h", "first", "n").join(near, "h", "left").where("n > 1 or near"), "repeated")
    places = prefilter(lines.select("doc", "line", "h"), "h", decided)
    gone = spread_join(places, decided, "h", "n", lines.count()).where(F.col("near").isNotNull() | (F.struct("doc", "line") > F.col("first")))
    of, marks, hit = (unused(c, docs) for c in ("__doc", "__gone", "__hit"))
    listed = scratch(gone.groupBy(F.col("doc").alias(of)).agg(F.collect_list(F.struct("line", "h")).alias(marks)), "gone")

    @F.arrow_udf("text string, n_lines bigint, n_removed bigint, n_words bigint, n_words_removed bigint")
    def rewritten(column: pa.Array, gone: pa.Array) -> pa.Array:
        n_lines, n_words = counted(column)
        removed, words_removed = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        new: list[str | None] = [None] * len(column)  # of texts that lose a line
        cache = WordHashes()
        for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False)).tolist():
            raw, want = column[i].as_py().encode("utf-8", "replace"), {(m["line"], m["h"]) for m in gone[i].as_py()}
            found = Lines([raw], cache, [sorted({k for k, _ in want})], letters)
            told = zip(found.number.tolist(), found.full().view(np.int64).tolist(), found.size.tolist(), strict=True)
            drop = {k: n for k, h, n in told if (k, h) in want}
            if drop:
                removed[i], words_removed[i] = len(drop), sum(drop.values())
                new[i] = b"\n".join(p for k, p in enumerate(raw.split(b"\n")) if k not in drop).decode()
            if len(cache) > CACHED:
                cache.clear()
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), *map(pa.array, (n_lines, removed, n_words, words_removed))], ["text", "n_lines", "n_removed", "n_words", "n_words_removed"])

    # only documents that the filter lets through are dealt out to meet their marks
    told = marked(docs, key, listed.withColumnRenamed(of, key), hit)
    touched = told.where(F.col(hit)).join(listed, F.col(key) == F.col(of), "left").select(*docs.columns, marks)
    others = told.where(~F.col(hit)).select(*docs.columns, F.lit(None).cast(listed.schema[marks].dataType).alias(marks))
    both = touched.unionByName(others)
    told, own = rewritten(both[text], both[marks]), unused("__told", both)
    out = both.withColumn(own, told)
    kept = F.when(F.col(own)["n_removed"] > 0, F.col(own)["text"]).otherwise(F.col(text))  # other texts needn't come back
    fields = [kept.alias("text"), *(F.col(own)[c].alias(c) for c in ("n_lines", "n_removed", "n_words", "n_words_removed"))]
    return out.withColumn(at, F.struct(*fields)).drop(marks, own)
