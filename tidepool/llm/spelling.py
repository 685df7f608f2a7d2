"""Spelling variants grouped by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point turns one into the
other. A word's form is its most frequent near word, if that is far more frequent than
the word itself; its root is where its chain of forms ends.

1. Words are counted: each task sums up what it has read in a bounded table before anything
   is shuffled.
2. Every word gives integer keys, from prefix and suffix polynomial hashes: one for the word
   without each code point at its place (two words with the same such key differ there), one
   for each different shorter word that a deletion leaves, and one for the word itself (a word
   that has another's deletion as itself lacks a code point of it).
3. Keys are dealt out by their high bits and sorted. A run of equal keys holds no more words
   than there are letters for one place, or places and letters for one inserted: the alphabet
   bounds it, not the table, however frequent a word is. The strings in a run are compared, so
   equal hashes of different words count for nothing. A pair is met in one run only.
4. Of a run each word gets how many near words it has there, and the best of them; sums and
   bests over all runs make its row. Pairs are never written.
5. Roots by pointer jumping: each step doubles the length of the chains that are through. Each
   form is `ratio` times as frequent as the word before, so chains are short.

Words over LONG code points don't send their strings along with each of their keys: their
keys are matched first, and only those that match get the strings.

Defined results: null texts have no words; a null key is passed on as such; rows that repeat
a key and text count as often as they come; of near words that tie in frequency the smallest in
code-point order is the form; columns other than key and text don't matter; an empty table
gives no rows; texts and words of any length are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.codepoints import code_points, deletion_hashes, run_hashes
from tidepool.llm.shared import bounded_batches, mix64, offsets, ragged, raw_texts, scratch, slices, tidied

#: A word's fewest code points and occurrences, and how many times as frequent its form must be.
LEAST, SEEN, RATIO = 7, 2, 10
#: Fixed: the letters that make a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it passes them on, code points of a word that sends its string with its keys, code points hashed in one go, and keys compared in one go.
COUNTED, LONG, SLICE, GROUPED = 400_000, 64, 100_000, 1 << 16
#: The high bits of a key by which keys are dealt out.
RADIX = 16
#: What a key stands for besides the place left out: the word itself; the shorter word that is left when place i goes is ~i.
ITSELF = 1 << 30
SPREAD = np.uint64(0x9E3779B97F4A7C15)
KEYED = "k bigint, place int, word string, n bigint"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seen: int = SEEN, altered: Callable[[object, Counter], Counter] | None = None) -> DataFrame:
    """word and n: the words of at least `least` code points (A-Z in lower case) that come `seen` times or more in all rows.

    altered: what a row's words and their counts become, given the row's key; a word may lose a code point by it.
    """
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist() if altered else [None] * batch.num_rows
            for k, raw in zip(keys, raw_texts(batch.column(1)), strict=True):
                found = Counter(pattern.findall(raw.lower().decode("utf-8", "replace")))  # of bytes only A-Z change
                for word, n in (altered(k, found) if altered else found).items():
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text is not null")
    return rows.mapInArrow(tidied(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def keys(words: DataFrame, named: bool = True) -> DataFrame:
    """k, place, word and n: all keys of the words. Not named: the words' ids in place of their strings and counts."""
    extra, kind = (("word", "n"), "word string, n bigint") if named else (("id",), "id bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            sizes = pa.compute.utf8_length(column).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes.tolist(), SLICE):
                points = code_points("".join(column.slice(a, b - a).to_pylist()))
                at = offsets(sizes[a:b])
                full = run_hashes(points, at[:-1], at[1:])
                word, place, h = deletion_hashes(points, at[:-1], at[1:])
                here = at[word] + place
                new = (place == 0) | (points[here] != points[here - 1])  # of equal neighbours it doesn't matter which one goes
                k = np.concatenate((mix64(h ^ (place.astype(np.uint64) + np.uint64(1)) * SPREAD), h[new], full))
                at_place = np.concatenate((place, ~place[new], np.full(b - a, ITSELF)))
                of = pa.array(np.concatenate((word, word[new], np.arange(b - a))))
                for x, y in slices(np.ones(len(k), np.int64).tolist(), GROUPED):
                    own = of.slice(x, y - x)
                    yield pa.RecordBatch.from_arrays([pa.array(k[x:y].view(np.int64)), pa.array(at_place[x:y].astype(np.int32)), *(batch.column(1 + i if not named else i).slice(a, b - a).take(own) for i in range(len(extra)))], ["k", "place", *extra])

    return words.select("word", *(c for c in extra if c != "word")).mapInArrow(tidied(run), f"k bigint, place int, {kind}")


def all_keys(words: DataFrame) -> DataFrame:
    """The keys of all words with word and n. words: id, word, n."""
    short = keys(words.where(F.length("word") <= LONG))
    long = words.where(F.length("word") > LONG)
    if long.isEmpty():
        return short
    some = scratch(keys(long, named=False), "long-keys")
    # a long word can be near one that is just not long, by that word's own key
    others = keys(words.where(F.length("word") == LONG)).where(F.col("place") == ITSELF)
    matched = some.select("k").union(others.select("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k")
    return short.unionByName(some.join(matched, "k", "left_semi").join(words, "id").select("k", "place", "word", "n"))


def without(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def met(places: list[int], words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """Of words with one key: word, how many near words it has here, and the count and word of the best of them."""
    same: dict = {}  # what is left of a word, or the word itself, tells equal hashes of different words apart
    for place, word, n in zip(places, words, counts, strict=True):
        left = (place, without(word, place)) if 0 <= place < ITSELF else (-1, word if place == ITSELF else without(word, ~place))
        same.setdefault(left, []).append((-n, word, place))
    for (place, left), rows in same.items():
        if len(rows) < 2:
            continue
        rows.sort()
        if place >= 0:  # any two of them differ at the place
            for i, (_, word, _) in enumerate(rows):
                n, best, _ = rows[i == 0]
                yield word, len(rows) - 1, -n, best
            continue
        own = next((r for r in rows if r[2] == ITSELF), None)
        if own is None:
            continue
        longer = [r for r in rows if r[2] != ITSELF]
        yield left, len(longer), -longer[0][0], longer[0][1]
        for _, word, _ in longer:
            yield word, 1, -own[0], left


def near_words(keyed: DataFrame) -> DataFrame:
    """word, n_near, and best, a struct of the count with its sign turned and the word, of every word that has a near word."""

    def groups(rows: pa.Table) -> pa.RecordBatch:
        k = rows.column("k").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(start, len(k)))
        place = rows.column("place").to_numpy()
        # a run of one word, or of longer words without their shorter one, has no near words
        useful = (size > 1) & (np.maximum.reduceat(place, start) >= 0)
        start, size = start[useful], size[useful]
        few = rows.take(pa.array(ragged(start, size)))
        places, words, counts = (few.column(c).to_pylist() for c in ("place", "word", "n"))
        at = offsets(size).tolist()
        out = [r for a, b in zip(at[:-1], at[1:], strict=True) for r in met(places[a:b], words[a:b], counts[a:b])]
        word, near, n, best = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], ["word", "near", "n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GROUPED:
                rows = pa.Table.from_batches(held).combine_chunks()
                k = rows.column("k").to_numpy()
                last = int(np.searchsorted(k, k[-1]))  # its run may go on
                if last:
                    yield groups(rows.slice(0, last))
                held, n = rows.slice(last).to_batches(), len(k) - last
        if n:
            yield groups(pa.Table.from_batches(held).combine_chunks())

    dealt = keyed.repartition(F.shiftrightunsigned("k", 64 - RADIX)).sortWithinPartitions("k")
    found = dealt.mapInArrow(tidied(run), "word string, near bigint, n bigint, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where each word's chain of forms ends. forms: word, form (words without one have no row)."""
    at = scratch(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def grouped(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word. words: word and n, each word once."""
    bounded_batches(words.sparkSession)
    words = scratch(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(all_keys(words))
    has = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    table = words.join(near, "word", "left").select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n"))
    table = scratch(table, "forms")
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seen: int = SEEN, ratio: float = RATIO, altered: Callable[[object, Counter], Counter] | None = None) -> DataFrame:
    """The words of whole texts, grouped; see grouped() and word_counts()."""
    bounded_batches(docs.sparkSession)
    return grouped(word_counts(docs, key, text, least, seen, altered), ratio)
