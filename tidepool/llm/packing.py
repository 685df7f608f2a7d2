"""Best-fit packing by non-negative least squares over length patterns.

Every document becomes its token ids and an end id. Only documents longer than
a sequence are cut, into full pieces with the shorter piece first. The plan is
made on the histogram of piece lengths alone (at most `capacity` numbers):

1. enumerate patterns of up to three lengths that fill a sequence exactly (all
   pairs, and evenly chosen triples);
2. fit repeat counts x >= 0 so that the patterns' lengths add up to the histogram
   (least squares, multiplicative updates, which keep x non-negative);
3. round down, then up by largest remainder as far as the histogram goes, and fit
   again on what is left, until nothing more can be placed so;
4. pack the residual lengths by best fit, longest first, many equal bins at once;
5. repair: sequences with room left, and a growing share of the full ones, are taken
   apart and packed anew together; what needs fewer sequences stays. That ends at the
   lower bound (all lengths over the capacity), or when all shares have been tried.
   The last is all of them, so a plan never needs more than best fit alone.

A pattern repeated n times takes a range of n ranks of each of its lengths, so
a piece finds its sequence from its length and its rank among equal lengths.
Ranks come from counts for each task and length, summed over the tasks: no
length, however common, meets in one task.

Defined results: null and empty texts are one piece that holds the end id;
repeated rows are packed as often as they come; rows with a null key are packed
too; an empty table gives no rows; columns of docs other than key and text don't
matter, and a key column that is called like one of the result's is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.bpe import SLICE, ByteLevelEncoder, merge_table
from tidepool.llm.shared import bounded_batches, offsets, ragged, scratch, slices, texts, tidied, tidy

CAPACITY, END_ID = 1024, 2
#: Updates of a fit, fits of a plan, and repairs with each share.
ROUNDS, FITS, REPAIRS = 1500, 4, 6
#: Patterns of three lengths that take part; each number is tried and the plan with the fewest sequences kept.
TRIPLES = (2500, 600, 100)
#: A pattern is rounded up only if its remainder is at least this.
REMAINDER = 0.05
#: Shares of the full sequences that repairs take apart.
APART = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)

#: How often a kind of sequence comes, the lengths in it, and whether a fitted pattern made it.
Kind = tuple[int, tuple[int, ...], bool]


def patterns(capacity: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0, b > 0 and a + b + c = capacity; 0 stands for no piece."""
    b, c = np.meshgrid(np.arange(1, capacity), np.arange(0, capacity // 3 + 1), indexing="ij")
    a = capacity - b - c
    ok = (b >= c) & (a >= b)
    return np.stack((a[ok], b[ok], c[ok]), axis=1)


def fit(histogram: np.ndarray, triples: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The patterns whose lengths all occur, and real repeat counts for them."""
    capacity = len(histogram) - 1
    found = patterns(capacity)
    found = found[np.all((found == 0) | (histogram[found] > 0), axis=1)]
    every = max(1, round(np.count_nonzero(found[:, 2]) / triples))
    found = found[(found[:, 2] == 0) | (found @ np.array([7, 13, 29]) % every == 0)]
    if not len(found):
        return found, np.zeros(0)
    target = histogram.astype(float)
    target[0] = 0
    weight = np.arange(capacity + 1) / capacity  # long pieces are the hard ones to place later
    weight[0] = 0
    gather = lambda r: r[found].sum(axis=1)
    scatter = lambda x: np.bincount(found.ravel(), weights=np.repeat(x, 3), minlength=capacity + 1)
    want = gather(weight * target)
    x = np.full(len(found), target.sum() / 3 / len(found))
    for _ in range(rounds):
        x *= want / np.maximum(gather(weight * scatter(x)), 1e-12)
    return found, x


def sequences(kinds: list[Kind]) -> int:
    return sum(n for n, _, _ in kinds)


def by_patterns(kinds: list[Kind]) -> int:
    """Pieces that lie in sequences which a fitted pattern made."""
    return sum(n * len(lengths) for n, lengths, fitted in kinds if fitted)


def plan(histogram: np.ndarray) -> list[Kind]:
    """All kinds of sequence; together they hold every piece once. Of the plans tried the shortest, and among those the one that patterns made most of."""
    return min((planned(histogram, n) for n in TRIPLES), key=lambda kinds: (sequences(kinds), -by_patterns(kinds)))


def planned(histogram: np.ndarray, triples: int) -> list[Kind]:
    """The plan from fits with so many triples."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[Kind] = []
    if left[capacity]:
        out.append((int(left[capacity]), (capacity,), True))
        left[capacity] = 0
    for _ in range(FITS):
        new = rounded(*fit(left, triples), left)
        if not new:
            break
        out += new
    least = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    return repaired(out + best_fit(left), capacity, least)


def rounded(found: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[Kind]:
    """The patterns by whole numbers near x, the greatest first; their lengths leave the histogram `left`."""
    out: list[Kind] = []

    def place(k: int, n: int) -> None:
        lengths = tuple(int(m) for m in found[k] if m)
        n = min(n, *(int(left[m]) // lengths.count(m) for m in lengths))
        if n > 0:
            out.append((n, lengths, True))
            for m in lengths:
                left[m] -= n

    whole = np.floor(x)
    for k in np.argsort(-x, kind="stable")[: np.count_nonzero(whole)]:
        place(k, int(whole[k]))
    for k in np.argsort(whole - x, kind="stable")[: np.count_nonzero(x - whole >= REMAINDER)]:
        place(k, 1)
    return out


def repaired(kinds: list[Kind], capacity: int, least: int) -> list[Kind]:
    """The kinds, or fewer sequences. Which full sequences are taken apart follows from fixed seeds."""
    for share in APART:
        for seed in range(REPAIRS if 0 < share < 1 else 1):
            if sequences(kinds) <= least:
                return kinds
            rng, kept, left = np.random.default_rng(seed), [], np.zeros(capacity + 1, np.int64)
            for n, lengths, fitted in kinds:
                gone = n if sum(lengths) < capacity else int(rng.binomial(n, share)) if len(lengths) > 1 else 0
                if n > gone:
                    kept.append((n - gone, lengths, fitted))
                for m in lengths:
                    left[m] += gone
            new = kept + best_fit(left)
            if sequences(new) < sequences(kinds):
                kinds = new
    return kinds


def best_fit(left: np.ndarray) -> list[Kind]:
    """Best fit decreasing; equal bins are kept as one entry with a count."""
    capacity = len(left) - 1
    free: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = next((f for f in range(length, capacity + 1) if free[f]), None)
            bins, held = free[room].pop() if room is not None else (count, ())
            room = capacity if room is None else room
            each = room // length
            if count < each:
                each = count
            use = min(bins, count // each)
            if held and bins > use:
                free[room].append((bins - use, held))
            free[room - each * length].append((use, held + (length,) * each))
            count -= use * each
    return [(n, held, False) for entries in free for n, held in entries]


def slots(kinds: list[Kind]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: the first sequence number and the place in the sequence."""
    rows, used, sequence = [], {}, 0
    for n, lengths, _ in kinds:
        at = 0
        for m in lengths:
            rows.append((m, used.get(m, 0), sequence, at))
            used[m] = used.get(m, 0) + n
            at += m
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 44 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def cut(size: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces."""
    n = -(-size // capacity)
    first = size - (n - 1) * capacity
    start = np.concatenate(([0], first + capacity * np.arange(n - 1)))
    return start, np.concatenate(([first], np.full(n - 1, capacity)))


def pieces(docs: DataFrame, tokenizer: str, text: str, key: str, capacity: int, end_id: int, columns: Callable[[np.ndarray, np.ndarray], dict], kinds: str) -> DataFrame:
    """A row for each piece, with the task that made it and its rank among that task's pieces of equal length."""
    key_kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = ByteLevelEncoder(merge_table(tokenizer))
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for a, b in slices(sizes, SLICE):
                ids, at = encoder.encode(texts(batch.column(1).slice(a, b - a)))
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                cuts = [cut(n, capacity) for n in np.diff(at).tolist()]
                number = np.array([len(s) for s, _ in cuts])
                start, length = (np.concatenate([c[k] for c in cuts]) for k in (0, 1))
                order = np.argsort(length, kind="stable")
                runs = np.diff(offsets(np.bincount(length, minlength=capacity + 1)))
                rank = np.empty(len(length), np.int64)
                rank[order] = ragged(np.zeros(capacity + 1, np.int64), runs) + seen[length[order]]
                seen += runs
                row = np.repeat(np.arange(b - a), number)
                yield pa.RecordBatch.from_pydict(
                    {
                        key: batch.column(0).slice(a, b - a).take(pa.array(row)),
                        "piece": pa.array(ragged(np.zeros(b - a, np.int64), number).astype(np.int32)),
                        "start": pa.array(start.astype(np.int64)),
                        "length": pa.array(length.astype(np.int64)),
                        "task": pa.array(np.full(len(row), task, np.int32)),
                        "rank": pa.array(rank),
                        **columns(ids, offsets(length)),
                    }
                )

    return docs.select(docs[key].alias(key), docs[text].alias("__text")).mapInArrow(tidied(run), f"`{key}` {key_kind}, piece int, start bigint, length bigint, task int, rank bigint, {kinds}")


def with_ids(ids: np.ndarray, at: np.ndarray) -> dict:
    return {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))}


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    columns: Callable[[np.ndarray, np.ndarray], dict] = with_ids,
    kinds: str = "ids array<int>",
) -> DataFrame:
    """Key, piece, start, length, sequence_id and offset of every piece, with its ids or what `columns` makes of them.

    The pieces are written to the shared folder once, so ranks stay the same
    if an executor is lost. What is broadcast is the plan, whose size depends on
    `capacity` and not on the number of rows. Where a task's ranks of a length begin
    is joined to its pieces: Spark broadcasts those numbers while they are smaller
    than its threshold for that, and deals both sides out by task and length beyond.
    """
    if key.lower() in ("piece", "start", "length", "task", "rank", "sequence_id", "offset"):
        raise ValueError(f"the key column may not be called {key}")
    spark = docs.sparkSession
    bounded_batches(spark)
    made = scratch(pieces(docs, tokenizer, text, key, capacity, end_id, columns, kinds), "pieces")
    counts = scratch(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(slots(plan(histogram)))
    tidy()

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = sent.value
        k = np.searchsorted(table["key"], (length.to_numpy(np.int64) << 44) | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": table["sequence"][k] + rank.to_numpy(np.int64) - table["rank"][k], "offset": table["offset"][k]})

    extra = [c for c in made.columns if c not in (key, "piece", "start", "length", "task", "rank")]
    placed = made.join(base, ["task", "length"]).withColumn("__at", place("length", F.col("rank") + F.col("base")))
    return placed.select(key, "piece", "start", "length", *extra, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))
