"""Language identification by rank-order profiles of n-grams.

A language's profile is the list of its texts' most frequent n-grams, of one to
three characters within padded words. A document's own list, over its whole
text, is compared with each profile by the out-of-place distance: how many
ranks apart an n-gram stands in both lists, or the greatest distance if the
profile lacks it. The nearest language wins.

An n-gram is one exact number: its code points, of 21 bits each, from the left.
So its order is the n-grams' own, and a text's list is a sort of numbers.

Profiles are learnt from a bounded sample: at most SAMPLE texts of each language,
chosen by a hash of their ids, of the LANGUAGES that have the most labelled ids.

Defined results: `und` with score 0 for null texts, texts without letters, and
when nothing was learnt; ties between languages go to the one that comes first by
name, between n-grams to the lesser one; texts of any length are taken whole, in
parts cut at white space. An id that comes with several languages counts for the
first by name, one with several texts for the least; rows without an id teach
nothing but are judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.codepoints import LETTER, classes, code_points, pieces
from tidepool.llm.shared import bounded_batches, thinned

PROFILE, OWN, SAMPLE, LANGUAGES = 600, 300, 1000, 512
#: Characters of a text counted in one go.
SLICE = 500_000
UNKNOWN, BLANK = "und", np.uint64(ord(" "))
FIRST, SECOND = np.uint64(42), np.uint64(21)


def grams(text: str) -> np.ndarray:
    """The n-grams of all words of a text, each word between two blanks; the blanks alone don't count."""
    points = code_points(text.lower())
    letters = np.flatnonzero(classes()[points] == LETTER)
    if not len(letters):
        return np.zeros(0, np.uint64)
    word = np.cumsum(np.concatenate(([1], np.diff(letters) > 1)))  # neighbouring words share the blank between them
    row = np.full(len(letters) + word[-1] + 1, BLANK)
    row[np.arange(len(letters)) + word] = points[letters]
    inner = row[1:-1] != BLANK
    pairs = (row[:-1] << FIRST) | (row[1:] << SECOND)
    return np.concatenate((row[row != BLANK] << FIRST, pairs, pairs[:-1][inner] | row[2:][inner]))


def spelled(gram: int) -> str:
    return "".join(chr(gram >> shift & 0x1FFFFF) for shift in (42, 21, 0) if gram >> shift & 0x1FFFFF)


def summed(grams_: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once, in order, with its counts added up."""
    some, where = np.unique(grams_, return_inverse=True)
    return some, np.bincount(where, weights=counts, minlength=len(some)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, in order, and how often they come."""
    out = None
    for part in pieces(text, SLICE):
        new = np.unique(grams(part), return_counts=True)
        out = new if out is None else summed(*(np.concatenate(x) for x in zip(out, new, strict=True)))
    return out


def ranked(text: str, n: int) -> np.ndarray:
    """The n most frequent n-grams of a text; ties by the n-gram itself."""
    some, counts = gram_counts(text)
    if len(some) > n:  # all that tie with the last one go into the sort
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some, counts = some[counts >= least], counts[counts >= least]
    return some[np.argsort(-counts, kind="stable")[:n]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", usable=None, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A profile for each language: its n-grams, most frequent first. usable: a condition on the id column."""
    bounded_batches(docs.sparkSession)
    use = F.col(lang).isNotNull() & F.col(key).isNotNull()
    ids = docs.where(use if usable is None else use & usable).groupBy(F.col(key).alias("id")).agg(F.min(lang).alias("lang"))
    most = F.broadcast(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = ids.join(most, "lang").where(thinned(F.col("id"), F.col("rows"), sample)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("id", "lang")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # `sample` ids for each language
    rows = rows.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for name, texts in frame.groupby("lang")["text"]:
                parts = [gram_counts(t) for t in texts if t]
                if parts:
                    parts += [totals[name]] if name in totals else []
                    totals[name] = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for name, (some, counts) in totals.items():
            yield pd.DataFrame({"lang": name, "gram": some.astype(np.int64), "n": counts})

    added = rows.select("text", "lang").mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = added.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "r").collect():  # PROFILE rows for each of at most LANGUAGES
        out.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.array(x, np.uint64) for name, x in out.items()}


class Identifier:
    """All profiles as one sorted table of n-grams with their ranks in each language, -1 where it lacks them."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)  # the last column: no profile has it
        for row, name in zip(self.ranks, self.langs, strict=True):
            row[np.searchsorted(self.known, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, OWN) if text and len(self.known) else np.zeros(0, np.uint64)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = self.ranks[:, np.where(self.known[at] == own, at, len(self.known))]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        order = np.argsort(apart, kind="stable")
        best = int(order[0])
        # how sure: the share of the greatest distance that is saved, against the runner-up's
        saved = 1 - apart / (PROFILE * len(own))
        second = saved[order[1]] if len(order) > 1 else 0.0
        return self.langs[best], float(saved[best] / (saved[best] + second)) if saved[best] > 0 else 0.0


def identifier(spark, profiles: dict[str, np.ndarray]):
    """The profiles as a column function of a text: struct of lang_pred and score."""
    sent = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def language(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = Identifier(sent.value)
        for column in frames:
            yield pd.DataFrame([one.predict(t) for t in column], columns=["lang_pred", "score"])

    return language
