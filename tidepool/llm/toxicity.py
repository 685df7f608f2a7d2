"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (positives) and the corpus as a whole (unlabelled, the
positives among it) train a linear classifier over the words that stand out among
the toxic ones. Labels that say a text isn't toxic are not used.

Risk: with the class prior p, the loss of positives as positives counts p times; the
loss of the whole as negatives, less p times that of positives as negatives, is the
negatives' part, and may not fall below zero. The loss is the sigmoid, which a few
far outliers can't dominate. The mean over the whole is taken in two strata,
confirmed positives and all other rows, by their exact shares: so positives stand on
both sides of the risk, and their chance numbers in a sample don't matter.

Prior: for any property, its share in the whole is at least p times its share among
positives. The property is holding one of the words that stand out most, for ever
more words; of the ratios whose property at least half the positives have, the least
upper confidence bound (two standard errors) is the prior. If too few labels bound it below
MOST, it is what the labels themselves show: the share of confirmed positives in the whole.

Words: those whose share among positives is far above their share among negatives,
which follows from whole, positives and prior. A text without any of them is no likelier
toxic than the prior says: the bias stays at or below the prior's log-odds, which are negative.

The fit uses bounded samples: at most SAMPLE positives and 2 x SAMPLE other texts,
chosen by a hash of their ids; whole texts of those. Scores are of whole texts of
all rows.

Defined results: without a usable toxic label, with nothing but toxic ones, or with so few
that no word stands out beyond chance, every score is 0; null and wordless texts score as a text without any known word does;
ids whose labels disagree count as toxic; an id that comes with several texts counts
for the least of them in the fit, each of its rows is scored; words that tie are
taken in their own order; texts of any length are taken whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import bounded_batches, scratch, sigmoid, thinned, tidy

SAMPLE, FEATURES, STEPS, RATE, RIDGE = 3000, 1024, 1500, 0.05, 1e-5
#: A word takes part if so many positives have it, with so many times the others' share, and if chance would bring any
#: of the words so far only this rarely. CANDIDATES words are tested on the driver.
LEAST, LIFT, CHANCE, CANDIDATES = 3, 2.0, 0.01, 20_000
#: Standard errors of the prior's bounds, and the greatest prior.
ERRORS, MOST = 2.0, 0.5
WORD = regex.compile(r"[\p{L}\p{N}]+")


def vocabulary(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Model:
    def __init__(self, words: list[str], weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(words, map(float, weights), strict=True)), bias

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:  # nothing was learnt
            return 0.0
        get = self.weights.get
        return float(sigmoid(self.bias + sum(get(w, 0.0) for w in vocabulary(text))))


def log_tail(k: int, n: int, share: float) -> float:
    """Logarithm of a bound on the chance of k or more hits in n, if each comes with this share."""
    seen = k / n
    if seen <= share:
        return 0.0
    rest = (1 - seen) * math.log((1 - seen) / (1 - share)) if seen < 1 else 0.0
    return -n * (seen * math.log(seen / share) + rest)


def train(positive: list[np.ndarray], other: list[np.ndarray], n: int, prior: float, share: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (sigmoid loss, Adam). share: of the positives in the whole."""

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)

    w, b = np.zeros(n), math.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)

    def loss(side: tuple[np.ndarray, np.ndarray, int]) -> tuple[float, np.ndarray]:
        """Mean loss as negatives, and its gradient."""
        feature, row, rows = side
        p = sigmoid(b + np.bincount(row, weights=w[feature], minlength=rows))
        slope = p * (1 - p)
        return p.mean(), np.append(np.bincount(feature, weights=slope[row], minlength=n), slope.sum()) / rows

    sides, most = (flat(positive), flat(other)), math.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        (of_p, down_p), (of_o, down_o) = loss(sides[0]), loss(sides[1])
        negatives = share * of_p + (1 - share) * of_o - prior * of_p
        down = share * down_p + (1 - share) * down_o - prior * down_p
        g = down - prior * down_p if negatives >= 0 else -down  # as positives, the loss is 1 less the loss as negatives
        g[:-1] += RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], min(most, b - step[-1])
    return w, float(b)


def class_prior(positive: list[np.ndarray], other: list[np.ndarray], order: list[int], n: int, share: float) -> float:
    """The share of toxic texts in the whole. order: the words, of n, that stand out, most first."""
    place = np.full(n, len(order))
    place[order] = np.arange(len(order))
    # the first word of the order that a text has: it has one of the k first if that is below k
    first = [np.sort([place[row].min(initial=len(order)) for row in rows]) for rows in (positive, other)]
    best = MOST
    for k in range(1, len(order) + 1):
        p, o = (np.searchsorted(f, k) / len(f) for f in first)
        if p >= 0.5:
            whole = share * p + (1 - share) * o + ERRORS * (1 - share) * math.sqrt(o * (1 - o) / len(other))
            best = min(best, whole / max(1e-9, p - ERRORS * math.sqrt(p * (1 - p) / len(positive))))
    return max(share, best) if best < MOST else share


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", usable=None, sample: int = SAMPLE, prior: float | None = None) -> Model:
    """Trains on bounded samples. usable: a condition on the id column, for rows whose labels may be used; prior: the class prior, if known."""
    bounded_batches(docs.sparkSession)
    nothing = Model([], np.zeros(0), -np.inf)
    order = F.xxhash64(F.col("id").cast("string"))
    use = F.col(key).isNotNull() if usable is None else F.col(key).isNotNull() & usable
    toxic = labels.where(use & (F.col(label) == 1)).select(F.col(key).alias("id"), F.lit(True).alias("toxic")).distinct()
    ids = docs.where(use).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("rows")).join(toxic, "id", "left")
    ids = scratch(ids.select("id", "rows", F.coalesce("toxic", F.lit(False)).alias("toxic")), "ids")
    held = {r["toxic"]: r for r in ids.groupBy("toxic").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("ids")).collect()}
    if len(held) < 2:
        return nothing
    share = held[True]["rows"] / (held[True]["rows"] + held[False]["rows"])
    few = {side: ids.where(F.col("toxic") == side).where(thinned(F.col("id"), F.lit(float(held[side]["ids"])), n)).orderBy(order, "id").limit(n) for side, n in ((True, sample), (False, 2 * sample))}
    chosen = few[True].union(few[False]).select("id", "toxic")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most 3 x sample ids
    rows = scratch(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")), "sampled")

    @F.pandas_udf("array<string>")
    def words(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sorted(vocabulary(t)))

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_o = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_o:
        return nothing
    seen = rows.select("toxic", F.explode(words("text")).alias("word")).groupBy("word")
    seen = seen.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum((~F.col("toxic")).cast("long")).alias("o")).where(F.col("p") >= LEAST)
    ratio = (F.col("p") / n_p) / ((F.col("o") + 1) / (n_o + 1))
    found = seen.where(ratio > 1).orderBy(F.desc(F.col("p") * F.log(ratio)), "word").limit(CANDIDATES).collect()
    place = {r["word"]: k for k, r in enumerate(found)}
    sent = docs.sparkSession.sparkContext.broadcast(place)

    @F.pandas_udf("binary")
    def features(column: pd.Series) -> pd.Series:
        return column.map(lambda t: np.array(sorted(sent.value[w] for w in vocabulary(t) if w in sent.value), "<i4").tobytes())

    sampled = rows.select("toxic", features("text").alias("f")).collect()  # at most 3 x sample rows of at most CANDIDATES numbers
    positive, other = ([np.frombuffer(r["f"], "<i4") for r in sampled if r["toxic"] == side] for side in (True, False))
    del sampled

    def certain(k: int, against: float) -> bool:
        mine = found[k]["p"] / n_p
        return mine >= LIFT * against and log_tail(found[k]["p"], n_p, min(against, 1 - 1e-9)) < math.log(CHANCE / CANDIDATES)

    whole = [share * r["p"] / n_p + (1 - share) * (r["o"] + 1) / (n_o + 1) for r in found]
    if prior is None:
        standing = sorted((k for k in range(len(found)) if certain(k, whole[k])), key=lambda k: (whole[k] / found[k]["p"], k))
        prior = class_prior(positive, other, standing, len(found), share)
    prior = min(MOST - 1e-3, max(1e-4, prior))
    negatives = [max(1 / (n_o + 1), (whole[k] - prior * r["p"] / n_p) / (1 - prior)) for k, r in enumerate(found)]
    taken = [k for k in range(len(found)) if certain(k, negatives[k])]
    if not taken:
        return nothing
    taken = sorted(taken, key=lambda k: (-found[k]["p"] * math.log(found[k]["p"] / n_p / negatives[k]), k))[:FEATURES]
    number = np.full(len(found), -1)
    number[taken] = np.arange(len(taken))
    own = [[number[f][number[f] >= 0] for f in side] for side in (positive, other)]
    weights, bias = train(*own, len(taken), prior, share)
    model = Model([found[k]["word"] for k in taken], weights, bias)
    del found, place, positive, other, own
    tidy()
    return model


def scorer(spark, model: Model):
    """The model as a column function of a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(column: pd.Series) -> pd.Series:
        one = sent.value
        return pd.Series([one.score(t) for t in column], dtype=float)

    return toxicity
