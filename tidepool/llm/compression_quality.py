"""Quality by compression: which of two dictionaries suits a text better.

Snippets of good and of bad labelled texts make two zstandard dictionaries. A
whole text is compressed in windows, once with each; the difference of the two
sizes, divided by their sum, says which kind it is like. This is done for the
text as it is and for its shape (letters as one letter, capitals as another,
digits as a third), which has its own two dictionaries. A logistic curve over
both differences, fitted on labelled texts that gave no snippets and weighted by
the labels' shares, makes the calibrated score.

The fit uses bounded samples: at most SAMPLE texts of each label and part,
chosen by a hash of their ids, and SNIPPETS snippets for a dictionary.

Defined results: a null or empty text has differences 0 and gets the curve's
value there; with labels of one kind only, or none, every score is that share
(0.5 for none); ids whose labels disagree count as bad; an id that comes with several
texts counts for the least of them in the fit, each of its rows is scored; snippets
that tie in their hash are taken by id and place; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import bounded_batches, scratch, sigmoid

SAMPLE, SNIPPET, SNIPPETS, DICTIONARY, WINDOW, LEVEL = 1500, 1024, 600, 64 << 10, 1024, 9


def shape_table() -> bytes:
    """Letters, with all bytes beyond ASCII, as `a`; capitals as `A`; digits as `0`."""
    return bytes(b"A"[0] if chr(c).isupper() else b"0"[0] if chr(c).isdigit() else b"a"[0] if chr(c).isalpha() else c for c in range(128)) + b"a" * 128


SHAPE = shape_table()


def windows(raw: bytes, size: int) -> Iterator[bytes]:
    for i in range(0, len(raw), size):
        yield raw[i : i + size]


def views(text: str | None) -> tuple[bytes, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return raw, raw.translate(SHAPE)


class Compressor:
    """dictionaries: for each view of a text the good one and the bad one."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]):
        def own(content: bytes) -> zstandard.ZstdCompressor:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False)

        self.pairs = [(own(good), own(bad)) for good, bad in dictionaries]

    def differences(self, text: str | None) -> list[float]:
        """Above 0 if the good dictionary makes the view smaller."""
        out = []
        for raw, (good, bad) in zip(views(text), self.pairs, strict=True):
            x = y = 0
            for w in windows(raw, WINDOW):
                x += len(good.compress(w))
                y += len(bad.compress(w))
            out.append((y - x) / (y + x) if raw else 0.0)
        return out


def dictionary(snippets: list[bytes]) -> bytes:
    """The content of a dictionary: one trained by zstandard on the snippets, then snippets themselves, the last bytes being the cheapest to refer to."""
    joined = b"\n".join(snippets)
    try:
        trained = zstandard.train_dictionary(DICTIONARY, snippets).as_bytes()
    except zstandard.ZstdError:  # too few snippets
        return joined[-DICTIONARY:]
    header = 8 + 256  # the tables in front of the content say nothing about the texts
    return joined[-DICTIONARY:] + trained[header:]


def calibrate(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Slopes and intercept of the logistic curve (Newton with a small ridge). share: of label 1 among all labels."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.hstack((x / scale, np.ones((len(x), 1))))
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ (weight * (p - y)) + 1e-4 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w[:-1] / scale, float(w[-1])


class Model:
    def __init__(self, dictionaries: list[tuple[bytes, bytes]], slopes: np.ndarray, intercept: float):
        self.dictionaries, self.slopes, self.intercept = dictionaries, slopes, intercept


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", usable=None, sample: int = SAMPLE) -> Model:
    """Trains on bounded samples. usable: a condition on the id column, for rows whose labels may be used."""
    use = F.col(key).isNotNull() if usable is None else F.col(key).isNotNull() & usable
    bounded_batches(docs.sparkSession)
    order = F.xxhash64(F.col(key).cast("string"))
    known = labels.where(use & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else min(1 - 1e-6, max(1e-6, share))
    part = F.pmod(order, F.lit(2)).cast("int")
    chosen = None
    for y in (0, 1):
        for p in (0, 1):
            one = known.where((F.col("y") == y) & (part == p)).orderBy(order, key).limit(sample).select(F.col(key).alias("__id"), F.lit(y).alias("y"), F.lit(p).alias("part"))
            chosen = one if chosen is None else chosen.union(one)
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")  # 4 x sample ids
    rows = scratch(rows.groupBy("__id", "y", "part").agg(F.min("__text").alias("__text")), "sampled")

    @F.pandas_udf("array<binary>")
    def snippets(column: pd.Series) -> pd.Series:
        return pd.Series([[s for s in windows((t or "").encode("utf-8", "replace"), SNIPPET) if len(s) >= SNIPPET // 8] for t in column], dtype=object)

    cut = rows.where("part = 0").select("__id", "y", F.posexplode(snippets("__text")).alias("k", "s"))
    taken: list[list[bytes]] = []
    for y in (1, 0):
        best = cut.where(F.col("y") == y).orderBy(F.xxhash64(F.col("__id").cast("string"), "k"), "__id", "k").limit(SNIPPETS).collect()
        taken.append([bytes(r["s"]) for r in best])
    if not all(taken):
        return Model([], np.zeros(2), float(np.log(share / (1 - share))))
    dictionaries = [tuple(dictionary(t) for t in taken), tuple(dictionary([s.translate(SHAPE) for s in t]) for t in taken)]
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("array<double>")
    def differences(column: pd.Series) -> pd.Series:
        one = Compressor(sent.value)
        return pd.Series([one.differences(t) for t in column], dtype=object)

    got = rows.where("part = 1").select("y", differences("__text").alias("x")).collect()  # 2 x sample pairs of numbers
    if len({r["y"] for r in got}) < 2:
        return Model(dictionaries, np.full(2, 50.0), 0.0)
    slopes, intercept = calibrate(np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float), share)
    return Model(dictionaries, slopes, intercept)


def scorer(spark, model: Model):
    """The model as a column function of a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        one = Compressor(m.dictionaries) if m.dictionaries else None
        for column in frames:
            x = np.array([one.differences(t) if one else [0.0, 0.0] for t in column], float).reshape(-1, 2)
            yield pd.Series(sigmoid(x @ m.slopes + m.intercept), dtype=float)

    return quality
