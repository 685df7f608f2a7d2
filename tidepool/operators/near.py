"""All near-duplicate pairs of a table of texts, as functions.text.near_duplicate defines them.

1. Equal normalised texts are one class; its smallest id stands for it.
2. Two texts of 240 characters or more with an equal head of 240 meet by that head.
3. Any other near-duplicate pair has the shorter text inside the longer one, at 0.75 of
   its length or more (a shorter head is the whole shorter text). Such pairs meet by
   anchors. With 2^j the greatest power of two within the longer length, grams have
   2^j / 4 characters and windows 2^j / 2 grams; the longer text emits the least gram
   hash of each of its windows, the shorter one that of its first window, which is one
   of the longer's windows too. So no pair is lost, and a text emits some ten anchors.
4. All that meet are verified with near_duplicate itself.

No pair is left out for its length or its place; texts under 48 characters only have
equal ones and blanks as near-duplicates, by definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as texts
from tidepool.session import written

HEAD, SHORTEST, LEAST_GRAM = 240, 48, 16
#: Odd; and its inverse modulo 2^64.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(SPREAD), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def grams(sums: np.ndarray, down: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k characters."""
    return mixed((sums[k:] - sums[:-k]) * down[: len(sums) - k])


def least_of_windows(h: np.ndarray, w: int) -> np.ndarray:
    """The least value of every run of w values: of a block's end and the next one's start."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    start = np.minimum.accumulate(blocks, axis=1).ravel()
    end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(end[:n], start[w - 1 : w - 1 + n])


def anchors(x: str) -> tuple[list[int], list[int]]:
    """Anchors of x as the longer text of a pair, and as the shorter one."""
    codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    up, down = powers(SPREAD, n + 1), powers(BACK, n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:n], dtype=np.uint64)))

    def at(level: int) -> tuple[np.ndarray, int, np.uint64]:
        return grams(sums, down, max(LEAST_GRAM, (1 << level) // 4)), (1 << level) // 2, np.uint64(level)

    own = n.bit_length() - 1
    h, w, salt = at(own)
    longer = mixed(np.unique(least_of_windows(h, w)) + salt)
    shorter = [h[:w].min()]
    salts = [salt]
    if 4 * n >= 3 << (own + 1):  # a text of the next level may hold it
        h, w, salt = at(own + 1)
        shorter.append(h[:w].min())
        salts.append(salt)
    return longer.view(np.int64).tolist(), mixed(np.array(shorter, np.uint64) + np.array(salts, np.uint64)).view(np.int64).tolist()


def all_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """other, doc_id and equal, other being the smaller id: for each row its class's smallest id (equal normalised
    texts), and all near-duplicate pairs of those. What a class's members are near to is what its smallest id is near to."""
    rows = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].alias("id"), texts.for_dedup(docs[text]).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    rows = rows.withColumn("h", F.sha2("t", 256))  # classes are told by it; a text goes along once for each class and task
    reps = written(rows.groupBy("h").agg(F.min("id").alias("id"), F.any_value("t").alias("t")).withColumn("n", F.length("t")), "classes")
    members = rows.select(F.col("id").alias("b"), "h").join(reps.select("h", F.col("id").alias("a")), "h").where("a <> b").select("a", "b", F.lit(True).alias("equal"))
    long_enough = reps.where(F.col("n") >= SHORTEST)

    heads = long_enough.where(F.col("n") >= HEAD).select("id", "n", F.sha2(F.substring("t", 1, HEAD), 256).alias("head"))
    x, y = heads.alias("x"), heads.alias("y")
    # of equal lengths the smaller id counts as the shorter
    before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    by_head = x.join(y, (F.col("x.head") == F.col("y.head")) & before & (F.col("x.n") >= 0.75 * F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n, k, longer = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for role, found in zip((True, False), anchors(t), strict=True):
                    place += [i] * len(found)
                    n += [len(t)] * len(found)
                    longer += [role] * len(found)
                    k += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(n, pa.int32()), pa.array(k, pa.int64()), pa.array(longer, pa.bool_())], ["id", "n", "k", "longer"])

    keys = written(long_enough.select("id", "t").mapInArrow(emit, f"id {kind}, n int, k bigint, longer boolean"), "anchors")
    s, t = keys.where("not longer").alias("s"), keys.where("longer").alias("t")
    inside = s.join(t, (F.col("s.k") == F.col("t.k")) & (F.col("s.n") < F.col("t.n")) & (F.col("s.n") >= 0.75 * F.col("t.n"))).select(F.col("s.id").alias("a"), F.col("t.id").alias("b"))

    met = by_head.unionByName(inside).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = met.join(reps.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(reps.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    near = both.where(texts.near_duplicate(F.col("ta"), F.col("tb"))).select("a", "b", F.lit(False).alias("equal"))

    blank = reps.where("t = ''").select(F.col("id").alias("blank"))  # one row or none
    to_blank = reps.where("t <> ''").crossJoin(F.broadcast(blank)).where("id <> blank").select(F.least("id", "blank").alias("a"), F.greatest("id", "blank").alias("b"), F.lit(False).alias("equal"))
    out = members.unionByName(near).unionByName(to_blank).distinct()
    return out.select(F.col("a").alias("other"), F.col("b").alias(key), "equal")
