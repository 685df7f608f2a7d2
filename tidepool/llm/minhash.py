"""Near-duplicate documents by MinHash with banding.

1. A task turns each whole text into its set of word shingles (64-bit hashes),
   and that into a digest and into minima under many universal hash functions.
2. Equal sets become one representative, the smallest id.
3. Representatives that agree in a band share a bucket. Each is compared with
   its buckets' leaders only: first by signature, then by full sets, the best
   leader first and the others only where components still differ.
4. Buckets in which several components are left are compared whole, in blocks of
   rows that meet two by two; a block emits links alone. So no link that bands
   and signatures propose is lost, and what is emitted stays linear in a bucket's size.
   Each row goes to as many tasks as its bucket has blocks: first with its signature
   only, then those that have a partner by signature with their sets, in blocks of
   bounded bytes. For a bucket of m rows that is m^2 / BLOCK signatures.
5. Components by large-star and small-star.

Buckets, leaders and sets that very many rows share are joined in parts
(shared.spread_join, shared.salted_join): no task gets all rows of one.

With 32 bands of 4 rows a pair of similarity 0.85 shares no bucket in 6 of 10^11
cases, one of 0.8 in 5 of 10^8. The signatures, which are looked at before full sets,
lose a pair that is exactly at the threshold in 4 of 10^10 cases at 0.85 and in 1 of
10^10 at 0.8. Together: 5 of 10^10 and 5 of 10^8.

Defined results: null and wordless texts have an empty set and stand alone;
fewer words than a shingle are one shingle; rows of one id are one document (all of
them are kept or none, and one that comes with several texts links what each is like);
rows with a null id stand alone, with a null component, and are kept; the smallest id
of a component is the one that is kept; texts of any length are taken whole; columns of
docs other than key and text don't matter.

Shingles are 64-bit hashes: a set of 10^6 has a mix-up within it in 3 of 10^8 cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import components
from tidepool.llm.shared import bounded_batches, mix64, offsets, prefilter, raw_texts, salted_join, scratch, slices, spread_join, tidied

WORDS, BANDS, ROWS = 5, 32, 4
#: Words whose hashes a worker keeps before it starts anew, bytes of text in one go, shingles hashed in one go, rows of a block, and shingles of one.
CACHED, SLICE, STEP, BLOCK, BLOCK_SHINGLES = 300_000, 1_000_000, 1 << 15, 1024, 1 << 21
#: Odd; fixed for all runs.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Standard deviations by which a signature may fall short of the threshold.
SLACK = 7.0


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(raws: list[bytes], words: int, cache: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    powers = np.ones(words, np.uint64)
    for k in range(1, words):
        powers[k : k + 1] = powers[k - 1 : k] * SPREAD
    out = []
    for raw in raws:
        found = raw.lower().split()  # bytes: only A-Z change, only ASCII white space parts
        w = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
        if 0 < len(w) < words:
            total = (w * powers[: len(w)]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(w))
        elif len(w):
            n = len(w) - words + 1
            total = np.zeros(n, np.uint64)
            for k in range(words):
                total += w[k : k + n] * powers[k]
        else:
            total = w
        out.append(np.unique(mix64(total)))
        if len(cache) > CACHED:
            cache.clear()
    return out


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions; the same in every worker."""
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The n minima of each non-empty set, as 32 bits each."""
    times, plus = hash_family(n)
    out = np.full((len(sets), n), np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = [(i, s[k : k + STEP]) for i, s in enumerate(sets) for k in range(0, len(s), STEP)]
    for a, b in slices((len(s) for _, s in owner), STEP):
        flat = np.concatenate([s for _, s in owner[a:b]])
        at = offsets(np.array([len(s) for _, s in owner[a:b]]))[:-1]
        row = np.array([i for i, _ in owner[a:b]])
        held = np.empty_like(flat)
        for k in range(n):
            np.multiply(flat, times[k], out=held)
            held += plus[k]
            np.minimum.at(out[:, k], row, np.minimum.reduceat(held, at))
    return (out >> np.uint64(32)).astype("<u4")


def sketch(docs: DataFrame, key: str, text: str, words: int, hashes: int) -> DataFrame:
    """key, size of the set, its digest (two numbers, null if empty) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            raws = raw_texts(batch.column(1))
            for a, b in slices(map(len, raws), SLICE):
                sets = shingle_sets(raws[a:b], words, cache)
                some = [len(s) > 0 for s in sets]
                sig = signatures(sets, hashes)
                first = [int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
                second = [int(mix64(s ^ SPREAD).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(second, pa.int64()),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(sig, some, strict=True)], pa.binary()),
                    ],
                    ["key", "n", "d1", "d2", "sig"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(tidied(run), f"key {kind}, n bigint, d1 bigint, d2 bigint, sig binary")


def full_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """The sorted shingle hashes of the wanted keys' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            raws = raw_texts(batch.column(1))
            for a, b in slices(map(len, raws), SLICE):
                sets = shingle_sets(raws[a:b], words, cache)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                at = offsets(np.array([len(s) for s in sets], np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    rows = prefilter(docs.select(docs[key].alias("key"), docs[text].alias("text")), "key", wanted).join(wanted.select("key"), "key", "left_semi")
    return rows.mapInArrow(tidied(run), f"key {kind}, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = salted_join(pairs.select("a", "b"), left, "a", "b").join(right, "b").withColumn("both", both)
    return met.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def least_alike(percent: int, hashes: int) -> float:
    """The share of equal minima under which a pair isn't looked at."""
    return percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / hashes)


def whole_buckets(rows: DataFrame, sig: DataFrame, sets: DataFrame | None, percent: int, hashes: int, kind: str) -> DataFrame:
    """Links between components in buckets, all members against all, block by block.

    rows: bucket, key, comp. A block meets every other of its bucket in a task
    of its own; links that join what the task has joined already aren't emitted.
    Without sets: bucket and key of the rows that have a partner by signature.
    """
    least = least_alike(percent, hashes)
    with_sets = sets is not None

    def met(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low, high = key[1], key[2]
        sig = np.frombuffer(b"".join(frame["sig"]), "<u4").reshape(len(frame), -1)
        side = frame["block"].to_numpy()
        comp, keys = frame["comp"].to_numpy(), frame["key"].tolist()
        root: dict = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        out = []
        if not with_sets:
            partner = np.zeros(len(frame), bool)
            for i in left:
                alike = (np.count_nonzero(sig[right] == sig[i], axis=1) >= least * sig.shape[1]) & (comp[right] != comp[i])
                partner[i] |= alike.any()
                partner[right] |= alike
            return frame.loc[partner, ["bucket", "key"]]
        shingles = frame["shingles"].tolist()
        for i in left:
            alike = np.count_nonzero(sig[right] == sig[i], axis=1)
            for j in right[alike >= least * sig.shape[1]]:
                x, y = find(comp[i]), find(comp[j])
                if x == y:
                    continue
                both = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                if 100 * both >= percent * (len(shingles[i]) + len(shingles[j]) - both):
                    out.append((keys[i], keys[j]))
                    root[x] = y
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"} if kind == "bigint" else object)

    weight = F.lit(0)
    weighed = rows
    if with_sets:
        weight = F.sum("w")
        weighed = rows.join(sets.groupBy("key").agg(F.max(F.size("shingles")).alias("w")), "key")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = scratch(weighed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), blocks.alias("blocks")), "sizes")
    given = spread_join(rows, sizes, "bucket", "size", rows.count()).join(sig, "key")
    given = given if sets is None else given.join(sets, "key")
    dealt = given.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "comp", "sig", *(["shingles"] if sets is not None else []))
    return meets.groupBy("bucket", "low", "high").applyInPandas(met, f"bucket bigint, key {kind}" if sets is None else f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, component_id and kept for every row; see the module."""
    bounded_batches(docs.sparkSession)
    hashes = bands * rows
    kind = docs.schema[key].dataType.simpleString()
    drawn = scratch(sketch(docs, key, text, words, hashes), "sketch")
    known = drawn.where("n > 0 and key is not null")
    reps = scratch(known.groupBy("d1", "d2").agg(F.min("key").alias("key"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "reps")

    # buckets of two or more, without twins of the same members
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * rows) + 1, F.lit(4 * rows))))
    banded = reps.select("key", F.explode(cut).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("leader"), F.sum(F.xxhash64("key") % (1 << 31)).alias("who"), F.bit_xor(F.xxhash64("key")).alias("who2"))
    shared = shared.where("size > 1").groupBy("size", "leader", "who", "who2").agg(F.min("bucket").alias("bucket"))
    shared = scratch(shared.select("bucket", "size", "leader"), "shared")
    places = shared.agg(F.sum("size")).first()[0] or 0
    member = scratch(spread_join(prefilter(banded, "bucket", shared), shared, "bucket", "size", places), "buckets")
    sets = full_sets(docs, key, text, words, scratch(member.select("key").distinct(), "members"))
    if not known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sets = sets.dropDuplicates(["key", "shingles"])  # rows that repeat id and text
    sets = scratch(sets, "sets")

    # leaders against members, by signature
    pairs = scratch(member.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct(), "pairs")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        left, right = (np.frombuffer(b"".join(v), "<u4").reshape(len(v), -1) for v in (x, y))
        return pd.Series((left == right).mean(axis=1))

    least = least_alike(percent, hashes)
    sig = reps.select("key", "sig")
    of_a, of_b = (sig.select(F.col("key").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    near = salted_join(pairs, of_a, "a", "b").join(of_b, "b")
    near = scratch(near.select("a", "b", alike("sa", "sb").alias("s")).where(F.col("s") >= least), "near")

    best = scratch(near.groupBy("b").agg(F.max_by("a", F.struct("s", "a")).alias("a")), "best")
    links = scratch(confirmed(best, sets, percent).union(several(known, reps)), "links")
    found = components(links)
    others = near.join(found.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    others = scratch(others.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti"), "others")
    more = scratch(confirmed(others, sets, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        found = components(links)

    # what is left: buckets whose members, the leader aside, lie in several components
    placed = member.where("size > 2 and key <> leader").join(found.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    rest = scratch(placed.join(mixed, "bucket"), "rest")
    likely = scratch(whole_buckets(rest, sig, None, percent, hashes, kind).distinct(), "likely")
    pairing = scratch(rest.join(likely, ["bucket", "key"]), "pairing")
    last = scratch(whole_buckets(pairing, sig, sets, percent, hashes, kind).distinct(), "links")
    if not last.isEmpty():
        found = components(links.union(last))

    of_set = reps.join(found.withColumnRenamed("node", "key"), "key", "left").select(F.struct("d1", "d2").alias("d"), "copies", F.coalesce("root", "key").alias("component_id"))
    joined = spread_join(known.select("key", "n", F.struct("d1", "d2").alias("d")), of_set, "d", "copies", drawn.count()).select("key", "n", "component_id")
    alone = drawn.where("not (n > 0 and key is not null)").select("key", "n", F.col("key").alias("component_id"))
    out = joined.union(alone)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def several(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Links for ids that come with more than one set: to each set's representative."""
    many = known.groupBy("key").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("key")
    rows = known.join(many, "key").select(F.col("key").alias("b"), "d1", "d2")
    return rows.join(reps.select("d1", "d2", F.col("key").alias("a")), ["d1", "d2"]).where("a <> b").select("a", "b").distinct()
