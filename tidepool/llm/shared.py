"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import _BATCHES, BATCH_BYTES, BATCH_ROWS, bounded_batches, size_of  # noqa: F401  callers take them from here

#: ASCII white space, as `bytes.split()` takes it: space and \t \n \v \f \r.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir or the context names. Only a session on one machine may have none (tests); it gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: The scratch tables of this process, oldest first, by application.
_made: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, for a table that a caller writes."""
    at = f"{shared_dir(spark)}/tidepool-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: its lineage ends at files that outlive any executor."""
    at = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Where the scratch tables lie that haven't been released, oldest first."""
    return list(_made.get(spark.sparkContext.applicationId, ()))


def release_scratch(spark: SparkSession, newest: int = 0) -> None:
    """Deletes this application's scratch tables but the newest ones. For callers that have written all results that read the others."""
    made = _made.get(spark.sparkContext.applicationId, [])
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    while len(made) > newest:
        at = path(made.pop(0))
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def restored_batches(spark: SparkSession) -> Iterator[None]:
    """For callers that run all plans inside: the batch settings are afterwards what they were before."""
    before = {key: spark.conf.get(key) for key in _BATCHES}
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front of it as long as a column of the frames is called so (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tidy() -> None:
    """Gives back what a task has freed, so that reused workers stay small between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run, a function over a task's batches, with tidy() at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped


def crc_mod(doc_id, m: int):
    """crc32 of the id's decimal text, modulo m: which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def crc_mod_py(doc_id: int, m: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % m


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pa.large_binary()).to_pylist()]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to about limit, so that temporary arrays stay small."""
    start = total = n = 0
    for n, x in enumerate(sizes, 1):
        total += x
        if total >= limit:
            yield start, n
            start, total = n, 0
    if n > start:
        yield start, n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges starts[i] .. starts[i] + lengths[i], one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def thinned(key, rows, sample: int):
    """Whether a row may be among `sample` chosen ones of `rows`: about four times as many may, by a hash of their keys. So a choice of the first ones sorts few, however many there are."""
    return F.pmod(F.xxhash64(F.lit("thinned"), key.cast("string")), F.lit(1 << 30)) < F.lit(4.0 * sample * (1 << 30)) / rows


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Bits of the filter that prefilter() broadcasts: 1 MB, whatever the number of keys.
FILTER_BITS = 1 << 23


def marked(rows: DataFrame, key: str, wanted: DataFrame, at: str) -> DataFrame:
    """rows with a boolean column: false only if the row's key isn't among wanted.key.

    A bitmap of hashed keys with a fixed number of bits is broadcast, as rows of 512
    numbers of 64 bits. It never misses a wanted key; with very many keys more rows are
    true than need be.
    """
    of, held = unused("__bucket", rows), unused("__map", rows)
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    words = wanted.select(F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    some = F.map_from_entries(F.collect_list(F.struct((F.col("word") % 512).cast("int").alias("k"), F.col("bits").alias("v"))))
    maps = words.groupBy(F.shiftright("word", 9).alias(of)).agg(some.alias("some")).select(of, F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.col("some")[i], F.lit(0).cast("bigint"))).alias(held))
    met = rows.withColumn(of, F.shiftright(bit, 15)).join(F.broadcast(maps), of, "left")
    word = F.get(F.col(held), F.shiftright(bit, 6).cast("int").bitwiseAND(F.lit(511)))
    return met.select(*rows.columns, F.coalesce(F.getbit(word, (bit % 64).cast("int")) == 1, F.lit(False)).alias(at))


def prefilter(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't among wanted.key, so that a following join shuffles less; see marked()."""
    at = unused("__hit", rows)
    return marked(rows, key, wanted, at).where(F.col(at)).drop(at)


#: A key with more than this share of all rows is a hot one; there are fewer such keys than its inverse. So many rows
#: are few enough for any task.
HOT_KEYS, FEW_ROWS = 1024, 1 << 14


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in `count` how many of the `total` rows have it.

    Rows of hot keys meet theirs where they lie: fewer than HOT_KEYS rows of keyed
    are broadcast for it, whatever the size of both sides; they should be small. All
    other rows are dealt out by the key, and no key has many of them.
    """
    if total <= FEW_ROWS:
        return rows.join(keyed, key)
    limit = total // HOT_KEYS
    hot = F.broadcast(keyed.where(F.col(count) > limit))
    cold = keyed.where(F.col(count) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with keyed (one row for each key, of any size). A hot key's rows are dealt out by `by` as well, and its row of keyed is sent to each part. rows are read three times: they should be a written table."""
    total = rows.count()
    if total <= FEW_ROWS:
        return rows.join(keyed, key)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    sizes = scratch(sizes.withColumn("__parts", F.ceil(F.col("__n") / (total // HOT_KEYS)).cast("int")), "sizes")
    dealt = spread_join(rows, sizes, key, "__n", total).withColumn("__salt", F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"))
    sent = keyed.join(sizes, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return dealt.drop("__n", "__parts").join(sent.drop("__n", "__parts"), [key, "__salt"]).drop("__salt")
