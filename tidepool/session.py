"""Session defaults for large inputs; whatever a caller has set stays."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "tidepool", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir or the context names. Only a session on one machine may have none (tests); it gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/tidepool-{sc.applicationId}"


#: The tables that written() has made in this process, oldest first, by application.
_made: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder: what it took to make it isn't done again."""
    at = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(at)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release_written(spark: SparkSession, newest: int = 0) -> None:
    """Deletes the tables that written() has made but the newest ones. For callers that have kept all results that read the others."""
    made = _made.get(spark.sparkContext.applicationId, [])
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    while len(made) > newest:
        at = path(made.pop(0))
        at.getFileSystem(conf).delete(at, True)


#: Rows and bytes that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def size_of(value: str) -> int:
    """A setting's number of rows or bytes: plain, or with a unit as in 64m, 1g, 512kb."""
    m = re.fullmatch(r"\s*([+-]?\d+)\s*([kmgtp]?)b?\s*", value.lower())
    if not m:
        raise ValueError(f"no size: {value!r}")
    return int(m[1]) << _UNITS[m[2]]


def bounded_batches(spark: SparkSession) -> None:
    """Sees to it that long documents reach the workers in small batches.

    A session setting, as plans read it only when they run; smaller ones stay, none
    or less means no bound and is replaced. llm.shared.restored_batches() undoes it.
    """
    for key, most in _BATCHES.items():
        if not 0 < size_of(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
