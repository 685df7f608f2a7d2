"""Versions of a stored thing: each is one small file, and the newest that is complete counts.

A version is written under another name and then renamed to its own. A rename either
happens or doesn't, and fails if the name is taken: so readers see the old state or the new,
a crash before it leaves the old one, and of two writers who began at one version the second is told.
What versions no longer name can be deleted when nobody reads it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

DIGITS = 9


class Conflict(RuntimeError):
    """Another writer has made this version."""


def file_system(spark: SparkSession, at: str):
    """The file system of a path, and the path as it takes it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, at: str) -> list[int]:
    fs, path = file_system(spark, f"{at}/versions")
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")


def read(spark: SparkSession, at: str, version: int | None = None) -> tuple[int, dict]:
    """A version and what it says; without a number the newest, 0 and nothing if there is none."""
    known = _versions(spark, at)
    if not known:
        return 0, {}
    number = known[-1] if version is None else version
    fs, path = file_system(spark, f"{at}/versions/{number:0{DIGITS}}.json")
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(text)


def commit(spark: SparkSession, at: str, before: int, what: dict) -> int:
    """Makes the version after `before`."""
    number = before + 1
    fs, to = file_system(spark, f"{at}/versions/{number:0{DIGITS}}.json")
    _, by = file_system(spark, f"{at}/versions/_{uuid.uuid4().hex}")
    out = fs.create(by, False)
    try:
        out.write(bytearray(json.dumps(what).encode()))
    finally:
        out.close()
    if fs.exists(to) or not fs.rename(by, to):
        fs.delete(by, False)
        raise Conflict(f"version {number} of {at} exists")
    return number


def remove(spark: SparkSession, at: str) -> None:
    fs, path = file_system(spark, at)
    fs.delete(path, True)
