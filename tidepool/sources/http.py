"""Pages fetched by the executors: a data source for lists of addresses, and the same over a table of them.

    register(spark)
    spark.read.format("tidepool_http").option("urls", json.dumps([...])).option("root", ...).load()

Every address gives one row. Redirects are followed hop by hop, and only inside the scope
of `root` ("same-origin" or "under-root"), so no page leads a crawl elsewhere; without a root all
are followed. Failures of the connection are tried again after a pause that doubles; what still
goes wrong, and every answer but a 2xx, is a row with an error, never an exception. Tasks
that are run again fetch their addresses again.
"""

from __future__ import annotations

import codecs
import http.client
import json
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepool.config import bypasses_proxy

SCHEMA = "url string, ok boolean, status int, final string, body string, content_type string, error string"
PORTS = {"http": 80, "https": 443}


@dataclass(frozen=True)
class Fetching:
    """How pages are fetched. most_bytes: what is read of a body; longer ones are an error."""

    root: str = ""
    mode: str = "same-origin"
    hops: int = 10
    retries: int = 2
    timeout: float = 30.0
    pause: float = 0.5
    headers: dict = field(default_factory=dict)
    proxy: str = ""
    no_proxy: str = ""
    verify: bool = True
    most_bytes: int = 32 << 20


def origin(url: str) -> tuple[str, str, int] | None:
    """Scheme, host and port of a web address, None for others."""
    try:
        parts = urlsplit(url)
        port = parts.port or PORTS.get(parts.scheme.lower(), 0)
    except ValueError:
        return None
    return (parts.scheme.lower(), (parts.hostname or "").lower(), port) if parts.scheme.lower() in PORTS and parts.hostname else None


def in_scope(url: str, root: str, mode: str) -> bool:
    here, there = origin(url), origin(root)
    if here is None or here != there:
        return False
    base, path = (urlsplit(x).path.rstrip("/") for x in (root, url))
    return mode != "under-root" or path == base or path.startswith(f"{base}/")


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args):
        return None


class Fetcher:
    def __init__(self, how: Fetching):
        self.how = how
        context = ssl.create_default_context()
        if not how.verify:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        shared = [_Stay(), urllib.request.HTTPSHandler(context=context)]
        self.direct = urllib.request.build_opener(urllib.request.ProxyHandler({}), *shared)
        self.proxied = urllib.request.build_opener(urllib.request.ProxyHandler({s: how.proxy for s in PORTS}), *shared) if how.proxy else self.direct

    def once(self, url: str) -> tuple[int, http.client.HTTPMessage, bytes]:
        _, host, port = origin(url)
        opener = self.direct if bypasses_proxy(host, port, self.how.no_proxy) else self.proxied
        request = urllib.request.Request(url, headers={"User-Agent": "tidepool", "Accept": "text/html,text/plain,*/*;q=0.8"} | self.how.headers)
        try:
            with opener.open(request, timeout=self.how.timeout) as answer:
                return answer.status, answer.headers, answer.read(self.how.most_bytes + 1)
        except urllib.error.HTTPError as e:  # any status but 2xx
            with e:
                return e.code, e.headers, e.read(self.how.most_bytes + 1)

    def again(self, url: str) -> tuple[int, http.client.HTTPMessage, bytes]:
        """once(), and again if the connection fails."""
        for n in range(self.how.retries + 1):
            try:
                return self.once(url)
            except (OSError, http.client.HTTPException):
                if n == self.how.retries:
                    raise
                time.sleep(self.how.pause * 2**n)
        raise AssertionError

    def fetch(self, url: str | None) -> tuple:
        """A row of SCHEMA."""
        at, status, kind, body, error = url, None, None, None, None
        for hop in range(self.how.hops + 1):
            if at is None or origin(at) is None:
                error = "invalid address"
            elif self.how.root and not in_scope(at, self.how.root, self.how.mode):
                error = "out of scope"
            if error:
                break
            try:
                status, headers, raw = self.again(at)
            except Exception as e:  # whatever a server or the network does is told in the row
                error = f"{type(e).__name__}: {e}"
                break
            kind = headers.get("Content-Type")
            to = headers.get("Location")
            if 300 <= status < 400:
                if not to:
                    error = f"status {status}"
                elif hop == self.how.hops:
                    error = "too many redirects"
                else:
                    at = urljoin(at, to)
                    continue
            elif not 200 <= status < 300:
                error = f"status {status}"
            elif len(raw) > self.how.most_bytes:
                error = f"over {self.how.most_bytes} bytes"
            else:
                body = raw.decode(charset(kind), "replace")
            break
        return url, error is None, status, at, body, kind, error


def charset(content_type: str | None) -> str:
    """The encoding that a content type names, if there is such; UTF-8 else."""
    for part in (content_type or "").lower().split(";")[1:]:
        name, _, value = part.strip().partition("=")
        if name == "charset":
            try:
                return codecs.lookup(value.strip("\"' ")).name
            except LookupError:
                break
    return "utf-8"


@dataclass
class Addresses(InputPartition):
    urls: list


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.per_task = int(options.get("pertask", 64))
        given = {k: v for k, v in asdict(Fetching()).items() if k.replace("_", "") in options}
        cast = {str: str, int: int, float: float, bool: lambda x: x.lower() == "true", dict: json.loads}
        self.how = Fetching(**{k: cast[type(v)](options[k.replace("_", "")]) for k, v in given.items()})

    def partitions(self) -> list[InputPartition]:
        return [Addresses(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [Addresses([])]

    def read(self, partition: Addresses) -> Iterator[tuple]:
        fetcher = Fetcher(self.how)
        for url in partition.urls:
            yield fetcher.fetch(url)


class HttpSource(DataSource):
    """Options: urls (a JSON list), pertask, and the fields of Fetching without underscores (headers as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "tidepool_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HttpReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


def fetched(addresses: DataFrame, how: Fetching = Fetching(), column: str = "url", per_task: int = 64) -> DataFrame:
    """A row of SCHEMA for every address of a table, however long; the executors share them out in tasks of about per_task."""
    tasks = max(1, -(-addresses.count() // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = Fetcher(how)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(fetcher.fetch(url), KINDS, strict=True)], NAMES)

    return addresses.select(addresses[column].alias("url")).repartition(tasks).mapInArrow(run, SCHEMA)


NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
KINDS = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[c.split(" ")[1]] for c in SCHEMA.split(", ")]
