"""Fetching from a server on this machine: redirects, scope, failures, encodings."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidepool.sources import http

PAGES = {
    "/docs/a": (200, {"Content-Type": "text/html; charset=latin-1"}, "Größe".encode("latin-1")),
    "/docs/b": (301, {"Location": "a"}, b""),
    "/docs/c": (302, {"Location": "/blog/x"}, b""),
    "/docs/out": (302, {"Location": "http://elsewhere.invalid/"}, b""),
    "/docs/loop": (302, {"Location": "/docs/loop"}, b""),
    "/docs/nowhere": (302, {}, b""),
    "/docs/missing": (404, {"Content-Type": "text/plain"}, b"no"),
    "/blog/x": (200, {"Content-Type": "text/plain; charset=unknown"}, "é".encode()),
    "/docs/big": (200, {}, b"x" * 5000),
    "/docs/page": (200, {"Content-Type": "text/html"}, b"<html><body><main><h1>Retries</h1><p>The scheduler retries a failed upload after a pause that doubles each time, until the limit is reached.</p></main></body></html>"),
    "/docs/moved": (308, {"Location": "page"}, b""),
}


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            if self.path == "/docs/flaky" and seen.count(self.path) % 3:  # answers the third time only
                self.connection.close()
                return
            status, headers, body = PAGES.get(self.path, (200, {"Content-Type": "text/html"}, b"late"))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def expected(base):
    return {
        "/docs/a": (True, 200, f"{base}/docs/a", "Größe", None),
        "/docs/b": (True, 200, f"{base}/docs/a", "Größe", None),
        "/docs/c": (False, 302, f"{base}/blog/x", None, "out of scope"),
        "/docs/out": (False, 302, "http://elsewhere.invalid/", None, "out of scope"),
        "/docs/loop": (False, 302, f"{base}/docs/loop", None, "too many redirects"),
        "/docs/nowhere": (False, 302, f"{base}/docs/nowhere", None, "status 302"),
        "/docs/missing": (False, 404, f"{base}/docs/missing", None, "status 404"),
        "/blog/x": (False, None, f"{base}/blog/x", None, "out of scope"),
        "/docs/big": (False, 200, f"{base}/docs/big", None, "over 4000 bytes"),
        "/docs/flaky": (True, 200, f"{base}/docs/flaky", "late", None),
    }


def told(rows, base):
    return {r.url.removeprefix(base): (r.ok, r.status, r.final, r.body, r.error) for r in rows}


def test_source(spark, server):
    base, seen = server
    http.register(spark)
    read = spark.read.format("tidepool_http").option("urls", json.dumps([base + p for p in expected(base)])).option("root", f"{base}/docs").option("mode", "under-root")
    df = read.option("pause", "0.01").option("pertask", "3").option("mostbytes", "4000").option("headers", '{"X-A": "b"}').load()
    assert df.rdd.getNumPartitions() == 4
    assert told(df.collect(), base) == expected(base)
    assert seen.count("/docs/flaky") == 3
    assert spark.read.format("tidepool_http").load().collect() == []


def test_table_of_addresses(spark, server):
    base, _ = server
    how = http.Fetching(root=f"{base}/docs", mode="under-root", pause=0.01, most_bytes=4000)
    addresses = spark.createDataFrame([(base + p,) for p in expected(base)] + [(None,), ("ftp://a/b",), ("http://[",)], "url string")
    got = http.fetched(addresses, how, per_task=5).collect()
    assert told([r for r in got if r.url and r.url.startswith(base)], base) == expected(base)
    assert [r.error for r in got if not (r.url or "").startswith(base)] == ["invalid address"] * 3
    dead = http.Fetcher(http.Fetching(retries=1, pause=0.01, timeout=2)).fetch("http://127.0.0.1:9/")
    assert not dead[1] and dead[2] is None and "refused" in dead[6]


def test_fetched_pages_are_ingested(spark, server):
    from tidepool.operators import ingest
    from tidepool.schema import CHUNKS, DOCUMENTS, EMBEDDINGS, SOURCES

    base, _ = server
    tables = {k: spark.createDataFrame([], v) for k, v in {"documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "sources": SOURCES}.items()}
    pages = http.fetched(spark.createDataFrame([(f"{base}/docs/moved",), (f"{base}/docs/missing",)], "url string"), http.Fetching(pause=0.01))
    out = ingest.ingest(ingest.from_pages(pages.withColumnRenamed("body", "html").select("url", "html", "ok"), "s"), tables)
    assert {r.uri.removeprefix(base): r.status for r in out["documents"].collect()} == {"/docs/moved": "ok", "/docs/missing": "error"}


@pytest.mark.parametrize(("url", "mode", "inside"), [("http://E.com:80/a/b", "under-root", True), ("http://e.com/ab", "under-root", False), ("http://e.com/ab", "same-origin", True), ("https://e.com/a", "same-origin", False), ("x", "same-origin", False)])
def test_scope(url, mode, inside):
    assert http.in_scope(url, "http://e.com/a/", mode) is inside
