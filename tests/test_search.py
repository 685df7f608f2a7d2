import pytest

from tidepool.config import Chunking, Settings, load
from tidepool.functions import chunking
from tidepool.operators import filters, fts, hybrid, pack, store
from tidepool.operators.segments import SegmentIndex
from tidepool.sources import files


def test_parse(spark):
    q = fts.parse("how to rotate certificates")
    assert q.words == ("rotate", "certificates") and str(q.primary).startswith("NEAR(") and " OR " in str(q.fallback)
    assert fts.parse('list "open ports" host').words == ("list", "open ports", "host")
    both = str(fts.parse("backup", ("Daily", "cron")).primary)
    assert " AND " in both and '"Daily"' in both and '"cron"' in both
    assert fts.parse("what is").words == ("what", "is")
    assert fts.parse("«rotate» (keys)…").words == ("rotate", "keys")
    assert str(fts.parse("o'clock").primary) == '"o clock"'


def test_stopwords(spark):
    words = fts.stopwords()
    assert {"the", "nicht", "avec", "porque", "comment", "vs"} <= words and len(words) > 800
    assert fts.parse("warum schedulers fail", stopwords=words).words == ("warum", "schedulers", "fail")[1 if "warum" in words else 0 :]


@pytest.mark.parametrize("kept", [False, True])
def test_match_and_ladder(spark, tmp_path, kept):
    rows = [(1, "alpha beta gamma"), (2, "alpha x x x x x x beta"), (3, "beta beta"), (4, "naïve ALPHA beta"), (5, None)]
    c = spark.createDataFrame(rows, "chunk_id int, text string")
    i = fts.index(c)
    if kept:
        SegmentIndex.create(c, str(tmp_path))
        i = SegmentIndex.load(spark, str(tmp_path))
    near = fts.Near((fts.phrase("alpha"), fts.phrase("beta")), 5)
    assert {r.chunk_id for r in fts.search(i, c, near, 9).collect()} == {1, 4}
    assert {r.chunk_id for r in fts.search(i, c, fts.phrase("naive alpha"), 9).collect()} == {4}
    assert {r.chunk_id for r in fts.ladder(i, c, fts.parse("gamma naive"), 5).collect()} == {1, 4}
    assert {r.chunk_id for r in fts.search(i, c, fts.phrase("x x x beta"), 9).collect()} == {2}
    assert fts.ladder(i, c, fts.parse(""), 5).collect() == []
    assert [r.chunk_id for r in fts.like(c, ("beta",), 2).collect()] == [3, 1]
    assert [r.chunk_id for r in fts.search(i, c.where("chunk_id > 1"), fts.phrase("alpha"), 5, partial=True).collect()] == [4, 2]
    assert fts.search(fts.index(c.limit(0)), c.limit(0), fts.phrase("alpha"), 5).collect() == []


def test_from_pages_to_packs(spark):
    """What ingest() returns is searched and packed; pages in error aren't found, addresses that are equal when normalized are one document."""
    from tidepool.operators import ingest, stored, vector
    from tidepool.schema import CHUNKS, DOCUMENTS, EMBEDDINGS, SOURCES

    page = lambda head, body: f"<html><body><main><h1>{head}</h1><p>{body}</p></main></body></html>"
    long = "The scheduler retries a failed upload after a pause that doubles each time, until the limit that the operator has set is reached."
    rows = [
        ("https://e.com/docs/retry", page("Retries", long), True), ("https://e.com/docs/retry/", page("Retries", long), True), ("https://e.com/docs/retry#top", None, False),
        ("https://e.com/docs/limits", page("Limits", long.replace("scheduler", "gateway").replace("upload", "request")), True), ("https://e.com/docs/gone", page("Gone", long), False), ("no address", "x", True),
    ]
    empty = {"documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "sources": SOURCES}
    tables = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    embedder = vector.HashedEmbedder()
    out = ingest.ingest(ingest.from_pages(spark.createDataFrame(rows, "url string, html string, ok boolean"), "s"), tables, embedder=embedder)
    told = {r.uri: (r.status, r.error) for r in out["documents"].collect()}
    assert told == {"https://e.com/docs/retry": ("ok", None), "https://e.com/docs/limits": ("ok", None), "https://e.com/docs/gone": ("error", "no content"), "no address": ("error", "invalid address")}
    made = stored.index(out)
    hits = stored.ask(out, made, "scheduler upload", embedder).collect()
    assert hits[0].uri == "https://e.com/docs/retry" and hits[0].title == "Retries" and {h.uri for h in hits} == {"https://e.com/docs/retry", "https://e.com/docs/limits"}
    sections = stored.context(out, made, ["scheduler upload", "gateway"], embedder).collect()
    assert {(r.query, r.uri) for r in sections if r.rank == 1} == {("scheduler upload", "https://e.com/docs/retry"), ("gateway", "https://e.com/docs/limits")}
    with pytest.raises(ValueError, match="no source"):
        stored.ask(out, made, "scheduler", sources=["unknown"])


def test_openapi_and_errors(spark):
    from tidepool.operators import ingest

    specs = [("https://e.com/openapi.json", '{"openapi":"3.0.0","info":{"title":"Toys","version":"7"},"paths":{"/toys":{"get":{"summary":"All toys"}}}}'), ("https://e.com/b", "{}"), ("https://e.com/c", None)]
    got = {r.uri: r for r in ingest.from_openapi(spark.createDataFrame(specs, "url string, body string"), "s").collect()}
    assert got["https://e.com/openapi.json"].title == "Toys" and "/toys" in got["https://e.com/openapi.json"].markdown
    assert [got[u].status for u in sorted(got)] == ["error", "error", "ok"] and all(got[u].error for u in ("https://e.com/b", "https://e.com/c"))


def test_migrations_and_meta(spark):
    meta = spark.createDataFrame([], "key string, value string")
    tables, new = store.migrate({"meta": meta}, [("a", lambda t: t), ("b", lambda t: t | {"x": meta})])
    assert new == ["a", "b"] and "x" in tables and store.migrate(tables, [("a", lambda t: t), ("b", lambda t: t)])[1] == []
    assert store.get_meta(store.put_meta(meta, "k", "v"), "k") == "v" and store.get_meta(meta, "k") is None


def test_migration_ledger(spark):
    meta, rows = spark.createDataFrame([], "key string, value string"), spark.createDataFrame([(1,)], "a int")
    steps = [store.Step("a", "adds nothing", lambda t: t), store.Step("b", "adds x", lambda t: t | {"x": rows})]
    tables, new = store.migrate({"meta": meta}, steps)
    assert new == ["a", "b"] and {r.key: r.value for r in tables["meta"].collect()} == {f"migration:{s.name}": s.checksum for s in steps}
    with pytest.raises(store.ChangedStep, match="b"):
        store.migrate(tables, [steps[0], store.Step("b", "adds y", steps[1].run)])
    old, new = store.migrate({"meta": meta, "documents": rows}, steps, baseline=1)  # a store from before there was a ledger
    assert new == ["b"] and old["meta"].count() == 2 and "x" in old
    assert store.migrate({"meta": meta, "documents": rows.limit(0)}, steps, baseline=1)[1] == ["a", "b"]


def test_work_is_tagged_while_it_can_be_cancelled(spark):
    from tidepool.streaming.control import cancellable

    with cancellable(spark, "slow") as cancel:
        assert "slow" in spark.getTags() and callable(cancel)
    assert "slow" not in spark.getTags()


@pytest.mark.parametrize(
    ("host", "port", "rules", "out"),
    [("a.example.com", 443, "*.example.com", True), ("example.com", None, ".example.com", False), ("h", 8080, "x, h:8080", True), ("h", 80, "h:8080", False), ("any", 1, "*", True), ("host", 1, "", False), ("host", 9, "HOST", True)],
)
def test_proxy_bypass(host, port, rules, out):
    from tidepool.config import bypasses_proxy

    assert bypasses_proxy(host, port, rules) is out


def test_diversify(spark):
    from pyspark.sql import functions as F

    hits = spark.createDataFrame([(1, "a", 3.0), (2, "a", 2.0), (3, "a", 1.0), (4, "b", 0.5)], "chunk_id int, document_id string, score double")
    assert sorted(r.chunk_id for r in hybrid.diversify(hits, 2, [F.desc("score")]).collect()) == [1, 2, 4]
    assert hybrid.diversify(hits, 0, [F.desc("score")]).count() == 4


def hit(text, score=1.0, heading=None, uri="https://e.com/a.md"):
    return {"text": text, "heading": heading, "title": None, "section_path": None, "uri": uri, "score": score}


def test_pack_fold():
    kept, total, _ = pack.fold([hit("hello world " * 100)], 20)
    assert len(kept) == 1 and total == 20
    kept, total, _ = pack.fold([hit("word " * 200, 1 - 0.1 * i) for i in range(4)], 200)
    assert [k["tokens"] for k in kept] == [89, 89, 22] and total == 200
    code = "```js\n" + "const x = login(user, password); check(x);\n" * 3 + "```"
    kept, _, _ = pack.fold([hit(code, heading="Examples"), hit(code + "\n", heading="Other"), hit("Other words on another matter, at some length.", heading="Documentation")], 2400)
    assert [k["heading"] for k in kept] == ["Examples", "Documentation"]
    assert pack.fold([], 100) == ([], 0, 0)


def test_kinds():
    assert filters.parse_kinds(["text", "CODE", "table", "md"]) == ["prose", "code", "table"]
    assert filters.split_list("a, b , ,c") == ["a", "b", "c"]
    with pytest.raises(ValueError, match="image"):
        filters.parse_kinds(["image"])


def test_chunks():
    doc = "# Guide\n\nIntro text that is long enough to stay.\n\n```python\ndef f():\n    return 1\n```\n\n## Setup\n\nMore words here, also long enough.\n\n| A | B |\n| - | - |\n" + "".join(f"| {i} | x |\n" for i in range(5))
    out = chunking.chunk(doc, "a.md", Chunking(overlap=0))
    kinds = [c.kind for c in out]
    assert kinds == ["prose", "code", "prose", "table", "table"]
    assert out[1].language == "python" and out[2].section_path == "Guide > Setup" and "Intro text" in out[0].text
    long = "One sentence here. " * 200
    parts = chunking.chunk(long, "b.md", Chunking(overlap=0))
    assert all(len(c.text) <= 512 for c in parts) and "".join(c.text.replace(" ", "") for c in parts) == long.replace(" ", "")
    lapped = chunking.chunk(long, "b.md", Chunking(overlap=64))
    assert lapped[1].text.startswith(lapped[0].text[-64:].strip())
    assert chunking.chunk("", "c.md") == []


def test_upsert_and_prune(spark):
    old = spark.createDataFrame([("1", "s", "u1", "T1", "ok"), ("2", "s", "u2", "T2", "ok")], "id string, source_id string, uri string, title string, status string")
    new = spark.createDataFrame([("9", "s", "u1", None, "error"), ("3", "s", "u3", "T3", "ok")], old.schema)
    got = {r.uri: tuple(r) for r in store.upsert_documents(old, new).collect()}
    assert got == {"u1": ("1", "s", "u1", "T1", "error"), "u2": ("2", "s", "u2", "T2", "ok"), "u3": ("3", "s", "u3", "T3", "ok")}
    assert [r.uri for r in store.vanished(old, "s", new.select("uri")).collect()] == ["u2"]
    assert store.vanished(old, "s", new.limit(0)).count() == 0


def test_targets():
    assert files.repository("github:o/r@dev") == ("o", "r", "dev")
    assert files.route("https://github.com/o/r") == "repository"
    assert files.route("https://e.com/openapi.json") == "openapi"
    assert files.route("https://e.com/docs") == "web"
    assert files.route("/tmp/x") == "folder"


def test_settings():
    s = load({"retrieval": {"top_k": 3}, "embeddings": {"openai": {"base_url": "http://h"}}, "unknown": 1})
    assert s.retrieval.top_k == 3 and s.embeddings.base_url == "http://h" and Settings().retrieval.rrf_k == 60
    with pytest.raises(ValueError, match="top_k"):
        load({"retrieval": {"top_k": "many"}})


def test_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("docs/a.md", "b.py", "node_modules/c.js", "d.min.js", "e.bin", ".hidden.md"):
        (tmp_path / name).write_text("x")
    assert {r.path.rsplit("/", 1)[1] for r in files.folder(spark, str(tmp_path)).collect()} == {"a.md", "b.py"}
