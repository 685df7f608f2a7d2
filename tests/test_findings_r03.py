"""Small cases of what a reviewer found."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.functions import chunking, html
from tidepool.operators import batch, fts, pack, segments, stored, vector
from tidepool.plans import corpus


@pytest.mark.parametrize("dims", [1, 32, 64])
def test_hashed_embedding_has_unit_length_unless_there_is_no_word(dims):
    embedder = vector.HashedEmbedder(dims)
    texts = [f"w{i} w{j}" for i in range(40) for j in range(i)] + [" ", "\x0b", "\x1c  ", "ab " * 3]
    assert {round(sum(x * x for x in v), 9) for v in embedder.embed(texts)} == {1.0}
    assert not any(x for v in embedder.embed(["", " \t\n\r\f"]) for x in v)
    assert embedder.embed_one("w1 w2") == embedder.embed_one("W1\n w2 ")


def test_distinct_packs_have_no_section_twice_once_cut():
    def hit(n, score):
        return {"text": "word " * 400 + f"end {n} " * 40 * n, "score": score, "heading": None, "title": f"T{n}", "section_path": None, "uri": f"u{n}"}

    some = [hit(n, 1 - n / 10) for n in range(4)]
    assert len({k["text"] for k in pack.fold(some, 600)[0]}) < len(pack.fold(some, 600)[0])
    kept, total, _ = pack.fold(some, 600, distinct=True)
    assert len({k["text"] for k in kept}) == len(kept) and total == sum(k["tokens"] for k in kept) <= 600


def test_title_with_an_unclosed_reference(spark, tmp_path):
    rows = [(i, f"https://a.b/{i}", f'<html lang="en"><head></head><body><h1>{h}</h1><p>{"long text " * 20}</p></body></html>') for i, h in enumerate(["A &amp;&amp; b&amp", "&lt", "a &lt;b&gt c", "R & D", "x &amp;am"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = corpus.page_title_lang(spark, str(tmp_path)).orderBy("page_id").collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(corpus.ORACLE_SQL["page_title_lang"] + " order by page_id").fetchall()


@pytest.mark.parametrize("kept", [False, True])
def test_all_words_are_needed_where_loose_matches_are_not_wanted(spark, tmp_path, kept):
    chunks = spark.createDataFrame([("a", "d", "s", 0, "alpha beta gamma", None, None, None, "prose"), ("b", "d", "s", 1, "delta", None, None, None, "prose")], "id string, document_id string, source_id string, chunk_index int, text string, heading string, section_path string, title string, kind string")
    documents = spark.createDataFrame([("d", "s", "u", "T", "ok")], "id string, source_id string, uri string, title string, status string")
    tables = {"chunks": chunks, "documents": documents}
    made = stored.keep_index(tables, str(tmp_path)) if kept else stored.index(tables)
    for query, strict, loose in (("alpha beta gamma delta", [], ["a", "b"]), ("alpha beta gamma", ["a"], ["a"])):
        assert [r.chunk_id for r in stored.ask(tables, made, query, loose=False, stopwords=frozenset()).collect()] == strict
        assert sorted(r.chunk_id for r in stored.ask(tables, made, query, stopwords=frozenset()).collect()) == loose
    assert fts.ladder(made, chunks.withColumnRenamed("id", "chunk_id"), fts.parse("alpha zeta eta theta", stopwords=frozenset()), 5, loose=False).isEmpty()


def test_posting_blocks_are_made_without_a_shuffle_and_parts_are_bounded_in_characters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PART_CHARS", 4000)
    monkeypatch.setattr(segments, "RANGE_BITS", 3)
    some = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 1 + i % 50)) + (" long" * 300 if i % 10 == 0 else ""), "the title" if i % 3 else None) for i in range(200)] + [(1000, None, None), (1001, "long", "long")]
    chunks = spark.createDataFrame(some, "chunk_id long, text string, title string").repartition(5)
    made = segments.SegmentIndex.create(chunks, str(tmp_path))
    plan = segments.blocks_of(made._chunks(made.segments[0]))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    parts = spark.read.parquet(f"{tmp_path}/segments/{made.segments[0]['name']}/files").count()
    assert parts >= sum(len(x[1] or "") for x in some) // 4000
    want = {}
    for key, text, title in some:
        for n, words in ((0, (text or "").split()), (3, (title or "").split())):
            for pos, word in enumerate(words):
                want.setdefault((key, word), []).append((n << segments.FIELD_BIT) + pos)
    got = made.keyed_postings().collect()
    assert {(r.key, r.term): list(r.spots) for r in got} == want and len(got) == len(want)
    assert {(r.key, r.term): r.f for r in got} == {k: sum(1 if x >> segments.FIELD_BIT == 0 else 6 for x in v) for k, v in want.items()}
    left = made.delete(chunks.where("chunk_id < 100")).keyed_postings().collect()
    assert {(r.key, r.term): list(r.spots) for r in left} == {k: v for k, v in want.items() if k[0] >= 100}


def test_queries_of_single_terms_write_no_table_of_all_matches(spark, tmp_path, monkeypatch):
    def dies(*_):
        raise AssertionError("all matches are written")

    monkeypatch.setattr(batch, "matches", dies)
    monkeypatch.setattr(batch, "GROUP", 3)
    monkeypatch.setattr(batch, "AT_ONCE", 6)
    monkeypatch.setattr(batch, "HELD", 4)
    monkeypatch.setattr(segments, "RANGE_BITS", 3)
    some = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 2 + i % 23)), f"w{i % 5}") for i in range(150)]
    chunks = spark.createDataFrame(some + [(1000 + i, *x[1:]) for i, x in enumerate(some[:60])], "chunk_id long, text string, title string").repartition(4)  # copies tie
    made = segments.SegmentIndex.create(chunks.where("chunk_id % 3 <> 0"), str(tmp_path), part_rows=40).add(chunks.where("chunk_id % 3 = 0")).delete(chunks.where("chunk_id % 7 = 0"))
    now = chunks.where("chunk_id % 7 <> 0")
    asked = {i: " ".join(f"w{(i * k) % 15}" for k in range(1, 5 + i % 4)) for i in range(8)} | {8: "w1", 9: "nothing", 10: "w1 w1 w2 w3 w3"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    for allowed in (None, now.where("chunk_id < 90").select("chunk_id")):
        got = {}
        for r in batch.hits(made, queries, 7, allowed=allowed, stopwords=frozenset()).orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
        few = now if allowed is None else now.where("chunk_id < 90")
        for q in (0, 3, 6, 8, 9, 10):
            want = fts.ladder(fts.index(now), few, fts.parse(asked[q], stopwords=frozenset()), 1000, partial=True).collect()
            want = sorted((-round(r.score, 9), r.chunk_id) for r in want)[:7]
            assert got.get(q, []) == [(i, -s) for s, i in want], q


def test_documents_and_pages_reach_the_workers_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    long = spark.range(2500).select(F.col("id").cast("string").alias("id"), F.lit("a few words\n\n").alias("markdown"), F.lit("x.md").alias("uri")).coalesce(1)

    class Sizes:
        dims, model_id = 1, "sizes"

        def embed(self, texts):
            return [[float(len(texts))]] * len(texts)

    try:
        for make in (lambda: chunking.chunked(long), lambda: html.extracted(F.col("markdown"), F.col("uri")), lambda: vector.embed_chunks(long, Sizes(), F.col("markdown"), "id")):
            spark.conf.set(key, "10000")
            make()
            assert spark.conf.get(key) == "1000"
        assert max(r.embedding[0] for r in vector.embed_chunks(long, Sizes(), F.col("markdown"), "id").collect()) <= 1000
        assert chunking.chunked(long).count() == 2500
    finally:
        spark.conf.set(key, before)


def test_blocks_and_threes_are_written_without_a_shuffle_or_a_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SECTION", 300)  # many sections, which also end within a range
    monkeypatch.setattr(segments, "RANGE_BITS", 3)
    some = [(i, None if i % 29 == 0 else " ".join(f"Wörd{(i * k) % 17} 𝒳{k}\x00\x00" for k in range(i % 11)) + "Ab"[: i % 4]) for i in range(300)]
    chunks = spark.createDataFrame(some, "chunk_id long, text string").repartition(4)
    made = segments.SegmentIndex.create(chunks.where("chunk_id < 250"), str(tmp_path)).with_substrings().add(chunks.where("chunk_id >= 250"))
    for make in (segments.blocks_of, segments.grams_of):
        plan = make(made._chunks(made.segments[0]))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
    assert not list(tmp_path.glob("segments/*/*/*=*"))  # folders by a column's value mean a sort before the writing
    places = {}
    for k, s in enumerate(made.segments):
        places |= {(k, r[segments.PLACE]): r.text for r in made._chunks(s).collect()}
    for words in (("wörd1",), ("wörd1 𝒳1",), ("\x00\x00",), ("𝒳3\x00", "d6"), ("ab",), ("abc",), ("aabb",)):
        has = lambda t: t is not None and all(w in t.lower() for w in words)  # noqa: B023, E731
        assert sorted(r.chunk_id for r in made.substring(words, 1000).collect()) == [i for i, t in some if has(t)], words
        asked = set().union(*map(segments.grams, words))
        want = {p for p, t in places.items() if t is not None and asked <= segments.grams(t.lower())} if asked else None
        rows = made.candidates(words)
        got = None if rows is None else {(r.segment, (r.range << 3) + i) for r in rows.collect() for i in range(8) if r.bits >> i & 1}
        assert got == want, words
