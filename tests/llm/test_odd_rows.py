"""Repeated rows, ids with several texts or languages, ties and very long texts, operator by operator."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests_llm_plain import slow_top
from tidepool.llm import bpe, compression_quality, langid, token_counts, vector_search

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def prose(r, n=60):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_tokens_of_repeated_and_very_long_rows(spark):
    long = "word don't <|endoftext|> é " * 40_000
    rows = [(1, "a b"), (1, "a b"), (1, "another"), (2, long), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    for name, make in ((BYTE, bpe.encoded_digests), (WORD, token_counts.count_tokens)):
        t = Tokenizer.from_file(name)
        got = sorted((r.doc_id or 0, r.n_tokens) for r in make(docs, name).collect())
        assert got == sorted((i or 0, len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows)


def test_every_row_is_a_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)] + [(500 + i, [1.0] * 8) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.search(vectors, vectors, k=4).collect()}
    assert got == slow_top(rows, [i for i, _ in rows], 4)


def test_languages_that_tie_and_ids_that_repeat(spark):
    r = random.Random(5)
    texts = [prose(r) for _ in range(40)]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in ("bb", "aa")]  # every id in two languages, with one text
    docs = spark.createDataFrame([*rows, *rows, (900, "xyz " * 300_000, "zz"), (901, None, "zz")], "doc_id bigint, text string, lang string")
    profiles = langid.learn(docs)
    found = docs.select("doc_id", langid.identifier(spark, profiles)("text").alias("at")).distinct().collect()
    told = {x.doc_id: (x["at"].lang_pred, x["at"].score) for x in found}
    assert len(found) == len(told) and all(0 <= s <= 1 for _, s in told.values())
    assert {told[i][0] for i in range(40)} == {"aa"} and told[900][0] == "zz" and told[901][0] == "und"


def test_quality_of_repeated_rows_and_several_texts(spark):
    r = random.Random(6)
    good, bad = [prose(r, 120) for _ in range(80)], [prose(r, 120).replace(" ", "$$$ ") for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 80)) for i, _ in rows] * 2 + [(3, 0), (999, 1), (None, 0)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([*rows, *rows, (5, "another text of this id"), (700, "$$$ " * 200_000), (701, good[0] * 300)], "doc_id bigint, text string")
    model = compression_quality.fit(docs, labels)
    out = docs.select("doc_id", "text", compression_quality.scorer(spark, model)("text").alias("s")).collect()
    by_text: dict[str, set] = {}
    for x in out:
        by_text.setdefault(x.text, set()).add(x.s)
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in by_text.values())
    assert np.mean([min(by_text[t]) >= 0.5 for t in good]) > 0.9 and np.mean([min(by_text[t]) < 0.5 for t in bad]) > 0.9
    assert min(by_text["$$$ " * 200_000]) < 0.5 < min(by_text[good[0] * 300])
    one = compression_quality.fit(docs, labels.where("quality = 1"))
    assert all(0 <= x.s <= 1 for x in docs.limit(3).select(compression_quality.scorer(spark, one)(F.col("text")).alias("s")).collect())
