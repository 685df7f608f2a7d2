import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepool.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", " a", "a  b", "a\n b", "\tx  y\n\n z ", "don't WE'LL 's", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "a" * 3000, "\x1c a \x1d", "\xa0 x  y", "😀 é ü", "日本語", "ΑΣ ΟΔΟΣ", "İx", "<|x", "a\x85 b"]


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice(" \n\tA'sreb1!é<|\xa0日,.") for _ in range(r.randint(0, 40))) for _ in range(400)]


def test_byte_level_round_trip():
    t, table = Tokenizer.from_file(BYTE), bpe.MergeTable(BYTE)
    batch = texts()
    ids, at = bpe.ByteLevelEncoder(table).encode(batch)
    for text, want, a, b, got in zip(batch, t.encode_batch(batch, add_special_tokens=False), at, at[1:], table.decode(ids, at), strict=False):
        assert ids[a:b].tolist() == want.ids, text
        assert got.decode("utf-8", "replace") == t.decode(want.ids, skip_special_tokens=False)


def test_encoder_forgets_without_a_trace(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    encoder, t = bpe.ByteLevelEncoder(bpe.MergeTable(BYTE)), Tokenizer.from_file(BYTE)
    for text in texts():
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_counts(spark):
    rows, t = [*texts(), None], Tokenizer.from_file(WORD)
    for size in (0, 50):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs(spark, rows), WORD, frequent=size).collect()}
        assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(rows)}


def test_encode_documents_keeps_columns(spark):
    d = docs(spark, ["a b", None]).selectExpr("*", "1 as ids", "2 as score")
    out = {r.doc_id: r for r in bpe.encode_documents(d, BYTE).collect()}
    assert out[0].decoded == "a b" and list(out[1].ids) == []
    assert bpe.encode_documents(d.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_plan_holds_every_piece(n):
    lengths = np.random.default_rng(n).integers(1, 1025, n)
    histogram = np.bincount(lengths, minlength=1025)
    held = np.zeros(1025, int)
    kinds = packing.plan(histogram)
    for count, parts, _ in kinds:
        assert sum(parts) <= 1024
        for p in parts:
            held[p] += count
    assert (held == histogram).all()
    assert packing.sequences(kinds) <= packing.sequences(packing.best_fit(histogram))


def test_packed_sequences(spark):
    rows = [*texts(), None, "word " * 5000, "x", "x", "x"]
    out = packing.pack(docs(spark, rows).repartition(5), BYTE).collect()
    t, places, by_doc = Tokenizer.from_file(BYTE), {}, {}
    for r in out:
        assert r.length == len(r.ids) <= 1024
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(rows):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [k for p in parts for k in p.ids] == [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert all(p.length == 1024 for p in parts[1:])
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(docs(spark, []), BYTE).count() == 0
