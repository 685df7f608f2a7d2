import random

import numpy as np
import pytest

from tests_llm_plain import root_of, slow_groups, slow_top
from tidepool.llm import components, minhash, vector_search


@pytest.mark.parametrize("edges", [[], [(0, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 9), (9, 5), (3, 3), (8, 9), (20, 21)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges or [(1, 1)], "x bigint, y bigint")).collect()}
    want = root_of(60, edges)
    assert all(got.get(i, i) == want[i] for i in range(60))


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(7)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  B"), (5, "a b c")]
    bases = [["".join(r.choice("abcdef") for _ in range(4)) for _ in range(n)] for n in (30, 60, 200, 200)]
    for i in range(6, 120):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as n")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(d.repartition(4), percent=85).collect()}
    assert got == slow_groups(rows, 85)


def test_near_duplicates_odd_tables(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in minhash.near_duplicates(d).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    monkeypatch.setattr(vector_search, "CELL", 8)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(i, rows[0][1]) for i in range(500, 700)]  # a hot vector
    rows += [(700, None), (800, [None] * 8), (900, [float("nan")] * 8), (1000, [float("inf")] * 8), (1100, [1.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = {tuple(r) for r in vector_search.search(d, d.where("vec_id % 100 = 0"), k=10).collect()}
    assert got == slow_top(rows, range(0, 1101, 100), 10)
    few = d.where("vec_id < 3")
    assert {tuple(r) for r in vector_search.search(few, few, k=10).collect()} == slow_top(rows[:3], range(3), 10)
    assert vector_search.search(d.limit(0), d.limit(0)).count() == 0
