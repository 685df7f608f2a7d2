"""The stored vector index against exact search: recall, filters, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import vector
from tidepool.operators.vector_index import VectorIndex

KINDS = "chunk_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    around = rng.normal(size=(40, 24))
    rows = [(i, (around[i % 40] + 0.5 * rng.normal(size=24)).astype(np.float32).tolist(), i % 7) for i in range(3000)]
    rows += [(5000 + i, around[0].astype(np.float32).tolist(), 1) for i in range(300)]  # many equal ones
    rows += [(9000, None, 1), (9001, [], 1), (9002, [1.0] * 5, 1), (9003, [0.0] * 24, 1), (9004, [float("nan")] * 24, 1), (9005, [None] * 24, 1)]
    vectors = spark.createDataFrame(rows, KINDS).repartition(3)
    at = str(tmp_path_factory.mktemp("vectors"))
    VectorIndex.create(vectors, at, attributes=("label",))
    return vectors, VectorIndex.load(spark, at)


def keys(df):
    return [r.chunk_id for r in df.collect()]


def test_recall_of_all_queries(spark, made):
    vectors, index = made
    asked = vectors.where("chunk_id % 20 = 0 and chunk_id < 9000").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    got: dict[int, set] = {}
    for r in index.search_all(asked, 40).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    rows = [(r.chunk_id, r.embedding) for r in vectors.where("chunk_id < 9000").collect()]
    matrix = np.array([v for _, v in rows], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    recall = []
    for r in asked.collect():
        score = matrix @ (np.array(r.vector) / np.linalg.norm(r.vector))
        best = np.sort(score)[-40]
        recall.append(np.mean([score[[i for i, (k, _) in enumerate(rows) if k == x][0]] >= best - 1e-9 for x in got[r.query_id]]))
        assert len(got[r.query_id]) == 40
    assert len(recall) == 165 and np.mean(recall) >= 0.9


def test_exact_and_filtered(spark, made):
    vectors, index = made
    target = list(vectors.where("chunk_id = 17").first().embedding)
    assert keys(index.search(target, 30, exact=True)) == keys(vector.top_k(vectors.where("chunk_id < 9000"), target, 30))
    some = F.col("label").isin(2, 3)
    assert keys(index.search(target, 30, some, exact=True)) == keys(vector.top_k(vectors.where("chunk_id < 9000"), target, 30, where=some))
    near = keys(index.search(target, 30, some))
    assert len(set(near) & set(keys(vector.top_k(vectors.where("chunk_id < 9000"), target, 30, where=some)))) >= 27
    one = F.col("label") == 4
    assert len(keys(index.search(target, 400, one, probes=1))) == 400  # more cells are looked at until enough pass
    assert keys(index.search([1.0], 5)) == [] == keys(index.search(target, 0)) and index.told["n"] == 3300


def test_empty(spark, tmp_path):
    index = VectorIndex.create(spark.createDataFrame([], KINDS), str(tmp_path))
    assert keys(index.search([1.0, 2.0], 5)) == []
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<float>")
    assert index.search_all(queries, 5).collect() == []
