import numpy as np

from tidepool.llm import vector_search


def test_each_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=d).astype(np.float32).tolist()) for i, d in enumerate([4] * 60 + [6] * 50 + [9])]
    rows += [(0, rows[100][1])]  # an id with vectors of two lengths
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = d.where("vec_id % 10 = 0")
    got = sorted(tuple(r) for r in vector_search.search(d, queries, k=5).collect())
    good = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows]
    want = []
    for q, v in good:
        if q % 10 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(v) == len(w))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and {r[0] for r in got} == set(range(0, 110, 10))
