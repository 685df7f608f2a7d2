import numpy as np

from tidepool.llm import vector_search


def share(spark, vectors, queries):
    said = []
    vector_search.search(vectors, queries, log=said.append).count()
    return sum(x["expanded"] for x in said) / sum(x["pairs"] for x in said)


def test_only_cells_within_reach_are_expanded(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(100, 32))
    rows = [(i, (centres[i % 100] + 0.05 * rng.normal(size=32)).tolist()) for i in range(20_000)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert share(spark, d, d.where("vec_id % 100 = 7")) < 0.25


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = np.floor(1024 * rng.normal(size=(3000, 6)) * np.exp(rng.normal(size=(3000, 1)))).astype(np.int64)
    cells = vector_search.Cells(v[:500], 3000)
    cell, d = cells.place(v)
    import pandas as pd

    frame = pd.DataFrame({"cell": cell, "d": d, "norm": (v.astype(float) ** 2).sum(axis=1)})
    cells.hold(frame.groupby("cell").agg(low=("d", "min"), high=("d", "max"), norm=("norm", "max"), n=("d", "size")).reset_index())
    bound = cells.bounds(v[:200])
    scores = v[:200] @ v.T
    for i, c in enumerate(cells.cell):
        assert (scores[:, cell == c] <= bound[:, [i]]).all()


def test_every_row_as_a_query_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 90, rng.normal(size=4).round(1).tolist()) for i in range(120)]  # ids 0 .. 29 come twice
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in vector_search.search(d, d, k=3).collect()}
    good = [(i, np.floor(1024 * np.array(x)).astype(np.int64)) for i, x in rows]
    want = set()
    for q in range(90):
        v = min((x.tolist() for i, x in good if i == q))
        best = sorted((-int(np.array(v) @ x), i) for i, x in good if i != q)[:3]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want
