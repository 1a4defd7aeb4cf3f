"""Nearest neighbours and the retrieval pipeline against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeline.operators import retrieval
from forgeline.operators.vectors import nearest

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=60, size=5, seed=2):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randrange(4)) for _ in range(size)], i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows + [(90, None, 0), (91, [], 0), (None, [1.0] * size, 0), (92, [1.0], 1)], VEC)


def test_nearest_with_ties_nulls_and_other_lengths(spark):
    rows, df = vectors(spark)
    got = {}
    for r in nearest(df, df.filter("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    for q in (0, 20, 40):
        want = sorted((sum((x - y) ** 2 for x, y in zip(v, rows[q][1])), i) for i, v, _ in rows)[:7]
        assert got[q] == [(i, d) for d, i in want]
    assert nearest(df.limit(0), df, 3).count() == 0 and nearest(df, df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        nearest(df, df, 0)


@pytest.mark.parametrize("top_k,pool", [(1, 3), (5, 15), (67, 200), (1000, 200)])
def test_pool(top_k, pool):
    assert retrieval.pool_size(top_k) == pool


@pytest.mark.parametrize("asked", [None, 0, -2])
def test_defaults(asked):
    assert retrieval.resolved(asked, 5) == 5


def test_pipeline_order(spark):
    v = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [2.0], 0), (3, [3.0], 0), (4, [4.0], 0)], VEC)
    r = spark.createDataFrame([(0, "c0", "x = 1", "src/a.py", "alpha"), (1, "c1", " \n\t", "src/b.py", "beta"), (2, "c0", "x = 1", "src/a.py", "alpha"), (3, "c3", "y", "lib/login.py", "check_login"), (4, "c4", "z", "lib/z.py", None)], "vec_id long, chunk_id string, code string, file_path string, symbol_name string")
    q = v.filter("vec_id = 0").withColumn("query_text", F.lit("the login check"))
    got = [(x.chunk_id, round(x.similarity, 3), round(x.rank_score, 3)) for x in retrieval.retrieve(v, r, q, top_k=2).orderBy("rank").collect()]
    assert got == [("c0", 1.0, 1.0), ("c3", 0.1, 0.2)]
    assert [x.chunk_id for x in retrieval.retrieve(v, r, q, top_k=2, path="lib/login.py").collect()] == ["c3"]
    assert [x.chunk_id for x in retrieval.retrieve(v, r, q, top_k=1, path="lib/z.py").collect()] == []
    assert [x.chunk_id for x in retrieval.retrieve(v, r, q, threshold=0.5).collect()] == ["c0"]
    assert [x.chunk_id for x in retrieval.retrieve(v, r, q, where=F.col("symbol_name") == "check_login").collect()] == ["c3"]


def test_packing_skips_what_does_not_fit_and_goes_on(spark):
    rows = [(1, 1, "a", "p", "x" * 40), (1, 2, "b", "p", "x" * 400), (1, 3, "c", None, "y" * 20), (2, 1, "d", "q", "")]
    ranked = spark.createDataFrame(rows, "query_id long, rank long, chunk_id string, file_path string, code string")
    packed = retrieval.pack(ranked, 20)
    got = {r.query_id: (r.tokens, r.truncated, [c.chunk_id for c in r.chunks]) for r in packed.collect()}
    assert got == {1: (15, True, ["a", "c"]), 2: (1, False, ["d"])}
    text = {r.query_id: r.context for r in retrieval.render(packed).collect()}
    assert text[1] == "\n\nFile: p\n\n" + "x" * 40 + "\n\n" + "-" * 80 + "\n\nFile: \n\n" + "y" * 20


def test_index_finds_what_the_exact_search_finds(spark):
    from forgeline.operators import vectors as V

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    points = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8))
    rows = [(f"k{i}", [float(np.float32(x)) for x in p]) for i, p in enumerate(points)] + [("short", [1.0, 2.0]), ("none", None), ("empty", []), (None, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    q = v.filter("vec_id like '%00'")
    exact = V.nearest(v, q, 10)
    found = V.nearest_in_cells(v, q, V.fitted_cells(v, 12, 500), 10, 4)
    r = V.recall(found, exact).first()
    assert r.n_exact == 140 and r.recall >= 0.9
    assert exact.filter("query_id = 'k100' and rank = 1").first()["vec_id"] == "k100"
    assert 1 <= V.probes_needed(v, V.fitted_cells(v, 12, 500), 10) <= 12
    everything = V.nearest_in_cells(v, q, V.fitted_cells(v, 12, 500), 10, 12)
    assert V.recall(everything, exact).first().recall == 1.0
    assert V.nearest_in_cells(v.limit(0), q.limit(0), V.fitted_cells(v.limit(0)), 3).count() == 0
