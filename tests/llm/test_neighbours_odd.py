"""Neighbours of tiny, huge and repeated vectors."""

import numpy as np

from tracewell.llm.neighbours import cosines, nearest_neighbours


def test_scores_of_tiny_and_huge_vectors():
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=8), rng.normal(size=(50, 8))
    plain = (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))
    assert (cosines(q, v) == plain).all()
    for a, b in ((1e-200, 1e200), (1e200, 1e-200), (5e-320, 1.0), (1e300, 1e300)):
        assert np.allclose(cosines(q * a, v * b), plain, rtol=1e-3 if a < 1e-300 else 1e-12, atol=1e-3 if a < 1e-300 else 1e-14)


def test_repeated_query_ids_and_extreme_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-200, 1e-200]), (3, [1e200, 1e200]), (4, [0.0, 1.0]), (4, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [5.0, 0.0]), (9, [0.0, 5.0]), (2, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    for parts in (1, 3):
        got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 12)) for r in nearest_neighbours(table, asked.repartition(parts), 2).collect()}
        assert got == {(9, 1): (4, 1.0), (9, 2): (2, round(0.5**0.5, 12)), (2, 1): (3, 1.0), (2, 2): (1, round(0.5**0.5, 12))}
