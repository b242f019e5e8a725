"""Exact top-k search against scoring everything with whole numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from skyframe.llm.topk import scores, top_k

SCHEMA = "vec_id long, embedding array<double>, rank string, score string"


def plain(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % 5 == 0:
            best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best[:k])]
    return sorted(out)


def check(spark, rows, k=3, **options):
    got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0, k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, k)


def test_against_all_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(2).tolist(), "r", None) for i in range(160)]
    rows += [(200 + i, rows[3][1], None, "s") for i in range(40)] + [(5, rows[7][1], None, None)]
    rows += [(500, None, None, None), (505, [], None, None), (510, [None] * 6, None, None), (515, [float("nan")] * 6, None, None),
             (520, [float("inf")] * 6, None, None), (None, rows[0][1], None, None), (525, [1.0, 2.0], None, None), (526, [0.5, -1.0], None, None)]
    check(spark, rows, bins=16, query_rows=8, candidate_rows=50)


def test_few_candidates_and_large_numbers(spark):
    check(spark, [(0, [1.0, 2.0], None, None)])
    check(spark, [(0, [1.0, 2.0], None, None), (5, [0.0, 0.0], None, None)], k=5)
    check(spark, [(i, [10.0**e, -1.5], None, None) for i, e in enumerate([1, 6, 9, 12, 14, 7, 3])], k=4)
    assert scores(np.array([[1e12, 1.0]]), np.array([[1e12, 3.0]])).tolist() == [[2**63 - 1]]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, F.col("vec_id") % 5 == 0).count() == 0
