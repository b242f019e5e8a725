"""Hard negatives against scoring everything with whole numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from skyframe.llm.negatives import Lists, mine_hard_negatives, threshold_search

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, id int"


def plain(rows, every=5, positives=5, negatives=10, lowest=30, highest=90):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m == label)
                        for j, m, w in good if j != i and len(w) == len(v))
        for p, pid, _ in [x for x in scored if x[2]][:positives]:
            inside = [(s, j) for s, j, alike in scored if not alike and lowest * -p <= 100 * -s <= highest * -p]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(inside[:negatives])]
    return sorted(out)


def check(spark, rows, every=5, **options):
    sizes = {k: options[k] for k in ("positives", "negatives", "lowest", "highest") if k in options}
    got = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, every, **sizes)
    assert sorted(map(tuple, got.collect())) == want
    return want


def data(n, dims, labels, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(labels)), (rng.standard_normal(dims) + shift).round(1).tolist(), None, 7) for i in range(n)]


def test_against_all_scores(spark):
    rows = data(300, 6, 4, 1)
    rows += [(400 + i, int(i % 2), rows[3][2], "x", None) for i in range(60)] + [(5, 1, rows[7][2], None, None), (5, 1, rows[7][2], None, None)]
    rows += [(500, 1, None, None, None), (505, 1, [], None, None), (510, 2, [None] * 6, None, None), (515, 2, [float("nan")] * 6, None, None),
             (520, 0, [float("inf")] * 6, None, None), (None, 0, rows[0][2], None, None), (525, None, rows[0][2], None, None), (530, 0, [1.0, 2.0], None, None),
             (531, 0, [0.5, 1.0], None, None), (532, 1, [0.5, 0.4], None, None), (535, 0, [0.0] * 6, None, None), (540, 1, [1e308] * 6, None, None)]
    assert check(spark, rows)


def test_rounds_raise_the_windows(spark):
    rows = data(400, 4, 3, 2, 0.7)
    assert check(spark, rows, every=20, first_round=1)
    assert check(spark, rows, every=20, first_round=1, shard_bytes=512, positives=3, negatives=4, lowest=-50, highest=120)


def test_large_components_and_negative_scores(spark):
    check(spark, [(i, i % 2, [10.0**e, -1.5], None, None) for i, e in enumerate([1, 6, 9, 12, 14, 7, 3, 5, 2])], every=2)
    check(spark, [(i, i % 3, [1.0 if i == 0 else -1.0, 0.25 * i], None, None) for i in range(12)], every=3)


def test_the_search_stops_early():
    rng = np.random.default_rng(4)
    far = np.floor(256 * rng.standard_normal((5000, 3)) * np.linspace(1, 20, 5000)[:, None])
    lists = Lists(np.arange(5000), np.array(["a", "b"] * 2500), far)
    query = np.array([300.0, -200.0, 0.0])
    eligible = lists.eligible(17, "a", True)
    places, found = threshold_search(lists, query, eligible, [(-2**60, 2**60)], 5)
    exact = far @ query
    want = sorted((-exact[i], i) for i in range(5000) if i % 2 == 0 and i != 17)[:5]
    assert sorted((-s, int(p)) for p, s in zip(places, found))[:5] == [(s, i) for s, i in want]
    assert len(places) < 1500


def test_empty(spark):
    assert mine_hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    check(spark, [(5, 1, [1.0], None, None)])
    check(spark, [(6, 1, [1.0], None, None), (7, 1, [1.0], None, None)])
