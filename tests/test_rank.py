import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import rank
from skyframe.operators import sample as sm
from skyframe.operators.joins import DataError
from skyframe.params import SplitParams


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "targetid")


def sizes(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


@pytest.mark.parametrize("n,want", [(34, (27, 4, 3)), (2000, (1600, 200, 200)), (5, (4, 0, 1))])
def test_split_sizes(spark, n, want):
    got = sizes(sm.assign_split(ids(spark, n)), "split")
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_split_depends_on_seed_not_on_order(spark):
    a = {tuple(r) for r in sm.assign_split(ids(spark, 500)).collect()}
    b = {tuple(r) for r in sm.assign_split(ids(spark, 500).orderBy(F.desc("targetid")).repartition(7)).collect()}
    c = {tuple(r) for r in sm.assign_split(ids(spark, 500), params=SplitParams(seed=1)).collect()}
    assert a == b and a != c


def test_bad_fractions(spark):
    with pytest.raises(DataError):
        sm.assign_split(ids(spark, 5), params=SplitParams(fractions=(0.8, 0.3, -0.1)))


@pytest.mark.parametrize("n", [29, 1000, 12935])
def test_blocks_align_with_split(spark, n):
    blocked = sm.assign_blocks(ids(spark, n)).join(sm.assign_split(ids(spark, n)), "targetid")
    assert sm.blocks_match_split(blocked).first()[0]


def test_folds_test_each_source_once(spark):
    folds = sm.with_folds(sm.assign_blocks(ids(spark, 1000)))
    tested = folds.filter("role = 'test'").groupBy("targetid").count().filter("count <> 1").count()
    assert tested == 0
    assert {(r["fold"], r["role"]): r["count"] for r in folds.groupBy("fold", "role").count().collect()} == {
        (f, role): n for f in range(5) for role, n in (("train", 700), ("val", 100), ("test", 200))}


def test_ordered_rank_and_running_total(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 3000).tolist()
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id int, v int").repartition(5)
    order = sorted(range(3000), key=lambda i: (values[i], i))
    got = {r["id"]: r["rank"] for r in rank.ordered_rank(df, ["v", "id"]).collect()}
    assert got == {i: k for k, i in enumerate(order)}
    totals = {r["id"]: r["t"] for r in rank.running_total(df, ["v", "id"], {"t": F.col("v")}).collect()}
    assert totals == {i: float(t) for i, t in zip(order, np.cumsum([values[i] for i in order]))}


def test_exact_quantiles_with_a_hot_group_and_ties(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.integers(0, 20, 2000)] + [("a", 1.0), ("b", 1.0), ("b", 4.0)] + [("c", float(x)) for x in rng.normal(size=37)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in rank.exact_quantiles(df, "v", [0.0, 0.16, 0.5, 0.975, 1.0], ["g"]).collect()}
    for g in ("hot", "a", "b", "c"):
        values = [v for k, v in data if k == g]
        for q in (0.0, 0.16, 0.5, 0.975, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(values, q), abs=1e-12)


@pytest.mark.parametrize("n", [3, 40, 501])
def test_rolling_mean(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.uniform(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    got = {r["id"]: r["mean"] for r in rank.rolling_mean(df, "x", "y", "id", 0.08).collect()}
    order, half = np.argsort(x), max(1, round(0.08 * n / 2))
    for k, i in enumerate(order):
        assert got[int(i)] == pytest.approx(y[order][max(0, k - half):k + half + 1].mean(), abs=1e-10)


def test_bootstrap_error_is_near_s_over_root_n(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(3.0, 2.0, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id int, v double")
    row = rank.bootstrap_se(df, "v", "id", replicates=600).first()
    assert row["n"] == 400 and row["se"] == pytest.approx(y.std(ddof=1) / 20, rel=0.08)
    assert rank.bootstrap_se(df.limit(1), "v", "id", replicates=10).first()["se"] is None


def plain_weights(keys, replicates, seed):
    through = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    u = [[int(hashlib.md5(f"{seed}:{r}:{k}".encode()).hexdigest()[:8], 16) / 2**32 for r in range(replicates)] for k in keys]
    return np.searchsorted(through, np.array(u).reshape(len(keys), replicates), side="right")


def test_replicate_weights_equal_the_expression(spark):
    rows = spark.range(40).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("w", rank.poisson_weight(7, "rep", "id"))
    got = np.zeros((40, 25))
    for r in rows.collect():
        got[r["id"], r["rep"]] = r["w"]
    assert (got == rank.replicate_weights([str(i) for i in range(40)], 25, 7)).all() and (got == plain_weights(range(40), 25, 7)).all()


def test_bootstrap_by_groups_with_nulls_and_repeated_keys(spark):
    rng = np.random.default_rng(6)
    data = [(i % 70, None if i % 3 == 0 else "ab"[i % 2], i % 2, None if i % 11 == 0 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(data, "id int, g string, h int, v double").repartition(5)
    got = {(r["g"], r["h"]): (r["n"], r["se"]) for r in rank.bootstrap_se(df, "v", "id", ["g", "h"], 60, 2).collect() if r["g"] is not None}
    weights = plain_weights(range(70), 60, 2).astype(float)
    for group in {(g, h) for _, g, h, _ in data if g is not None}:
        rows = [(i, v) for i, g, h, v in data if (g, h) == group]
        w = weights[[i for i, _ in rows]]
        values = np.array([0.0 if v is None else v for _, v in rows])
        assert got[group][0] == len(rows) and got[group][1] == pytest.approx((values @ w / w.sum(axis=0)).std(ddof=1), rel=1e-9)


@pytest.mark.parametrize("n,window,block_rows", [(7, 0.9, 3), (90, 0.3, 16), (301, 0.05, 64), (300, 0.7, 50), (33, 0.1, 1)])
def test_rolling_band_equals_resampling(spark, n, window, block_rows):
    rng = np.random.default_rng(n)
    y, x, replicates = rng.normal(size=n), rng.integers(0, n // 2, n).astype(float), 37
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double").repartition(3)
    got = {r["id"]: r for r in rank.rolling_band(df, "x", "y", "id", window, replicates, 5, block_rows=block_rows).collect()}
    order, half = np.lexsort((np.arange(n), x)), rank.half_window(n, window)
    w = plain_weights(order.tolist(), replicates, 5).astype(float)
    assert len(got) == n
    for k, i in enumerate(order.tolist()):
        inside = slice(max(0, k - half), k + half + 1)
        total = w[inside].sum(axis=0)
        means = (y[order][inside] @ w[inside])[total > 0] / total[total > 0]
        assert got[i]["rank"] == k
        assert (got[i]["lo"], got[i]["hi"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)


def test_rolling_band_encloses_the_mean(spark):
    df = spark.range(300).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    band = rank.rolling_band(df, "x", "y", "id", 0.2, 60, 1).join(rank.rolling_mean(df, "x", "y", "id", 0.2).select("id", "mean"), "id")
    assert band.count() == 300 and band.filter("mean BETWEEN lo AND hi").count() > 290


def test_order_breaks(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("b", 1, 9), ("b", 2, 3)], "g string, k int, v int")
    got = {(r["g"], r["k"]) for r in rank.order_breaks(df, "v", ["g"], "k").collect()}
    assert got == {("a", 3), ("b", 2)}


def test_weights_of_texts_of_all_lengths_equal_plain_ones():
    """Digests taken many at a time, on both sides of a digest's block and with heads of several lengths."""
    keys = ["", "7", "40", "é" * 9, *(str(k) for k in range(5_999_990, 6_000_010)), *("x" * n for n in range(45, 62))]
    edges = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
    want = [[sum(e <= int(hashlib.md5(f"11:{r}:{k}".encode()).hexdigest()[:8], 16) / 4294967296.0 for e in edges) for r in range(120)] for k in keys]
    assert (rank.replicate_weights(keys, 120, 11) == np.array(want)).all() and rank.replicate_weights([], 3, 1).shape == (0, 3)


@pytest.mark.parametrize("n,window,block_rows", [(301, 0.3, 16), (90, 0.05, 64)])
def test_bands_of_several_columns_share_ranks_and_weights(spark, n, window, block_rows):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rng.normal(size=(n, 3)))], "id int, x double, y double, z double")
    drawn = []
    settled = rank.settle

    def counted(rows):
        drawn.append("_w" in rows.columns)
        return settled(rows)

    rank.settle = counted
    try:
        both = rank.rolling_bands(df, "x", ["y", "z"], "id", window, 30, 2, block_rows=block_rows)
    finally:
        rank.settle = settled
    assert sum(drawn) == 1  # weights are written once
    for c in ("y", "z"):
        one = rank.rolling_band(df, "x", c, "id", window, 30, 2).orderBy("id").collect()
        for a, b in zip(both[c].orderBy("id").collect(), one, strict=True):
            assert a["rank"] == b["rank"] and (a["lo"], a["hi"]) == pytest.approx((b["lo"], b["hi"]), abs=1e-9)


def test_rolling_band_moves_keys_and_not_weights(spark, monkeypatch):
    """Of the weights only sums by block are written or moved: two vectors of replicates a block and not a binary a row. Keys stay exact."""
    n, replicates, moved, kept = 600, 80, [], []
    spread, settle = rank.spread, rank.settle
    monkeypatch.setattr(rank, "spread", lambda df, *keys: moved.append(df) or spread(df, *keys))
    monkeypatch.setattr(rank, "settle", lambda df: kept.append(df) or settle(df))
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=n), rng.normal(size=n)
    first = 2**60 + 1
    df = spark.createDataFrame([(first + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    got = {r["id"]: r for r in rank.rolling_band(df, "x", "y", "id", 0.3, replicates, 4, block_rows=60).collect()}
    assert all(f.dataType.simpleString() != "binary" for frame in moved + kept for f in frame.schema)
    blocks = math.ceil(n / 60) + 1
    vectors = [frame.selectExpr("explode(_w)").count() for frame in moved if "array" in dict(frame.dtypes).get("_w", "")]
    assert vectors and max(vectors) <= 2 * blocks * replicates and all(frame.count() <= blocks * replicates for frame in kept if "_w" in frame.columns)
    order, half = np.argsort(x), rank.half_window(n, 0.3)
    w = plain_weights([first + i for i in order.tolist()], replicates, 4).astype(float)
    for k, i in enumerate(order.tolist()):
        inside = slice(max(0, k - half), k + half + 1)
        means = (y[order][inside] @ w[inside]) / w[inside].sum(axis=0)
        assert got[first + i]["rank"] == k and (got[first + i]["lo"], got[first + i]["hi"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)


@pytest.mark.parametrize("rows,parts", [(5000, 4), (40, 200)])
def test_rolling_band_chooses_its_blocks(spark, monkeypatch, rows, parts):
    """Chains of many blocks, of which tasks take a few at a time, give the bands that single blocks give."""
    monkeypatch.setattr(rank, "BAND_ROWS", 8)
    monkeypatch.setattr(rank, "MOST_BAND_ROWS", 32)
    monkeypatch.setattr(rank, "CHAIN_BLOCKS", 3)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(rows, 2)))], "id int, x double, y double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        some = rank.rolling_band(df, "x", "y", "id", 0.02, 25, 1).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    x, y, half = np.array([r["x"] for r in some]), df.orderBy("x", "id").toPandas()["y"].to_numpy(), rank.half_window(rows, 0.02)
    w = plain_weights([r["id"] for r in some], 25, 1).astype(float)
    assert (np.diff(x) >= 0).all() and [r["rank"] for r in some] == list(range(rows))
    through = np.concatenate((np.zeros((1, 25)), np.cumsum(w, axis=0))), np.concatenate((np.zeros((1, 25)), np.cumsum(w * y[:, None], axis=0)))
    for k, r in enumerate(some):
        lo, hi = max(0, k - half), min(rows, k + half + 1)
        total = through[0][hi] - through[0][lo]
        means = (through[1][hi] - through[1][lo])[total > 0] / total[total > 0]
        assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)


def test_bands_of_several_columns_move_rows_once(spark, monkeypatch):
    """Rows and sums of all columns travel together, however many columns there are."""
    moved, spread = [], rank.spread
    monkeypatch.setattr(rank, "spread", lambda df, *keys: moved.append(df) or spread(df, *keys))
    rows = [(i, float(i * 7 % 50), *([float(i % k) for k in (3, 5, 8)])) for i in range(120)]
    bands = rank.rolling_bands(spark.createDataFrame(rows, "id int, x double, a double, b double, c double"), "x", ["a", "b", "c"], "id", 0.2, 30, 2)
    assert [len(b.collect()) for b in bands.values()] == [120, 120, 120]
    assert len(moved) == 2 and all(f.dataType.simpleString() != "binary" for df in moved for f in df.schema)
