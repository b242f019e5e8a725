import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import poisson as po
from skyframe.operators import density as dn
from skyframe.operators import linear
from skyframe.operators import sample as sm
from skyframe.operators import scoring as sc
from skyframe.operators.joins import DataError
from skyframe.params import Head, ScoreParams
from skyframe.plans import scoring as ps
from skyframe.session import settle


def brute_kde(train, points, bandwidth=1.0):
    if len(train) * len(points) > 1_000_000:
        return np.concatenate([brute_kde_of(train, p[None], bandwidth) for p in points])
    return brute_kde_of(train, points, bandwidth)


def brute_kde_of(train, points, bandwidth):
    n, d = train.shape
    cov = np.cov(train.T).reshape(d, d) * (n ** (-1 / (d + 4)) * bandwidth) ** 2
    white = np.linalg.inv(np.linalg.cholesky(cov))
    gap = points[:, None] @ white.T - (train @ white.T)[None]
    x = -0.5 * (gap**2).sum(axis=2)
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1)) - 0.5 * d * math.log(2 * math.pi) - math.log(n) - 0.5 * np.linalg.slogdet(cov)[1]


def table(spark, values, names):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(values)], "id int, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("d,n", [(1, 6000), (2, 3000), (3, 400), (4, 300)])
def test_kde_equals_brute_force(spark, d, n):
    rng = np.random.default_rng(d)
    train = rng.normal(size=(n, d))
    train[: n // 3] = train[0]  # a third of the rows are copies
    points = np.vstack([rng.normal(size=(40, d)), np.full((1, d), 5.0), np.full((1, d), -7.0)])
    names = list("abcd")[:d]
    kde = dn.GaussianKDE.fit(table(spark, train, names), names)
    pts = table(spark, points, names)
    want = brute_kde(train, points)
    got = [r["lp"] for r in kde.scored(pts, [F.col(c) for c in names], "lp").orderBy("id").collect()]
    assert np.allclose(got, want, atol=2e-6)
    missing = kde.scored(pts.withColumn("a", F.when(F.col("id") > 2, F.col("a"))).union(pts.filter("id = 5")), [F.col(c) for c in names], "lp")
    rows = missing.orderBy("id").collect()
    assert missing.columns == ["id", *names, "lp"] and [r["lp"] is None for r in rows[:4]] == [True, True, True, False] and len(rows) == 43
    assert rows[5]["lp"] == rows[6]["lp"]


@pytest.mark.parametrize("d,n", [(2, 400_000), (4, 250_000)])
def test_kde_of_many_rows(spark, d, n):
    """Far more rows than a task could be handed, with a tail point, on both sides of the cell and distance rules."""
    names = list("abcd")[:d]
    drawn = spark.range(n, numPartitions=8).select(*[(F.randn(7 + i) + (F.randn(1) if i else 0)).alias(c) for i, c in enumerate(names)])
    train = settle(drawn)
    x = train.toPandas().to_numpy()
    points = np.vstack([np.random.default_rng(1).normal(size=(6, d)), np.full((1, d), 4.0), np.full((1, d), -9.0)])
    kde = dn.GaussianKDE.fit(train, names)
    got = [r["lp"] for r in kde.scored(table(spark, points, names), [F.col(c) for c in names], "lp").orderBy("id").collect()]
    assert np.allclose(got, brute_kde(x, points), atol=5e-6)


def test_near_blocks_hold_what_matters(spark):
    """The share of far blocks stays below the tolerance, and blocks are really left out."""
    x = np.concatenate([np.random.default_rng(3).normal(size=3000), [60.0, 61.0]])
    points = np.array([[-1.0], [0.0], [30.0], [60.5]])
    for tolerance in (1e-3, 1e-9):
        kde = dn.GaussianKDE.fit(table(spark, x[:, None], ["a"]), ["a"], 0.2, tolerance)
        assert kde.blocks.count() > 4
        got = [r["lp"] for r in kde.scored(table(spark, points, ["a"]), [F.col("a")], "lp").orderBy("id").collect()]
        assert np.allclose(got, brute_kde(x[:, None], points, 0.2), atol=max(2e-6, 2 * tolerance))


def test_kde_in_four_dimensions_meets_by_the_tree(spark):
    """Many blocks on both sides, some points far out: a sample of points against all kernels, and no product of all pairs in the plan."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30_000, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0.3], [0, 0, 1, 0], [0, 0, 0.2, 2]])
    points = np.concatenate([rng.uniform(-4, 4, size=(9_000, 4)), rng.uniform(-30, 30, size=(40, 4))])
    names = ["a", "b", "c", "d"]
    kde = dn.GaussianKDE.fit(table(spark, x, names), names)
    assert kde.size > 6
    scored = kde.scored(table(spark, points, names), [F.col(c) for c in names], "lp")
    assert "CartesianProduct" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["lp"] for r in scored.collect()}
    some = [*range(0, 9_000, 100), *range(9_000, 9_040, 4)]
    assert len(got) == 9_040 and np.allclose([got[i] for i in some], brute_kde(x, points[some]), atol=2e-6)


def test_kde_needs_rows(spark):
    with pytest.raises(DataError):
        dn.GaussianKDE.fit(table(spark, np.zeros((1, 1)), ["a"]), ["a"])
    with pytest.raises(ValueError):
        dn.GaussianKDE.fit(table(spark, np.zeros((3, 1)), ["a"]), ["a"], 0.0)


def test_prior_grid_integrates_to_one(spark):
    df = spark.range(1)
    one = sc.log_marginal(df, [po.prior_axis(64)], dn.NormalDensity((0.0,), (1.0,)), "ll").first()["ll"]
    two = sc.log_marginal(df, [po.prior_axis(64), po.prior_axis(64)], dn.NormalDensity((0.0, 0.0), (1.0, 1.0)), "ll").first()["ll"]
    assert one == pytest.approx(0.0, abs=1e-4) and two == pytest.approx(0.0, abs=1e-4)


# Standardization and counts for which twelve nodes are stated to be exact to 1e-3: log rates near -2.5 with a
# deviation of a third of a dex. Wider standardizations make the zero-count posterior too skew for twelve nodes.
RATE_MEAN, RATE_SCALE = -2.5, 0.35
COUNTS = [(0, 2.0, 1000.0), (1, 0.0, 1000.0), (3, 0.5, 1000.0), (12, 1.0, 1000.0), (400, 5.0, 1000.0), (5000, 40.0, 1000.0)]


def test_twelve_nodes_equal_a_dense_integral(spark):
    mean, scale = RATE_MEAN, RATE_SCALE
    df = spark.createDataFrame(COUNTS, "n int, b double, t double")
    got = [r["ll"] for r in sc.log_marginal(df, [po.rate_axis("n", "b", "t", mean, scale)], dn.NormalDensity((0.0,), (1.0,)), "ll").collect()]
    u = np.linspace(-12, 12, 400_001)
    for (n, b, t), ll in zip(COUNTS, got):
        mu = t * 10 ** (scale * u + mean) + b
        terms = n * np.log(mu) - mu - math.lgamma(n + 1) - 0.5 * u * u - 0.5 * math.log(2 * math.pi)
        assert ll == pytest.approx(terms.max() + math.log(np.exp(terms - terms.max()).sum() * (u[1] - u[0])), abs=1e-3)


def test_independent_axes_add(spark):
    df = spark.createDataFrame(COUNTS, "n int, b double, t double")
    a, b = po.rate_axis("n", "b", "t", -1.0, 0.8), po.prior_axis()
    both = [r["ll"] for r in sc.log_marginal(df, [a, b], dn.NormalDensity((0.1, -0.3), (1.1, 0.9)), "ll").collect()]
    one = [r["ll"] for r in sc.log_marginal(df, [a], dn.NormalDensity((0.1,), (1.1,)), "ll").collect()]
    two = [r["ll"] for r in sc.log_marginal(df, [b], dn.NormalDensity((-0.3,), (0.9,)), "ll").collect()]
    assert np.allclose(both, np.add(one, two), atol=1e-10)


def labels(spark, n=300):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        z = float(rng.uniform(0, 1))
        sfr = None if i % 11 == 0 else float(z + rng.normal(0, 0.2))
        mstar = None if i % 7 == 0 else float(10 + 0.5 * z + rng.normal(0, 0.3))
        rows.append((i, ("train", "val", "test")[0 if i % 10 < 8 else 1 + (i % 10 == 9)], z, sfr, mstar, int(rng.poisson(6)), 0.5, 0.0 if i % 13 == 0 else 100.0))
    return spark.createDataFrame(rows, "source_id int, split string, redshift double, log_sfr double, logmstar_cigale double, ape_cts_p2 int, "
                                       "ape_bkg_p2 double, ape_exp_p2 double")


def test_likelihood_by_pattern(spark):
    df = labels(spark)
    head = Head("mixed", ("rate_p2", "sfr", "mstar"))
    s = sm.fit_standardizer(df, head.targets)
    density = dn.NormalDensity((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    masked = sm.with_masks(df)
    got = {r["source_id"]: r for r in sc.head_log_likelihood(masked, head, s, density).collect()}
    assert len(got) == 300
    for r in got.values():
        assert (r["ll"] is None) == (r["log_sfr"] is None and r["logmstar_cigale"] is None)
    r = next(r for r in got.values() if not r["rate_p2_ok"] and r["sfr_ok"] and not r["mstar_ok"]) if any(
        not r["rate_p2_ok"] and r["sfr_ok"] and not r["mstar_ok"] for r in got.values()) else None
    if r is not None:
        u = (r["log_sfr"] - s.mean["sfr"]) / s.scale["sfr"]
        assert r["ll"] == pytest.approx(-0.5 * u * u - 0.5 * math.log(2 * math.pi), abs=1e-3)


def test_standardizer(spark):
    df = labels(spark)
    s = sm.fit_standardizer(df, ["sfr"])
    x = np.array([r[0] for r in df.filter("split = 'train' AND log_sfr IS NOT NULL").select("log_sfr").collect()])
    assert s.mean["sfr"] == pytest.approx(x.mean()) and s.scale["sfr"] == pytest.approx(x.std())
    assert sm.Standardizer.from_json(s.to_json()) == s
    with pytest.raises(DataError):
        sm.fit_standardizer(df.withColumn("log_sfr", F.lit(None).cast("double")), ["sfr"])


def test_dead_head(spark):
    masked = sm.with_masks(labels(spark).withColumn("log_sfr", F.lit(None).cast("double")))
    with pytest.raises(DataError, match="sfr"):
        sm.require_live_heads(sm.scorable_counts(masked, [Head("sfr", ("sfr",)), Head("mstar", ("mstar",))]))


def test_specific_rate_of_independent_normals(spark):
    s = sm.Standardizer({"sfr": 0.3, "mstar": 10.0}, {"sfr": 0.7, "mstar": 0.4})
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-11, -8.5, 9)], "s double")
    pair = dn.NormalDensity((0.0, 0.0), (1.0, 1.0))
    one = dn.NormalDensity((0.0,), (1.0,))
    sigma = math.hypot(0.7, 0.4)
    for r in sc.specific_rate_densities(df, "s", s, pair, one, one).collect():
        want = -0.5 * ((r["s"] + 9.7) / sigma) ** 2 - math.log(sigma) - 0.5 * math.log(2 * math.pi)
        assert r["log_p_joint"] == pytest.approx(want, abs=1e-8) and r["log_p_independent"] == pytest.approx(want, abs=1e-8)


def test_heads_equal_least_squares(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    y = 1.0 + x @ [0.5, -0.2, 0.0] + rng.normal(0, 0.3, 500)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "source_id int, a double, b double, c double, y double")
    heads = linear.fit_heads(df, {"Z": ["a"], "S": ["b"], "I": ["c"], "W": []}, ["y"], ["Z", "ZSI"])
    for h, cols in zip(heads, ([0], [0, 1, 2])):
        design = np.column_stack([np.ones(500), x[:, cols]])
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        assert np.allclose([h.intercept, *h.coefficients], beta, atol=1e-9)
        assert h.sigma == pytest.approx(np.sqrt(((y - design @ beta) ** 2).mean()), rel=1e-9)
    scored = linear.score_heads(df, heads).filter("subset = 'ZSI' AND source_id = 3").first()
    mean = heads[1].intercept + x[3] @ np.array(heads[1].coefficients)
    assert scored["mean"] == pytest.approx(mean) and scored["truth"] == pytest.approx(y[3])
    t = (y[3] - mean) / heads[1].sigma
    assert scored["ll"] == pytest.approx(-0.5 * t * t - math.log(heads[1].sigma) - 0.5 * math.log(2 * math.pi))


def test_model_equal_to_prior_gains_nothing(spark):
    rows = [(i, "lx", s, 0.3 * i, 0.3 * i, True) for i in range(5) for s in sm.subset_names()]
    df = spark.createDataFrame(rows, "source_id int, head string, subset string, ll double, prior double, common boolean")
    gains = sc.information_gain(df)
    assert all(r["information_gain"] == 0 and r["n"] == 5 for r in gains.collect()) and gains.count() == 15
    assert sc.incomplete_heads(gains, ["lx"]).isEmpty() and not sc.incomplete_heads(gains, ["lx", "sfr"]).isEmpty()


def test_subset_draws(spark):
    df = spark.range(4000).select("id", (F.col("id") % 5 != 0).alias("z"), F.lit(True).alias("s"), F.lit(True).alias("i"), (F.col("id") % 2 == 0).alias("w"))
    out = df.withColumn("subset", sm.draw_subset(["z", "s", "i", "w"], "id", 3))
    assert out.filter("subset = ''").isEmpty()
    assert out.filter("(NOT z AND contains(subset, 'Z')) OR (NOT w AND contains(subset, 'W'))").isEmpty()
    sizes = {r[0]: r[1] for r in out.filter("z AND w").groupBy(F.length("subset")).count().collect()}
    assert set(sizes) == {1, 2, 3, 4} and max(sizes.values()) < 1.3 * min(sizes.values())


def test_kernel_prior_through_quadrature(spark):
    """The prior of a rate and a scalar, against sums over all training rows and nodes."""
    df = labels(spark)
    head = Head("pair", ("rate_p2", "sfr"))
    s = sm.fit_standardizer(df, head.targets)
    prior = sc.fit_prior(df, head, s)
    got = sc.head_log_likelihood(sm.with_masks(df), head, s, prior).collect()

    def rate(r):
        return (math.log10(max(r["ape_cts_p2"] - r["ape_bkg_p2"], 0.5) / r["ape_exp_p2"]) - s.mean["rate_p2"]) / s.scale["rate_p2"]

    def scalar(r):
        return (r["log_sfr"] - s.mean["sfr"]) / s.scale["sfr"]

    train = np.array([(rate(r), scalar(r)) for r in got if r["split"] == "train" and r["rate_p2_ok"] and r["sfr_ok"]])
    offsets = np.linspace(-5, 5, 12)
    for r in got:
        if not r["sfr_ok"]:
            assert r["ll"] is None
            continue
        if r["rate_p2_ok"]:
            n, b, t = r["ape_cts_p2"], r["ape_bkg_p2"], r["ape_exp_p2"]
            sigma = math.sqrt(max(n, 1)) / (math.log(10) * s.scale["rate_p2"] * max(n - b, 0.5))
            nodes = rate(r) / (1 + sigma**2) + sigma / math.sqrt(1 + sigma**2) * offsets
            mu = t * 10 ** (s.scale["rate_p2"] * nodes + s.mean["rate_p2"]) + b
            like, spacing = n * np.log(mu) - mu - math.lgamma(n + 1), nodes[1] - nodes[0]
        else:
            nodes, like, spacing = offsets, np.zeros(12), offsets[1] - offsets[0]
        terms = brute_kde(train, np.column_stack([nodes, np.full(12, scalar(r))])) + like
        want = terms.max() + math.log(np.exp(terms - terms.max()).sum()) + math.log(spacing)
        assert r["ll"] == pytest.approx(want, abs=1e-6)


def test_specific_rate_under_kernel_densities(spark):
    rng = np.random.default_rng(9)
    pair = rng.normal(size=(200, 2)) @ [[1.0, 0.6], [0.0, 0.8]]
    s = sm.Standardizer({"sfr": 0.3, "mstar": 10.0}, {"sfr": 0.7, "mstar": 0.4})
    train = table(spark, pair, ["sfr", "mstar"])
    densities = [dn.GaussianKDE.fit(train, c) for c in (["sfr", "mstar"], ["sfr"], ["mstar"])]
    df = spark.createDataFrame([(-10.5,), (-9.7,), (-9.0,), (None,)], "s double")
    got = {r["s"]: r for r in sc.specific_rate_densities(df, "s", s, *densities).collect()}
    assert got[None]["log_p_joint"] is None or math.isnan(got[None]["log_p_joint"])
    mass = np.linspace(-8, 8, 256)
    for value in (-10.5, -9.7, -9.0):
        u = np.column_stack([(value + mass * 0.4 + 10.0 - 0.3) / 0.7, mass])
        for name, terms in (("log_p_joint", brute_kde(pair, u)), ("log_p_independent", brute_kde(pair[:, :1], u[:, :1]) + brute_kde(pair[:, 1:], u[:, 1:]))):
            want = terms.max() + math.log(np.exp(terms - terms.max()).sum()) + math.log(mass[1] - mass[0]) - math.log(0.7)
            assert got[value][name] == pytest.approx(want, abs=1e-6)


BLOCKS = {"Z": ["redshift"], "S": ["f_s"], "I": ["f_i"], "W": ["f_w"]}


def evaluation_labels(spark, n=240):
    rows = labels(spark, n).withColumns({c: F.lit(True) for c in ("has_z", "has_spectrum", "has_image", "has_wise")})
    k = F.col("source_id")
    return rows.withColumns({"spectype": F.lit("QSO"), "f_s": (k * 31 % 101) / 50.0, "f_i": (k * 17 % 97) / 40.0, "f_w": (k * 7 % 89) / 30.0})


def test_evaluate_scores_every_head(spark):
    heads = (Head("sfr", ("sfr",)), Head("sfr_mstar", ("sfr", "mstar")), Head("rate", ("rate_p2",)), Head("mixed", ("rate_p2", "sfr")))
    done = ps.evaluate(evaluation_labels(spark), BLOCKS, ScoreParams(heads=heads))
    gains = done.gains().collect()
    assert {(r["head"], r["subset"]) for r in gains} == {(h.name, s) for h in heads for s in sm.subset_names()}
    assert all(math.isfinite(r["information_gain"]) for r in gains)
    named = {("sfr", "sfr"), ("sfr_mstar", "sfr"), ("sfr_mstar", "mstar"), ("mixed", "sfr")}
    assert {(r["head"], r["target"]) for r in done.r_squared().collect()} == named
    cover = done.coverage().collect()
    assert {(r["head"], r["target"], r["level"]) for r in cover} == {(*k, level) for k in named for level in (0.68, 0.9, 0.95)}
    assert all(0 <= r["coverage"] <= 1 and r["n"] > 10 for r in cover)
    wide = {(r["head"], r["subset"]): r for r in done.summary().collect()}
    assert len(wide) == 60 and wide["rate", "Z"]["r2_sfr"] is None and wide["sfr_mstar", "Z"]["r2_mstar"] is not None
    with pytest.raises(DataError, match="absent"):
        ps.evaluate(evaluation_labels(spark), BLOCKS, ScoreParams(heads=(Head("flux", ("flux",)),)))


def test_joint_head_equals_plain_sums(spark):
    """A pair's likelihood under one combination: least squares, residual covariance, and integrals over the missing target."""
    df = evaluation_labels(spark)
    head = Head("pair", ("sfr", "mstar"))
    done = ps.evaluate(df, BLOCKS, ScoreParams(heads=(head,)))
    s, rows = done.standardizer, df.collect()
    value = {r["source_id"]: [None if r[c] is None else (r[c] - s.mean[t]) / s.scale[t] for t, c in (("sfr", "log_sfr"), ("mstar", "logmstar_cigale"))] for r in rows}
    train = [r for r in rows if r["split"] == "train" and None not in value[r["source_id"]]]
    x, y = np.array([[1.0, r["redshift"]] for r in train]), np.array([value[r["source_id"]] for r in train])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    cov = (y - x @ beta).T @ (y - x @ beta) / len(y)
    inverse, level = np.linalg.inv(cov), -math.log(2 * math.pi) - 0.5 * np.linalg.slogdet(cov)[1]
    redshift, grid = {r["source_id"]: r["redshift"] for r in rows}, np.linspace(-5, 5, 12)
    for r in done.predictions.filter("subset = 'Z'").collect():
        i = ["sfr", "mstar"].index(r["target"])
        assert r["mean"] == pytest.approx((np.array([1.0, redshift[r["source_id"]]]) @ beta)[i], abs=1e-9) and r["sigma"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-9)
        assert r["truth"] == (None if value[r["source_id"]][i] is None else pytest.approx(value[r["source_id"]][i]))
    for r in done.scores.filter("subset = 'Z'").collect():
        a, b = value[r["source_id"]]
        if a is None and b is None:
            assert r["ll"] is None
            continue
        points = np.array([[u if a is None else a, w if b is None else b] for u in (grid if a is None else [0]) for w in (grid if b is None else [0])])
        gap = points - np.array([1.0, redshift[r["source_id"]]]) @ beta
        terms = level - 0.5 * np.einsum("ij,jk,ik->i", gap, inverse, gap)
        want = math.log(np.exp(terms).sum()) + (math.log(grid[1] - grid[0]) if len(points) > 1 else 0.0)
        assert r["ll"] == pytest.approx(want, abs=1e-6)


def test_line_baseline_and_fold_scores(spark):
    df = evaluation_labels(spark)
    fluxes = df.select("source_id", F.col("f_s").alias("la"), F.col("f_i").alias("lb"))
    s = sm.fit_standardizer(df, ["sfr"])
    prior = sc.fit_prior(df, Head("sfr", ("sfr",)), s)
    out = ps.line_baseline(df, fluxes, ["la", "lb"], "sfr", s, prior)
    assert out.columns == ["source_id", "prior", "common", "ll", "mean", "truth"] and out.count() == df.filter("split = 'test'").count()
    with pytest.raises(DataError, match="line fluxes"):
        ps.line_baseline(df, fluxes.filter("source_id <> 3"), ["la", "lb"], "sfr", s, prior)
    blocked = df.withColumn("block", (F.col("source_id") % 10).cast("int"))
    scores = ps.fold_scores(blocked, BLOCKS, F.col("source_id") % 5 == 0, ScoreParams(heads=(Head("sfr", ("sfr",)),)))
    counts = {r["fold"]: r["count"] for r in scores.filter("subset = 'Z'").groupBy("fold").count().collect()}
    assert counts == {f: 48 for f in range(5)}


def test_fold_predictions_equal_plain_fits(spark):
    rng = np.random.default_rng(12)
    x, y, n = rng.normal(size=(400, 2)), rng.normal(size=400), 400
    y += x @ [0.5, -1.0]
    rows = [(i, int(rng.integers(10)), float(x[i, 0]), float(x[i, 1]), None if i % 17 == 0 else float(y[i]), i % 7 == 0) for i in range(n)] + [(n, None, 0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "source_id int, block int, fa double, fb double, t double, held boolean").repartition(4)
    got = {(r["source_id"], r["subset"]): r for r in ps.fold_predictions(df, {"Z": ["fa"], "S": ["fb"]}, F.col("held"), ["t"], subsets=["Z", "ZS"]).collect()}
    assert len(got) == 2 * n
    for fold in range(5):
        learned = [r for r in rows[:n] if r[1] // 2 != fold and r[1] != (2 * fold + 2) % 10 and r[4] is not None and not r[5]]
        for subset, width in (("Z", 1), ("ZS", 2)):
            design = np.array([[1.0, *r[2:2 + width]] for r in learned])
            beta = np.linalg.lstsq(design, np.array([r[4] for r in learned]), rcond=None)[0]
            sigma = math.sqrt(np.mean((np.array([r[4] for r in learned]) - design @ beta) ** 2))
            for r in (r for r in rows[:n] if r[1] // 2 == fold):
                out = got[r[0], subset]
                assert out["fold"] == fold and out["mean"] == pytest.approx(np.array([1.0, *r[2:2 + width]]) @ beta, abs=1e-9) and out["sigma"] == pytest.approx(sigma)


def test_specific_rate_gain(spark):
    rows = spark.createDataFrame([(-1.0, -2.0), (-3.0, -3.5), (None, -1.0)], "log_p_joint double, log_p_independent double")
    got = sc.specific_rate_gain(rows).first()
    assert (got["n"], got["mean_joint"], got["gain"]) == (2, -2.0, 0.75) and got["gain_se"] == pytest.approx(0.25)


@pytest.mark.parametrize("d", [1, 2])
def test_many_points_are_interpolated(spark, d, monkeypatch):
    """Far more points than knots, some beside outliers and some far out: few are added up one by one, and all sums are right."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(400, d)), np.full((1, d), 6.0), np.full((1, d), -9.0)])
    points = np.concatenate([rng.uniform(-1, 1, size=(24_000, d)), rng.uniform(-12, 12, size=(60, d))])
    names = list("ab")[:d]
    kde = dn.GaussianKDE.fit(table(spark, x, names), names)
    asked = []
    direct = dn.GaussianKDE._direct
    monkeypatch.setattr(dn.GaussianKDE, "_direct", lambda self, rows: (asked.append(rows.count()), direct(self, rows))[1])
    got = {r["id"]: r["lp"] for r in kde.scored(table(spark, points, names), [F.col(c) for c in names], "lp").collect()}
    assert len(asked) == 2 and sum(asked) < 0.9 * len(points)
    some = [*range(0, 24_000, 40), *range(24_000, 24_060)]
    assert len(got) == len(points) and np.allclose([got[i] for i in some], brute_kde(x, points[some]), atol=2e-6)
