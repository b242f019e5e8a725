import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import core, cosmology, labels, poisson, spectra
from skyframe.operators.analysis import hardness_ratio
from skyframe.params import LINE_COMPLEXES


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_release_decode(spark):
    df = rows(spark, [((9010 << 42) | (77 << 22) | 5,), ((9012 << 42) + 1,), (39627,)], "id long")
    assert one(df, core.release_of("id")) == [9010, 9012, 0]
    assert one(df, core.on_main_survey("id")) == [True, True, False]


def test_finite(spark):
    df = rows(spark, [(1.0,), (float("nan"),), (float("inf"),), (-float("inf"),), (None,)], "x double")
    assert one(df, core.is_finite("x")) == [True, False, False, False, False]


def test_log_flux_by_hand(spark):
    data = [(2e-13, 3e-14, 5e-14), (2e-13, 2.4e-13, 1e-14), (-1e-14, 1e-15, 1e-15), (1e-13, 1e-14, 1e-11), (1e-13, float("nan"), 1e-14)]
    df = rows(spark, data, "f double, lo double, hi double")
    got = df.select(*labels.log_flux_columns("f", "lo", "hi", 1.5)).collect()
    assert got[0][0] == pytest.approx(math.log10(2e-13), rel=1e-12)
    assert got[0][1] == pytest.approx(-math.log10(1 - 0.15), rel=1e-12)
    assert got[0][2] == pytest.approx(math.log10(1.25), rel=1e-12)
    assert all(tuple(r) == (None, None, None) for r in got[1:])


def test_luminosity_distance(spark):
    df = rows(spark, [(1.0,), (0.0,), (0.5,)], "z double")
    area = one(df, cosmology.log_sphere_area_cm2("z"))
    distance = math.sqrt(10 ** area[0] / (4 * math.pi)) / 3.0856775814913673e24
    assert distance == pytest.approx(6791.27, abs=0.02)
    assert area[1] is None


def test_repaired_counts(spark):
    df = rows(spark, [(-30000, 1.0, 5.0), (4, -0.5, 5.0), (0, 1.0, 5.0), (3, float("nan"), 5.0)], "n short, b float, t float")
    got = df.select(*[c.alias(k) for k, c in labels.repaired_counts("n", "b", "t").items()]).collect()
    assert [tuple(r) for r in got] == [(None, None, None, False), (4, 0.0, 5.0, True), (0, 1.0, 5.0, False), (3, None, 5.0, False)]


def test_in_window_truth_table(spark):
    lo, hi = 3600.0, 3600.0 + 0.8 * 7780
    zs = [-0.1, 0.0, 0.05, 0.3, 0.48, 0.5, 0.9, 1.04, 1.2, 1.9]
    df = rows(spark, [(z,) for z in zs], "z double")
    for c in LINE_COMPLEXES:
        want = [z > 0 and c.window[0] * (1 + z) >= lo and c.window[1] * (1 + z) <= hi for z in zs]
        assert one(df, spectra.in_window("z", c.window, lo, hi)) == want


def test_hardness(spark):
    df = rows(spark, [(1.0, 1.0), (1.0, 3.0), (3.0, 1.0), (0.0, 0.0)], "a double, b double")
    assert one(df, hardness_ratio(F.col("a"), F.col("b"))) == [0.0, 0.5, -0.5, None]


def test_grid_bins_round_half_to_even(spark):
    from skyframe.params import Grid
    df = rows(spark, [(0.5,), (1.5,), (2.5,), (-0.6,), (9.6,)], "w double")
    assert one(df, spectra.grid_bin("w", Grid(0.0, 1.0, 10))) == [0, 2, 2, None, None]


def test_log_factorial(spark):
    ns = [0, 1, 2, 5, 20, 170, 1999, 100000]
    got = one(rows(spark, [(float(n),) for n in ns], "n double"), poisson.log_factorial(F.col("n")))
    assert np.allclose(got, [math.lgamma(n + 1) for n in ns], rtol=1e-13, atol=1e-11)


def test_proposal_width_below_background(spark):
    df = rows(spark, [(0, 2.0, 800.0), (0, 9.0, 800.0), (1, 3.0, 800.0)], "n int, b double, t double")
    width = one(df, poisson.proposal("n", "b", "t", -2.5, 0.35)[1])
    assert max(width) - min(width) < 1e-12 and 0.92 < width[0] < 0.93


def test_star_formation_flag(spark):
    data = [(40.0, 11.0, 2.0, 0.1, "GALAXY"), (44.0, 10.0, 0.0, 0.1, "GALAXY"), (40.0, 11.0, 2.0, 0.1, "QSO"), (None, 11.0, 2.0, 0.1, "GALAXY"),
            (40.0, None, 2.0, 0.1, "GALAXY")]
    df = rows(spark, data, "lx double, m double, s double, z double, c string")
    assert one(df, labels.star_formation_dominated("lx", "m", "s", "z", "c")) == [True, False, False, False, False]


def test_urls(spark):
    df = rows(spark, [("main ", "dark", 1234, 10.1234567, -5.0)], "s string, p string, h int, ra double, dec double")
    assert one(df, core.group_url("x/{survey}/{program}/{group}/{pix}.fits", "s", "p", "h")) == ["x/main/dark/12/1234.fits"]
    assert one(df, core.cutout_url("c?ra={ra:.6f}&dec={dec:.6f}&s={size}", "ra", "dec", size=160)) == ["c?ra=10.123457&dec=-5.000000&s=160"]


def test_array_median(spark):
    df = rows(spark, [([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],)], "x array<double>")
    assert one(df, spectra.array_median(F.col("x"))) == [2.0, 2.5, None]
