import numpy as np
import pytest

from skyframe.operators import sky


def separation(ra1, dec1, ra2, dec2):
    ra1, dec1, ra2, dec2 = (np.radians(x) for x in (ra1, dec1, ra2, dec2))
    h = np.sin((dec2 - dec1) / 2) ** 2 + np.cos(dec1) * np.cos(dec2) * np.sin((ra2 - ra1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(h))) * 3600


def pairs(spark, a, b, radius, per=4.0):
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, ra double, dec double")
    right = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j int, ra2 double, dec2 double")
    got = sky.radius_pairs(left, right, ("ra", "dec"), ("ra2", "dec2"), radius, per).select("i", "j").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def brute(a, b, radius):
    a, b = np.array(a), np.array(b)
    sep = separation(a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1])
    return set(zip(*(x.tolist() for x in np.nonzero(sep <= radius))))


@pytest.mark.parametrize("radius,per", [(1.0, 4.0), (3600.0, 1.0), (36000.0, 4.0)])
def test_all_sky_equals_brute_force(spark, radius, per):
    rng = np.random.default_rng(3)
    a = np.column_stack([rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))])
    b = np.vstack([a[:200] + rng.normal(0, radius / 3600 / 3, (200, 2)),
                   np.column_stack([rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))])])
    b[:, 0] %= 360
    b[:, 1] = np.clip(b[:, 1], -90, 90)
    assert pairs(spark, a, b, radius, per) == brute(a, b, radius)


def test_wrap_and_poles(spark):
    a = [(359.9999, 10.0), (0.0001, -10.0), (0.0, 89.9999), (200.0, -89.99995), (10.0, 90.0), (50.0, 89.9)]
    b = [(0.0001, 10.0), (359.9999, -10.0), (180.0, 89.9999), (20.0, -89.99995), (300.0, 89.9998), (50.2, 89.9001), (0.0, 0.0)]
    for radius in (0.5, 1.0, 2.0, 10.0):
        assert pairs(spark, a, b, radius) == brute(a, b, radius)


def frame(spark, data):
    return spark.createDataFrame(data, "targetid long, ero_detuid string, xray_ra double, xray_dec double, nway_dist_post double, "
                                       "nway_p_any double, sep_arcsec double")


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for t in range(60):
        n = int(rng.integers(2, 30))
        spread = rng.choice([3.0, 6.0, 7.4, 9.0, 20.0])
        angle = rng.uniform(0, 2 * np.pi, n)
        ra0, dec0 = rng.choice([0.0, 100.0, 359.9999]), rng.choice([-60.0, 0.0, 89.0])
        ra = (ra0 + spread * np.cos(angle) / 3600 / np.cos(np.radians(dec0))) % 360
        dec = dec0 + spread * np.sin(angle) / 3600
        data += [(t, f"d{t}-{i}", float(ra[i]), float(dec[i]), 0.5, 0.5, 0.1) for i in range(n)]
        want[t] = bool(separation(ra[:, None], dec[:, None], ra[None], dec[None]).max() <= 15.0)
    got = {r["targetid"]: r["split_source"] for r in sky.shared_groups(frame(spark, data), 15.0).collect()}
    assert got == want and len(set(want.values())) == 2


def test_resolution_order(spark):
    far = [(1, "a", 10.0, 0.0, 0.4, 0.9, 0.2), (1, "b", 10.1, 0.0, 0.6, 0.1, 0.9), (2, "c", 20.0, 0.0, None, 0.9, 0.2), (2, "d", 20.1, 0.0, 0.1, 0.1, 0.9),
           (3, "e", 30.0, 0.0, 0.5, 0.5, 0.3), (3, "f", 30.1, 0.0, 0.5, 0.5, 0.2), (4, "g", 40.0, 0.0, 0.5, 0.5, 0.3), (5, "h", 50.0, 0.0, 0.5, 0.5, 0.3),
           (5, "i", 50.001, 0.0, 0.9, 0.5, 0.3)]
    out = {r["ero_detuid"]: (r["kept"], r["split_source"]) for r in sky.resolve_shared_targets(frame(spark, far), 15.0).collect()}
    assert out == {"a": (False, False), "b": (True, False), "c": (False, False), "d": (True, False), "e": (False, False), "f": (True, False),
                   "g": (True, False), "h": (True, True), "i": (True, True)}


def test_stacked_copies_cost_one_row_per_position(spark):
    places = spark.createDataFrame([(10.0, 5.0)] * 500, "ls10_ra double, ls10_dec double")
    targets = spark.createDataFrame([(100 + i, 10.0, 5.0 + 0.5 / 3600, i == 7) for i in range(400)] + [(9, 10.0, 5.0, False)],
                                    "targetid long, target_ra double, target_dec double, is_main boolean")
    got = sky.counterparts(places, targets, 1.0).collect()
    assert len(got) == 1
    assert (got[0]["targetid"], got[0]["nearest_targetid"], got[0]["n_candidates"], got[0]["to_main"]) == (107, 9, 401, True)
