"""Planted catalogue situations through the cross-match, label and manifest jobs."""

import numpy as np
import pytest

from skyframe.operators.joins import DataError, strict_lookup
from skyframe.plans import crossmatch as xm
from skyframe.plans import labels as lb
from skyframe.plans import sample as sp

ARC = 1.0 / 3600
MAIN, OTHER = 9010 << 42, 9008 << 42
DETECTION = ("ero_detuid string, xray_ra double, xray_dec double, ls10_ra double, ls10_dec double, nway_p_any double, nway_p_i double, "
             "nway_threshold6 double, nway_dist_post double, nway_match_flag int, ls10_flux_w1 double, ls10_flux_w2 double, ls10_flux_w3 double, "
             "ls10_flux_ivar_w1 double, ls10_flux_ivar_w2 double, ls10_flux_ivar_w3 double")
TARGET = ("targetid long, target_ra double, target_dec double, survey string, program string, healpix int, spectype string, z double, zwarn int, "
          "zcat_primary boolean")
NAN = float("nan")


def det(name, ra, dec=0.0, xra=None, xdec=None, p_any=0.9, p_i=0.9, thr=0.045, post=0.5, flag=1, w=(1.0, 1.0, -5.0)):
    return (f"{name}  ", ra if xra is None else xra, dec if xdec is None else xdec, ra, dec, p_any, p_i, thr, post, flag, *w, 1.0, 1.0, 1.0)


def tgt(tid, ra, dec=0.0, kind="QSO", z=0.5, zwarn=0, primary=True, survey="main"):
    return (tid, ra, dec, f"{survey}   ", "dark  ", 1234, f"{kind}  ", z, zwarn, primary)


DETECTIONS = [
    det("clean", 10.0), det("clean", 10.0),
    det("tie_two_main", 11.0), det("main_vs_backup", 12.0), det("backup_only", 13.0),
    det("flag2", 14.0, flag=2), det("two_primaries", 15.0, p_i=0.2), det("two_primaries", 15.5, p_i=0.8),
    det("uncal_keep", 16.0, thr=NAN, p_any=0.06), det("uncal_drop", 17.0, thr=NAN, p_any=0.04), det("below", 18.0, p_any=0.03),
    det("coll_a", 19.0, post=0.9), det("coll_b", 19.0, xdec=45 * ARC, post=0.1),
    det("split_a", 20.0), det("split_b", 20.0, xdec=6.3 * ARC), det("sky_fibre", 21.0), det("lone", 22.0), det("star", 23.0),
    det("nan_position", NAN), det("bad_z", 24.0), det("zwarn", 25.0), det("nan_p_i", 26.0, p_i=NAN), det("nan_p_i", 26.5, p_i=0.1),
]
TARGETS = [
    tgt(MAIN + 1, 10.0), tgt(MAIN + 2, 11.0 + 0.6 * ARC), tgt(MAIN + 3, 11.0 - 0.3 * ARC), tgt(MAIN + 4, 12.0 + 0.8 * ARC), tgt(OTHER + 5, 12.0 + 0.2 * ARC, survey="backup"),
    tgt(OTHER + 6, 13.0), tgt(MAIN + 7, 14.0), tgt(MAIN + 8, 15.0), tgt(MAIN + 9, 15.5), tgt(MAIN + 10, 16.0), tgt(MAIN + 11, 17.0), tgt(MAIN + 12, 18.0),
    tgt(MAIN + 13, 19.0), tgt(MAIN + 14, 20.0, kind="GALAXY"), tgt(-1, 21.0), tgt(MAIN + 15, 22.0 + 2 * ARC), tgt(MAIN + 16, 23.0, kind="STAR", z=6.75e-5),
    tgt(MAIN + 17, 24.0, z=-0.0015), tgt(MAIN + 18, 25.0, zwarn=4), tgt(MAIN + 19, 26.0), tgt(MAIN + 20, 26.5), tgt(MAIN + 1, 10.0, primary=False), tgt(MAIN + 30, NAN),
]


@pytest.fixture(scope="module")
def done(spark):
    return xm.crossmatch(spark.createDataFrame(DETECTIONS, DETECTION), spark.createDataFrame(TARGETS, TARGET))


def test_scenarios(done):
    got = {r["ero_detuid"]: r["targetid"] for r in done.matched.collect()}
    assert got == {"clean": MAIN + 1, "tie_two_main": MAIN + 3, "main_vs_backup": MAIN + 4, "backup_only": OTHER + 6, "two_primaries": MAIN + 9,
                   "uncal_keep": MAIN + 10, "coll_a": MAIN + 13, "split_a": MAIN + 14, "split_b": MAIN + 14, "bad_z": MAIN + 17, "zwarn": MAIN + 18,
                   "nan_p_i": MAIN + 20}
    assert {r["ero_detuid"] for r in done.matched.filter("split_source").collect()} == {"split_a", "split_b"}


def test_ledger(done):
    rows = done.ledger.orderBy("ord").collect()
    n = [(r["kept"], r["dropped"]) for r in rows]
    assert n == [(22, 1), (21, 1), (19, 2), (18, 1), (16, 2), (15, 1), (13, 2), (12, 1)]


def test_statistics(done):
    s = done.match_statistics().first()
    assert (s["candidate_pairs"], s["nway_rows_matched"], s["nway_rows_with_2plus_candidates"], s["flipped_by_main_survey_preference"]) == (18, 16, 2, 1)
    cells = {(r["calibrated"], r["keep"]): r["rows"] for r in done.reliability_counts().collect()}
    assert cells == {(True, True): 12, (True, False): 1, (False, True): 1, (False, False): 1}
    g = done.shared_counts().first()
    assert (g["shared_target_groups"], g["split_source_groups"], g["split_source_rows"], g["collision_groups"], g["collision_rows_dropped"]) == (2, 1, 2, 1, 1)


def test_target_counts(spark):
    c = xm.target_counts(xm.clean_numbers(spark.createDataFrame(TARGETS, TARGET))).first()
    assert tuple(c) == (23, 22, 1, 1, 20)


def source_catalogue(spark, names):
    schema = "ero_detuid string, det_like_0 float, det_like_p2 float, det_like_p3 float, " + ", ".join(
        f"ml_flux_{b} float, ml_flux_lowerr_{b} float, ml_flux_uperr_{b} float, ape_cts_{b} short, ape_bkg_{b} float, ape_exp_{b} float" for b in ("1", "p2", "p3"))
    rows = [(n, 20.0, 3.0, 9.0, *([2e-13, 3e-14, 5e-14, -30000 if n == "clean" else 7, 1.0, 100.0] * 3)) for n in names]
    return spark.createDataFrame(rows, schema)


FIT = "targetid long, survey string, program string, chi2 double, logm double, logm_err double, logsfr double, logsfr_err double, flag_masspdf double, flag_sfrpdf double"
FITS = [
    (MAIN + 1, "sv1", "dark", 1.0, 9.0, 0.1, 1.0, 0.1, 1.0, 1.0), (MAIN + 1, "main", "dark", 5.0, 10.0, 0.1, 1.0, 0.1, 1.0, 1.0),
    (MAIN + 3, "main", "dark", 1.0, 0.0, 0.1, 0.0, 0.1, 1.0, 1.0), (MAIN + 4, "main", "dark", 1.0, 10.0, -99.0, 1.0, 0.1, 1.0, 1.0),
    (OTHER + 6, "main", "dark", 1.0, 10.0, 0.1, 1.0, 0.1, 7.0, 1.0), (MAIN + 9, "main", "dark", 1.0, 10.0, 0.1, 1.0, 0.1, 1.0, 0.1),
    (MAIN + 10, "main", "dark", 1.0, 10.0, 3.5, 1.0, 0.1, 1.0, 1.0),
]


def test_labels(spark, done):
    names = [r["ero_detuid"] for r in done.matched.collect()]
    out = lb.derive_labels(done.matched, source_catalogue(spark, names), spark.createDataFrame(FITS, FIT)).labels
    got = {r["ero_detuid"]: r for r in out.collect()}
    assert len(got) == len(names)
    pair = {n: (got[n]["logmstar_cigale"], got[n]["log_sfr"]) for n in got}
    assert pair["clean"] == (10.0, 1.0) and pair["tie_two_main"] == (None, None) and pair["main_vs_backup"] == (None, None)
    assert pair["backup_only"] == (None, 1.0) and pair["two_primaries"] == (10.0, None) and pair["uncal_keep"] == (None, 1.0) and pair["coll_a"] == (None, None)
    assert got["clean"]["ape_cts_1"] is None and got["clean"]["ape_exp_1"] is None and got["zwarn"]["ape_cts_1"] == 7
    z = np.linspace(0, 0.5, 20_001)
    slope = 1 / np.sqrt(0.30966 * (1 + z) ** 3 + 1 - 0.30966)  # radiation moves the result by less than 1e-3
    distance = 1.5 * 299792.458 / 67.66 * ((slope[1:] + slope[:-1]) / 2 * np.diff(z)).sum() * 3.0856775814913673e24
    assert got["bad_z"]["log_lx"] is None
    assert got["clean"]["log_lx"] == pytest.approx(np.log10(2e-13 * 4 * np.pi * distance**2), abs=1e-3)


def test_strict_lookup_errors(spark, done):
    with pytest.raises(DataError, match="absent"):
        lb.derive_labels(done.matched, source_catalogue(spark, ["clean"]), spark.createDataFrame(FITS, FIT))
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(DataError, match="not unique"):
        strict_lookup(spark.createDataFrame([(1,)], "k int"), twice, ["k"], "table")


def test_manifest(spark, done):
    spectra = done.matched.filter("ero_detuid <> 'zwarn'").select("targetid")
    images = done.matched.filter("ero_detuid <> 'coll_a'").select("targetid")
    made = sp.build_manifest(done.matched, spectra, images)
    rows = {r["ero_detuid"]: r for r in made.manifest.collect()}
    out = {n for n, r in rows.items() if not r["in_sample"]}
    assert out == {"split_a", "split_b", "zwarn", "coll_a"}
    assert not rows["bad_z"]["has_z"] and not rows["zwarn"]["has_z"] and rows["clean"]["has_wise"]
    assert all((r["split"] is not None) == r["in_sample"] for r in rows.values())
    assert [(r["kept"], r["dropped"]) for r in made.ledger.orderBy("ord").collect()] == [(10, 2), (9, 1), (8, 1)]
    assert sum(r["rows"] for r in made.split_counts().collect()) == 8


def test_fetch_plan(spark, done):
    plan = sp.fetch_plan(done.matched, done.matched.filter("survey = 'main'").select("survey", "program", "healpix"), "u/{survey}/{group}/{pix}").collect()
    assert {r["survey"] for r in plan} <= {"backup", "main"} and all(r["survey"] != "main" for r in plan)


def test_repeated_targets_and_empty_matches_are_errors(spark):
    detections, targets = spark.createDataFrame(DETECTIONS, DETECTION), spark.createDataFrame(TARGETS, TARGET)
    with pytest.raises(DataError, match="primary targets: targetid is not unique"):
        xm.crossmatch(detections, targets.union(targets.filter(f"targetid = {MAIN + 1}")))
    with pytest.raises(DataError, match="no detection has a target"):
        xm.crossmatch(detections, targets.withColumn("target_dec", targets.target_dec + 5.0))


def test_repeated_keys_cannot_be_split_or_folded(spark):
    from skyframe.operators import sample as sm

    rows = spark.createDataFrame([(1,), (1,), (2,)], "targetid long")
    for job in (sm.assign_split, sm.assign_blocks):
        with pytest.raises(DataError, match="not unique"):
            job(rows)


def test_one_band_is_the_one_of_all_bands(spark, tmp_path):
    """The band of one modality takes the job's own number of replicates, in code and SQL."""
    import datetime

    from skyframe.registry import QUERIES, SQL

    day = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(k, k, "O", 1000.0 + k * 7919 % 4001, day, "1") for k in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 5, k % 4, 1, 1.0 + k % 50, 900.0 + 13 * k, k % 10 / 100, k % 8 / 100) for k in range(60)], "l_orderkey long, l_partkey long, l_suppkey long, "
                          "l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"s{k}", k, 100.0 * k) for k in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    one, every = (QUERIES[n](spark, str(tmp_path)) for n in ("job_analyse_band", "job_analyse_bands"))
    found, want = (sorted(map(tuple, df.collect())) for df in (one, every.filter("modality = 'S'").select(*one.columns)))
    assert len(found) == 45 and found == want
    assert "range(0, 1000)" in SQL["job_analyse_band"] and "range(0, 20)" not in SQL["job_analyse_band"]
