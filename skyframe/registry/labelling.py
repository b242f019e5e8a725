"""Labels: lookups, fluxes, luminosities, counts, host fits, star-formation flags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyframe.functions import labels as fl
from skyframe.functions.core import utc_seconds, is_finite, finite_or_null
from skyframe.functions.cosmology import density_terms, log_sphere_area_cm2
from skyframe.operators import joins
from skyframe.params import LIGHT_KMS, PLANCK18_H0
from skyframe.plans import labels as lb
from skyframe.registry.base import query
from skyframe.registry.catalog import STEPS, run
from skyframe.session import settle


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def sql_log_flux(b: str, table: str = "") -> str:
    f, lo, hi = (f"{table}ml_flux_{b}", f"{table}ml_flux_lowerr_{b}", f"{table}ml_flux_uperr_{b}")
    ok = f"({f} > 0 AND {lo} < {f} AND -log10(greatest(1 - {lo} / {f}, 1e-12)) <= 1.5 AND log10(1 + {hi} / {f}) <= 1.5)"
    return (f"CASE WHEN {f} > 0 THEN CASE WHEN {ok} THEN log10({f}) END END AS log_flux_{b}, "
            f"CASE WHEN {f} > 0 THEN CASE WHEN {ok} THEN -log10(greatest(1 - {lo} / {f}, 1e-12)) END END AS log_flux_{b}_sig_lo, "
            f"CASE WHEN {f} > 0 THEN CASE WHEN {ok} THEN log10(1 + {hi} / {f}) END END AS log_flux_{b}_sig_hi")


def sql_counts(b: str) -> str:
    return (f"CASE WHEN ape_cts_{b} >= 0 THEN ape_cts_{b} END AS ape_cts_{b}, "
            f"CASE WHEN ape_cts_{b} >= 0 THEN greatest(ape_bkg_{b}, 0) END AS ape_bkg_{b}, "
            f"CASE WHEN ape_cts_{b} >= 0 THEN ape_exp_{b} END AS ape_exp_{b}, "
            f"ape_cts_{b} >= 0 AND ape_bkg_{b} < 0 AS ape_bkg_negative_{b}")


def sql_area(z: str) -> str:
    """log10(4 pi D_L^2) by a 48-point Gauss-Legendre sum of the inverse Hubble rate."""
    t, w = np.polynomial.legendre.leggauss(48)
    d = density_terms()
    nodes = "[" + ", ".join(f"{(1 + a) / 2:.17e}" for a in t) + "]"
    weights = "[" + ", ".join(f"{b / 2:.17e}" for b in w) + "]"
    a = f"(1 + {z} * p.a)"
    massive = f"pow(1 + pow({0.3173 * d['mass_ratio']!r} / {a}, 1.83e0), {1 / 1.83!r})"
    inverse = (f"1 / sqrt(0.30966e0 * pow({a}, 3) + {d['photons']!r} * pow({a}, 4) * (1 + {0.22710731766 * 3.046 / 3!r}"
               f" * (2 + {massive})) + {d['dark']!r})")
    body = inverse.replace("p.a", "q[1]")
    distance = (f"((1 + {z}) * {z} * {LIGHT_KMS / PLANCK18_H0!r} * list_sum(list_transform(list_zip({nodes}, {weights}), "
                f"lambda q: q[2] * {body})) * 3.0856775814913673e24)")
    return f"log10(4 * pi() * {distance} * {distance})"



HOST = """
obs AS (SELECT targetid, trim(survey) AS s, trim(program) AS p FROM v_targets),
joined AS (SELECT f.*, coalesce(f.survey = o.s AND f.program = o.p, FALSE) AS same FROM v_host_fits f JOIN obs o USING (targetid)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY targetid ORDER BY same DESC, survey = 'main' DESC, chi2,
    flag_masspdf, flag_sfrpdf, logm, logm_err, logsfr, logsfr_err, program, survey) AS rn FROM joined) WHERE rn = 1),
gated AS (SELECT *, logm = 0 AND logsfr = 0 AS failed_fit,
    least(logm, logm_err, logsfr, logsfr_err, flag_masspdf, flag_sfrpdf) <= -90 AS sentinel,
    NOT (flag_masspdf > 0.2e0 AND flag_masspdf < 5.0e0) AS broad_mass_pdf,
    NOT (flag_sfrpdf > 0.2e0 AND flag_sfrpdf < 5.0e0) AS broad_sfr_pdf,
    abs(logm_err) AS em, abs(logsfr_err) AS es FROM chosen),
flagged AS (SELECT *, failed_fit OR sentinel OR broad_mass_pdf OR em <= 0 AS unusable_mass,
    failed_fit OR sentinel OR broad_sfr_pdf OR es <= 0 AS unusable_sfr FROM gated),
host AS (SELECT *, NOT unusable_mass AND em > 3 AS wide_mass, NOT unusable_sfr AND es > 3 AS wide_sfr,
    CASE WHEN NOT unusable_mass AND em <= 3 THEN logm END AS logmstar_cigale,
    CASE WHEN NOT unusable_sfr AND es <= 3 THEN logsfr END AS log_sfr FROM flagged)
"""


def seen(v):
    from skyframe.plans.crossmatch import clean_numbers
    return clean_numbers(v.targets).select("targetid", "survey", "program")


@query("join_strict_lookup", f"""
WITH {STEPS} SELECT r.ero_detuid, r.targetid, m.ml_flux_1 FROM resolved r JOIN v_main m USING (ero_detuid) WHERE kept""")
def join_strict_lookup(v):
    out = joins.strict_lookup(settle(run(v).matched.select("ero_detuid", "targetid")), v.main, ["ero_detuid"], "source catalogue")
    return out.select("ero_detuid", "targetid", "ml_flux_1")


@query("join_semi_prefilter", "SELECT targetid, chi2, logm FROM v_host_fits WHERE targetid IN (SELECT targetid FROM v_targets WHERE zcat_primary)")
def join_semi_prefilter(v):
    return v.host_fits.select("targetid", "chi2", "logm").join(v.targets.filter("zcat_primary").select("targetid"), "targetid", "left_semi")


@query("join_left_enrichment", """
SELECT f.targetid, f.chi2, trim(t.survey) AS obs_survey, trim(t.program) AS obs_program
FROM v_host_fits f LEFT JOIN (SELECT * FROM v_targets WHERE zcat_primary) t USING (targetid)""")
def join_left_enrichment(v):
    obs = v.targets.filter("zcat_primary").select("targetid", F.trim("survey").alias("obs_survey"), F.trim("program").alias("obs_program"))
    return v.host_fits.select("targetid", "chi2").join(obs, "targetid", "left")


@query("join_left_align", f"WITH {HOST} SELECT t.targetid, h.log_sfr FROM v_targets t LEFT JOIN host h USING (targetid)")
def join_left_align(v):
    host = lb.host_labels(v.host_fits, seen(v)).select("targetid", "log_sfr")
    return v.targets.select("targetid").join(host, "targetid", "left")


@query("join_keyed_concat", f"""
WITH x AS (SELECT ero_detuid, {sql_log_flux("1")} FROM v_main)
SELECT s.targetid, s.ero_detuid, s.spectype, round(x.log_flux_1, 6) AS log_flux_1 FROM v_sample s JOIN x USING (ero_detuid)""")
def join_keyed_concat(v):
    x = lb.xray_labels(v.main).select("ero_detuid", *r("log_flux_1"))
    return v.sample.select("targetid", "ero_detuid", "spectype").join(x, "ero_detuid")


@query("agg_best_fit", f"WITH {HOST} SELECT targetid, survey, program, chi2, logm, logsfr FROM chosen")
def agg_best_fit(v):
    return joins.best_host_fit(v.host_fits, seen(v)).select("targetid", "survey", "program", "chi2", "logm", "logsfr")


@query("agg_host_statistics", f"""
WITH {HOST} SELECT (SELECT count(*) FROM joined) AS vac_rows_for_our_targets, count(*) AS targets_in_vac,
  (SELECT count(*) FROM joined) - count(*) AS duplicate_fits_resolved,
  count_if(failed_fit) AS failed_fit, count_if(sentinel) AS sentinel, count_if(broad_mass_pdf) AS broad_mass_pdf,
  count_if(broad_sfr_pdf) AS broad_sfr_pdf, count(logmstar_cigale) AS mass_usable, count_if(unusable_mass) AS mass_unusable,
  count_if(wide_mass) AS mass_removed_by_max_sigma, count(log_sfr) AS sfr_usable, count_if(unusable_sfr) AS sfr_unusable,
  count_if(wide_sfr) AS sfr_removed_by_max_sigma FROM host""")
def agg_host_statistics(v):
    return lb.host_statistics(v.host_fits, seen(v))


def _band_sql(b: str) -> str:
    like = "det_like_0" if b == "1" else f"det_like_{b}"
    return f"""SELECT '{b}' AS band, count(log_flux_{b}) AS flux_measured, count(*) - count(log_flux_{b}) AS flux_not_a_measurement,
  count_if({like} > 6) AS det_like_above, count_if(ape_cts_{b} < 0) AS ape_cts_wrapped,
  count_if(ape_cts_{b} >= 0 AND ape_bkg_{b} < 0) AS ape_bkg_negative_clipped, count_if(ape_cts_{b} = 0) AS ape_cts_zero,
  count_if(ape_cts_{b} >= 0) AS ape_triple_complete FROM x"""


@query("agg_band_quality", f"""
WITH x AS (SELECT *, {sql_log_flux("1")}, {sql_log_flux("p2")}, {sql_log_flux("p3")} FROM v_main)
{" UNION ALL ".join(_band_sql(b) for b in ("1", "p2", "p3"))}""")
def agg_band_quality(v):
    return lb.band_quality(v.main)


@query("agg_label_coverage", """
SELECT 'log_flux_1' AS label, count(log_flux_1) AS finite FROM v_labels UNION ALL SELECT 'log_lx', count(log_lx) FROM v_labels
UNION ALL SELECT 'log_sfr', count(log_sfr) FROM v_labels UNION ALL SELECT 'logmstar_cigale', count(logmstar_cigale) FROM v_labels""")
def agg_label_coverage(v):
    return lb.label_coverage(v.labels, ("log_flux_1", "log_lx", "log_sfr", "logmstar_cigale"))


@query("fn_log_flux_asym", f"""
WITH x AS (SELECT ero_detuid, {sql_log_flux("1")} FROM v_main)
SELECT ero_detuid, round(log_flux_1, 6) AS log_flux_1, round(log_flux_1_sig_lo, 6) AS log_flux_1_sig_lo,
  round(log_flux_1_sig_hi, 6) AS log_flux_1_sig_hi FROM x""")
def fn_log_flux_asym(v):
    return lb.xray_labels(v.main).select("ero_detuid", *r("log_flux_1", "log_flux_1_sig_lo", "log_flux_1_sig_hi"))


@query("fn_log_luminosity", f"""
SELECT targetid, round(CASE WHEN z >= 0.001e0 THEN -13.0e0 + {sql_area("greatest(z, 0.001e0)")} END, 5) AS log_lx FROM v_targets""")
def fn_log_luminosity(v):
    lx = fl.log_luminosity(F.lit(-13.0), "z", log_sphere_area_cm2("z"), 0.001)
    return v.targets.select("targetid", F.round(lx, 5).alias("log_lx"))


@query("fn_repaired_counts", f"SELECT ero_detuid, {sql_counts('1')}, {sql_counts('p2')}, {sql_counts('p3')} FROM v_main")
def fn_repaired_counts(v):
    names = [f"ape_{q}_{b}" for b in ("1", "p2", "p3") for q in ("cts", "bkg", "exp", "bkg_negative")]
    return lb.xray_labels(v.main).select("ero_detuid", *names)


@query("fn_host_gates", f"""
WITH {HOST} SELECT targetid, failed_fit, sentinel, broad_mass_pdf, broad_sfr_pdf, unusable_mass, wide_mass, unusable_sfr, wide_sfr,
  logmstar_cigale, log_sfr FROM host""")
def fn_host_gates(v):
    return lb.host_labels(v.host_fits, seen(v)).select(
        "targetid", "failed_fit", "sentinel", "broad_mass_pdf", "broad_sfr_pdf", "unusable_mass", "wide_mass", "unusable_sfr",
        "wide_sfr", "logmstar_cigale", "log_sfr")


@query("fn_plug_in_rate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log10(greatest(counts - bkg, 0.5) / expo), 6) AS log_rate FROM v_counts""")
def fn_plug_in_rate(v):
    return v.counts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           F.round(fl.log_plug_in_rate("counts", "bkg", "expo"), 6).alias("log_rate"))


@query("fn_finite", """
SELECT targetid, TRUE AS targetid_ok, target_ra IS NOT NULL AS ra_ok FROM v_targets""")
def fn_finite(v):
    return v.targets.select("targetid", is_finite("targetid").alias("targetid_ok"), is_finite(finite_or_null("target_ra")).alias("ra_ok"))


@query("fn_not_finite", """
SELECT c_custkey, c_custkey % 7 > 3 AS finite, CASE WHEN c_custkey % 7 > 3 THEN round(c_acctbal, 2) END AS kept FROM customer""")
def fn_not_finite(v):
    """NaN, both infinities and NULL planted in a column."""
    k = F.col("c_custkey") % 7
    planted = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k > 3, F.col("c_acctbal"))
    rows = v.table("customer").select("c_custkey", planted.alias("x"))
    return rows.select("c_custkey", is_finite("x").alias("finite"), F.round(finite_or_null("x"), 2).alias("kept"))


@query("fn_specific_rate", "SELECT source_id, round(log_sfr - logmstar_cigale, 6) AS log_ssfr FROM v_labels")
def fn_specific_rate(v):
    return v.labels.select("source_id", F.round(F.col("log_sfr") - F.col("logmstar_cigale"), 6).alias("log_ssfr"))


LEHMER_SQL = """
log10(ln(2.3e0 / 0.2e0) / ln(2.0e0 / 0.5e0) * (pow(10.0e0, 29.04e0 + m) * pow(1 + z, 3.78e0) + pow(10.0e0, 39.38e0 + s) * pow(1 + z, 0.99e0))) AS soft,
log10(ln(2.3e0 / 0.2e0) / ln(10.0e0 / 2.0e0) * (pow(10.0e0, 29.37e0 + m) * pow(1 + z, 2.03e0) + pow(10.0e0, 39.28e0 + s) * pow(1 + z, 1.31e0))) AS hard,
log10(ln(2.3e0 / 0.2e0) / ln(8.0e0 / 0.5e0) * 4.0e39 * pow(10.0e0, s) / 0.63e0) AS mineo"""


@query("fn_band_factor", """
SELECT n_nationkey, round(ln(2.3e0 / 0.2e0) / ln((2.0e0 + n_nationkey) / 0.5e0), 9) AS factor FROM nation""")
def fn_band_factor(v):
    return v.table("nation").select("n_nationkey", F.round(fl.band_factor_of(F.lit(0.5), F.col("n_nationkey") + 2.0), 9).alias("factor"))


@query("fn_predicted_luminosity", f"""
WITH x AS (SELECT source_id, logmstar_cigale AS m, log_sfr AS s, redshift AS z FROM v_labels), y AS (SELECT source_id, {LEHMER_SQL} FROM x)
SELECT source_id, round(soft, 6) AS soft, round(hard, 6) AS hard, round(mineo, 6) AS mineo FROM y""")
def fn_predicted_luminosity(v):
    m, s, z = F.col("logmstar_cigale"), F.col("log_sfr"), F.col("redshift")
    return v.labels.select("source_id", F.round(fl.lehmer_log_lx((0.5, 2.0), m, s, z), 6).alias("soft"),
                           F.round(fl.lehmer_log_lx((2.0, 10.0), m, s, z), 6).alias("hard"),
                           F.round(fl.mineo_log_lx(s), 6).alias("mineo"))


@query("flt_star_formation_flag", f"""
WITH x AS (SELECT source_id, spectype, log_lx - 3 AS lx, logmstar_cigale AS m, log_sfr AS s, redshift AS z FROM v_labels),
y AS (SELECT source_id, spectype, lx, m, s, {LEHMER_SQL} FROM x)
SELECT source_id, coalesce(spectype = 'GALAXY' AND lx IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL
  AND lx <= greatest(soft, hard, mineo) + 1, FALSE) AS sf_dominated FROM y""")
def flt_star_formation_flag(v):
    flag = fl.star_formation_dominated(F.col("log_lx") - 3, "logmstar_cigale", "log_sfr", "redshift", "spectype")
    return v.labels.select("source_id", flag.alias("sf_dominated"))


@query("flt_label_masks", """
SELECT source_id, log_flux_1 IS NOT NULL AS flux_ok, log_lx IS NOT NULL AS lx_ok, log_sfr IS NOT NULL AS sfr_ok,
  logmstar_cigale IS NOT NULL AS mstar_ok, ape_cts_p2 IS NOT NULL AND ape_exp_p2 > 0 AS rate_p2_ok,
  ape_cts_p3 IS NOT NULL AND ape_exp_p3 > 0 AS rate_p3_ok FROM v_labels""")
def flt_label_masks(v):
    from skyframe.operators.sample import with_masks
    return with_masks(v.labels).select("source_id", "flux_ok", "lx_ok", "sfr_ok", "mstar_ok", "rate_p2_ok", "rate_p3_ok")


@query("set_distinct_by_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def set_distinct_by_key(v):
    return joins.best_per_key(v.table("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("srt_first_misses", f"""
SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0))
ORDER BY o_custkey LIMIT 5""")
def srt_first_misses(v):
    known = v.table("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.missing_keys(v.table("orders"), known, ["o_custkey"]).orderBy("o_custkey").limit(5)


@query("dq_repeated_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def dq_repeated_keys(v):
    return joins.repeated_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("fn_utc_timestamp", "SELECT n_nationkey, TRUE AS well_formed FROM nation")
def fn_utc_timestamp(v):
    return v.table("nation").select("n_nationkey", utc_seconds().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("well_formed"))


@query("fn_utc_of_time", "SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '+00:00') AS stamp FROM events")
def fn_utc_of_time(v):
    return v.table("events").select("event_id", utc_seconds(F.col("ts").cast("timestamp")).alias("stamp"))


@query("job_derive_labels", f"""
WITH {STEPS}, {HOST.replace("obs AS (SELECT targetid, trim(survey) AS s, trim(program) AS p FROM v_targets)",
                            "obs AS (SELECT DISTINCT targetid, survey AS s, program AS p FROM resolved WHERE kept)")},
x AS (SELECT ero_detuid, det_like_0, det_like_p2, {sql_log_flux("1")}, {sql_log_flux("p2")}, {sql_counts("1")} FROM v_main)
SELECT r.ero_detuid, r.targetid, det_like_0, det_like_p2, round(log_flux_1, 6) AS log_flux_1, round(log_flux_p2_sig_hi, 6) AS log_flux_p2_sig_hi,
  ape_cts_1, ape_bkg_1, ape_exp_1, round(CASE WHEN z >= 0.001e0 THEN log_flux_1 + {sql_area("greatest(r.z, 0.001e0)")} END, 5) AS log_lx,
  h.log_sfr, h.logmstar_cigale
FROM (SELECT * FROM resolved WHERE kept) r JOIN x USING (ero_detuid) LEFT JOIN host h USING (targetid)""")
def job_derive_labels(v):
    out = lb.derive_labels(settle(run(v).matched), v.main, v.host_fits).labels  # jobs hand over written tables
    return out.select("ero_detuid", "targetid", "det_like_0", "det_like_p2", *r("log_flux_1", "log_flux_p2_sig_hi"),
                      "ape_cts_1", "ape_bkg_1", "ape_exp_1", *r("log_lx", digits=5), "log_sfr", "logmstar_cigale")
