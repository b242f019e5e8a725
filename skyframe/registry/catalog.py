"""Scans, filters and the sky cross-match."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions.core import group_url, cutout_url, on_main_survey, release_of, separation_arcsec, trimmed
from skyframe.operators import sky
from skyframe.params import DETECTION_RENAMES, TARGET_RENAMES, CrossmatchParams
from skyframe.plans import crossmatch as xm
from skyframe.registry.base import query
from skyframe.session import stage_path
from skyframe.sources.catalog import scan_catalogue


# ---- the same steps in SQL

HAVERSINE = """degrees(2 * asin(least(1.0e0, sqrt(
    sin(radians({d2} - {d1}) / 2) * sin(radians({d2} - {d1}) / 2) + cos(radians({d1})) * cos(radians({d2}))
    * sin(radians({r2} - {r1}) / 2) * sin(radians({r2} - {r1}) / 2))))) * 3600.0e0"""
SEP = HAVERSINE.format(r1="d.ls10_ra", d1="d.ls10_dec", r2="t.target_ra", d2="t.target_dec")

STEPS = f"""
dets AS (SELECT DISTINCT * FROM v_detections),
prim AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ero_detuid ORDER BY nway_p_i DESC NULLS LAST, nway_dist_post DESC NULLS LAST,
      ls10_ra NULLS LAST, ls10_dec NULLS LAST, xray_ra, xray_dec) AS rn
    FROM dets WHERE nway_match_flag = 1) WHERE rn = 1),
pool AS (
  SELECT targetid, target_ra, target_dec, trim(survey) AS survey, trim(program) AS program, healpix,
    trim(spectype) AS spectype, z, zwarn, ((targetid >> 42) & 65535) IN (9010, 9011, 9012) AS is_main
  FROM v_targets WHERE zcat_primary AND targetid > 0 AND target_ra IS NOT NULL AND target_dec IS NOT NULL),
pairs AS (
  SELECT d.ero_detuid, t.targetid, t.is_main, {SEP} AS sep
  FROM prim d JOIN pool t ON t.target_dec BETWEEN d.ls10_dec - 0.0003e0 AND d.ls10_dec + 0.0003e0
  WHERE {SEP} <= 1.0e0),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY ero_detuid) AS n_candidates,
    row_number() OVER (PARTITION BY ero_detuid ORDER BY is_main DESC, sep, targetid) AS pref,
    row_number() OVER (PARTITION BY ero_detuid ORDER BY sep, targetid) AS near
  FROM pairs),
best AS (
  SELECT a.ero_detuid, a.targetid, a.sep, a.n_candidates, a.is_main AS to_main, b.targetid AS nearest_targetid
  FROM ranked a JOIN ranked b ON a.ero_detuid = b.ero_detuid AND a.pref = 1 AND b.near = 1),
staged AS (
  SELECT p.*, b.targetid, b.sep AS sep_arcsec, b.n_candidates, b.to_main, b.nearest_targetid,
    t.target_ra, t.target_dec, t.survey, t.program, t.healpix, t.spectype, t.z, t.zwarn,
    b.targetid IS NOT NULL AS matched, coalesce(t.spectype <> 'STAR', TRUE) AS not_excluded,
    CASE WHEN nway_threshold6 IS NOT NULL THEN nway_p_any > nway_threshold6 ELSE nway_p_any >= 0.05e0 END AS reliable
  FROM prim p LEFT JOIN best b USING (ero_detuid) LEFT JOIN pool t ON t.targetid = b.targetid),
passing AS (SELECT * FROM staged WHERE matched AND not_excluded AND reliable),
groups AS (
  SELECT a.targetid, count(DISTINCT a.ero_detuid) AS members,
    max({HAVERSINE.format(r1="a.xray_ra", d1="a.xray_dec", r2="b.xray_ra", d2="b.xray_dec")}) AS widest
  FROM passing a JOIN passing b ON a.targetid = b.targetid GROUP BY a.targetid HAVING count(DISTINCT a.ero_detuid) > 1),
resolved AS (
  SELECT s.*, coalesce(g.members, 1) AS members, coalesce(g.widest <= 15.0e0, FALSE) AS split_source,
    g.members IS NULL OR g.widest <= 15.0e0 OR row_number() OVER (PARTITION BY s.targetid
      ORDER BY nway_dist_post DESC NULLS LAST, nway_p_any DESC NULLS LAST, sep_arcsec, ero_detuid) = 1 AS kept
  FROM passing s LEFT JOIN groups g USING (targetid))
"""

MATCHED = """targetid, ero_detuid, round(xray_ra, 9) AS xray_ra, round(xray_dec, 9) AS xray_dec, round(ls10_ra, 9) AS ls10_ra,
  round(ls10_dec, 9) AS ls10_dec, nway_p_any, nway_p_i, nway_threshold6, nway_dist_post, ls10_flux_w1, ls10_flux_w2, ls10_flux_w3,
  ls10_flux_ivar_w1, ls10_flux_ivar_w2, ls10_flux_ivar_w3, round(target_ra, 9) AS target_ra, round(target_dec, 9) AS target_dec,
  survey, program, healpix, spectype, z, zwarn, round(sep_arcsec, 5) AS sep_arcsec, split_source"""


def run(v):
    return xm.crossmatch(v.detections, v.targets)


def pool(v):
    return xm.primary_targets(xm.clean_numbers(v.targets), CrossmatchParams().main_releases)


def primaries(v):
    return xm.primary_detections(xm.clean_numbers(v.detections)).drop("nway_match_flag")


@query("job_crossmatch", f"WITH {STEPS} SELECT {MATCHED} FROM resolved WHERE kept")
def job_crossmatch(v):
    return run(v).matched.selectExpr(*[c.strip() for c in _split(MATCHED)])


def _split(columns: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


@query("src_catalogue_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def src_catalogue_scan(v):
    return scan_catalogue(v.spark, f"{v.folder}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"],
                          F.col("o_totalprice") > 400000)


@query("src_two_phase_scan", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""")
def src_two_phase_scan(v):
    keys = v.table("orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(
        F.col("o_orderkey").alias("l_orderkey"))
    wide = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return wide.join(keys, "l_orderkey", "left_semi")


@query("prj_rename_on_read", "SELECT c_custkey AS detection, c_acctbal AS score FROM customer")
def prj_rename_on_read(v):
    return v.table("customer").select("c_custkey", "c_acctbal").withColumnsRenamed(
        {"c_custkey": "detection", "c_acctbal": "score"})


@query("src_renamed_targets", """
SELECT targetid, round(target_ra, 9) AS target_ra, round(target_dec, 9) AS target_dec, survey, program, healpix, spectype, z, zwarn FROM v_targets WHERE zcat_primary AND z > 1""")
def src_renamed_targets(v):
    """The observed catalogue under its published names, read by the names of the library."""
    out = published(v, v.targets, TARGET_RENAMES, F.col("zcat_primary") & (F.col("z") > 1)).drop("zcat_primary")
    return out.withColumns({c: F.round(c, 9) for c in ("target_ra", "target_dec")})


@query("src_renamed_detections", """
SELECT ero_detuid, nway_p_any, nway_p_i, nway_match_flag, nway_threshold6, nway_dist_post, ls10_flux_w1, ls10_flux_ivar_w3, round(xray_dec, 9) AS xray_dec
FROM v_detections WHERE nway_match_flag = 1 AND nway_p_any > 0.3e0""")
def src_renamed_detections(v):
    out = published(v, v.detections, DETECTION_RENAMES, (F.col("nway_match_flag") == 1) & (F.col("nway_p_any") > 0.3))
    return out.select("ero_detuid", "nway_p_any", "nway_p_i", "nway_match_flag", "nway_threshold6", "nway_dist_post", "ls10_flux_w1", "ls10_flux_ivar_w3",
                      F.round("xray_dec", 9).alias("xray_dec"))


def published(v, rows, renames, where):
    """Write rows under the published names of their columns and scan them by their own."""
    path = stage_path(v.spark, "published")
    rows.select(*[F.col(own).alias(name) for name, own in renames.items()]).write.parquet(path)
    return scan_catalogue(v.spark, path, list(renames.values()), where, renames)


@query("prj_fixed_output", f"WITH {STEPS} SELECT ero_detuid, targetid, survey, program, split_source FROM resolved WHERE kept")
def prj_fixed_output(v):
    return run(v).matched.select("ero_detuid", "targetid", "survey", "program", "split_source")


@query("prj_trim_padding", "SELECT targetid, trim(survey) AS survey, trim(program) AS program, trim(spectype) AS spectype FROM v_targets")
def prj_trim_padding(v):
    return v.targets.select("targetid", *[trimmed(c).alias(c) for c in ("survey", "program", "spectype")])


@query("prj_release_decode", "SELECT targetid, (targetid >> 42) & 65535 AS release FROM v_targets")
def prj_release_decode(v):
    return v.targets.select("targetid", release_of("targetid").alias("release"))


@query("prj_main_flag", """
SELECT ((targetid >> 42) & 65535) IN (9010, 9011, 9012) AS is_main, count(*) AS n FROM v_targets GROUP BY 1""")
def prj_main_flag(v):
    return v.targets.groupBy(on_main_survey("targetid").alias("is_main")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_url_columns", """
SELECT targetid, concat('https://host/', trim(survey), '/', trim(program), '/', CAST(healpix // 100 AS VARCHAR), '/', CAST(healpix AS VARCHAR), '.fits') AS coadd_url,
  concat('https://host/cut?ra=', printf('%.6f', target_ra), '&dec=', printf('%.6f', target_dec), '&size=160') AS cutout_url
FROM v_targets WHERE target_ra IS NOT NULL""")
def prj_url_columns(v):
    return v.targets.filter("target_ra IS NOT NULL").select(
        "targetid",
        group_url("https://host/{survey}/{program}/{group}/{pix}.fits", "survey", "program", "healpix").alias("coadd_url"),
        cutout_url("https://host/cut?ra={ra:.6f}&dec={dec:.6f}&size={size}", "target_ra", "target_dec", size=160).alias("cutout_url"))


@query("prj_narrow_types", "SELECT c_custkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS narrowed FROM customer")
def prj_narrow_types(v):
    return v.table("customer").select("c_custkey", F.col("c_acctbal").cast("float").cast("double").alias("narrowed"))


@query("flt_primary_match", "SELECT ero_detuid, nway_p_i FROM v_detections WHERE nway_match_flag = 1")
def flt_primary_match(v):
    return v.detections.filter(F.col("nway_match_flag") == 1).select("ero_detuid", "nway_p_i")


@query("flt_finite_position", "SELECT ero_detuid, nway_match_flag FROM v_detections WHERE ls10_ra IS NOT NULL AND ls10_dec IS NOT NULL")
def flt_finite_position(v):
    from skyframe.functions.core import is_finite
    return v.detections.filter(is_finite("ls10_ra") & is_finite("ls10_dec")).select("ero_detuid", "nway_match_flag")


@query("flt_primary_targets", """
SELECT count(*) AS desi_rows_raw, count_if(zcat_primary) AS desi_primary_rows,
  count_if(zcat_primary AND NOT targetid > 0) AS desi_primary_targetid_le0,
  count_if(zcat_primary AND targetid > 0 AND (target_ra IS NULL OR target_dec IS NULL)) AS desi_primary_bad_position,
  count_if(zcat_primary AND targetid > 0 AND target_ra IS NOT NULL AND target_dec IS NOT NULL) AS desi_rows_kept
FROM v_targets""")
def flt_primary_targets(v):
    return xm.target_counts(xm.clean_numbers(v.targets))


@query("flt_excluded_class", "SELECT targetid, trim(spectype) AS spectype FROM v_targets WHERE trim(spectype) <> 'STAR'")
def flt_excluded_class(v):
    return xm.clean_numbers(v.targets).filter(xm.not_excluded()).select("targetid", "spectype")


@query("flt_reliability_cut", f"""
WITH {STEPS} SELECT nway_threshold6 IS NOT NULL AS calibrated, reliable AS keep, count(*) AS rows
FROM staged WHERE matched AND not_excluded GROUP BY 1, 2""")
def flt_reliability_cut(v):
    return run(v).reliability_counts()


@query("flt_cut_ledger", f"""
WITH {STEPS},
n AS (SELECT (SELECT count(*) FROM v_detections) AS n0, (SELECT count(*) FROM dets) AS n1,
  (SELECT count(*) FROM dets WHERE nway_match_flag = 1) AS n2, (SELECT count(*) FROM prim) AS n3,
  (SELECT count(*) FROM prim WHERE ls10_ra IS NOT NULL AND ls10_dec IS NOT NULL) AS n4,
  (SELECT count(*) FROM staged WHERE matched) AS n5, (SELECT count(*) FROM staged WHERE matched AND not_excluded) AS n6,
  (SELECT count(*) FROM passing) AS n7, (SELECT count(*) FROM resolved WHERE kept) AS n8)
SELECT 1 AS ord, 'nway_exact_duplicates_collapsed' AS filter, n1 AS kept, n0 - n1 AS dropped, CAST(NULL AS VARCHAR) AS note FROM n UNION ALL
SELECT 2, 'nway_match_flag==1', n2, n1 - n2, NULL FROM n UNION ALL
SELECT 3, 'nway_one_primary_per_detuid', n3, n2 - n3, NULL FROM n UNION ALL
SELECT 4, 'nway_finite_ls10_position', n4, n3 - n4, NULL FROM n UNION ALL
SELECT 5, 'nway_matched_within_radius', n5, n4 - n5, NULL FROM n UNION ALL
SELECT 6, 'spectype_not_stellar', n6, n5 - n6, NULL FROM n UNION ALL
SELECT 7, 'nway_p_any_reliability', n7, n6 - n7, NULL FROM n UNION ALL
SELECT 8, 'collision_losers_dropped', n8, n7 - n8, NULL FROM n""")
def flt_cut_ledger(v):
    return run(v).ledger


@query("join_sky_radius", f"WITH {STEPS} SELECT ero_detuid, targetid, round(sep, 5) AS sep_arcsec FROM pairs")
def join_sky_radius(v):
    left = primaries(v).select("ero_detuid", "ls10_ra", "ls10_dec")
    right = pool(v).select("targetid", "target_ra", "target_dec")
    pairs = sky.radius_pairs(left, right, ("ls10_ra", "ls10_dec"), ("target_ra", "target_dec"), 1.0)
    return pairs.select("ero_detuid", "targetid", F.round("sep_arcsec", 5).alias("sep_arcsec"))


@query("join_best_candidate", f"WITH {STEPS} SELECT ero_detuid, targetid, round(sep, 5) AS sep_arcsec, to_main FROM best")
def join_best_candidate(v):
    return run(v).staged.filter("matched").select("ero_detuid", "targetid", F.round("sep_arcsec", 5).alias("sep_arcsec"), "to_main")


@query("join_preference_flips", f"""
WITH {STEPS} SELECT ero_detuid, targetid, nearest_targetid FROM best WHERE targetid <> nearest_targetid""")
def join_preference_flips(v):
    return run(v).staged.filter("matched AND targetid <> nearest_targetid").select("ero_detuid", "targetid", "nearest_targetid")


@query("join_group_extent", f"WITH {STEPS} SELECT targetid, members, widest <= 15.0e0 AS split_source FROM groups")
def join_group_extent(v):
    done = run(v)
    passing = done.staged.filter("matched AND not_excluded AND reliable")
    return sky.shared_groups(passing, done.params.split_max_sep_arcsec)


@query("agg_exact_duplicates", "SELECT ero_detuid, nway_p_i, count(*) AS copies FROM v_detections GROUP BY ALL HAVING count(*) > 1"
       .replace("GROUP BY ALL", "GROUP BY ero_detuid, nway_p_i, ls10_ra, ls10_dec, nway_match_flag"))
def agg_exact_duplicates(v):
    return xm.deduplicated(v.detections).filter("copies > 1").select("ero_detuid", "nway_p_i", "copies")


@query("agg_top_primary", f"WITH {STEPS} SELECT ero_detuid, nway_p_i, nway_dist_post, round(ls10_dec, 9) AS ls10_dec FROM prim")
def agg_top_primary(v):
    return primaries(v).select("ero_detuid", "nway_p_i", "nway_dist_post", F.round("ls10_dec", 9).alias("ls10_dec"))


@query("agg_shared_targets", f"WITH {STEPS} SELECT targetid, ero_detuid, members, split_source, kept FROM resolved WHERE members > 1")
def agg_shared_targets(v):
    return run(v).resolved.filter("members > 1").select("targetid", "ero_detuid", "members", "split_source", "kept")


@query("agg_shared_counts", f"""
WITH {STEPS} SELECT count(DISTINCT CASE WHEN members > 1 THEN targetid END) AS shared_target_groups,
  count(DISTINCT CASE WHEN split_source THEN targetid END) AS split_source_groups, count_if(split_source) AS split_source_rows,
  count(DISTINCT CASE WHEN members > 1 AND NOT split_source THEN targetid END) AS collision_groups,
  count_if(NOT kept) AS collision_rows_dropped, max(members) AS largest_group FROM resolved""")
def agg_shared_counts(v):
    return run(v).shared_counts()


@query("agg_match_statistics", f"""
WITH {STEPS} SELECT CAST(sum(n_candidates) AS BIGINT) AS candidate_pairs, count(*) AS nway_rows_matched,
  count_if(n_candidates >= 2) AS nway_rows_with_2plus_candidates,
  count_if(targetid <> nearest_targetid) AS flipped_by_main_survey_preference, count_if(to_main) AS matched_to_main_survey,
  round(quantile_cont(sep, 0.5), 5) AS median_sep_arcsec, round(quantile_cont(sep, 0.99), 5) AS p99_sep_arcsec FROM best""")
def agg_match_statistics(v):
    out = run(v).match_statistics()
    return out.withColumns({c: F.round(c, 5) for c in ("median_sep_arcsec", "p99_sep_arcsec")})


@query("agg_census", f"WITH {STEPS} SELECT spectype, count(*) AS rows FROM resolved WHERE kept GROUP BY spectype")
def agg_census(v):
    return run(v).census()


@query("win_candidate_count", f"WITH {STEPS} SELECT ero_detuid, n_candidates FROM best WHERE n_candidates >= 2")
def win_candidate_count(v):
    return run(v).staged.filter("n_candidates >= 2").select("ero_detuid", "n_candidates")


@query("win_top_ranked", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def win_top_ranked(v):
    from skyframe.operators.joins import best_per_key
    return best_per_key(v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
                        [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("fn_separation", f"""
SELECT t.o_orderkey AS k, round({HAVERSINE.format(r1='150.0e0', d1='20.0e0', r2='150 + o_custkey / 7000.0e0', d2='20 + o_totalprice / 1.0e7')}, 4) AS sep_arcsec
FROM orders t""")
def fn_separation(v):
    o = v.table("orders")
    sep = separation_arcsec(F.lit(150.0), F.lit(20.0), F.expr("150 + o_custkey / 7000.0e0"), F.expr("20 + o_totalprice / 1.0e7"))
    return o.select(F.col("o_orderkey").alias("k"), F.round(sep, 4).alias("sep_arcsec"))
