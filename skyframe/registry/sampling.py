"""Sample, splits, folds, masks, standardization and input combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions.core import subset_name
from skyframe.functions.labels import has_infrared, has_redshift
from skyframe.operators import joins
from skyframe.operators import sample as sm
from skyframe.operators.ledger import cut_ledger
from skyframe.operators.quality import values_per_key
from skyframe.params import Head
from skyframe.plans import sample as sp
from skyframe.registry.base import query
from skyframe.registry.catalog import STEPS, run
from skyframe.session import settle

IN_SAMPLE = "NOT split_source AND has_spectrum AND has_image"
HEADS = (Head("flux", ("flux",)), Head("lx", ("lx",)), Head("sfr", ("sfr",)), Head("mstar", ("mstar",)),
         Head("sfr_mstar", ("sfr", "mstar")), Head("rates", ("rate_p2", "rate_p3")),
         Head("joint4", ("rate_p2", "rate_p3", "sfr", "mstar")))

SHUFFLE = """
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', CAST(targetid AS VARCHAR))), targetid) - 1 AS rank,
  count(*) OVER () AS total FROM chosen)"""
SPLIT = f"""
chosen AS (SELECT * FROM v_sample WHERE {IN_SAMPLE}), {SHUFFLE},
split AS (SELECT * EXCLUDE (rank, total), CASE WHEN rank < round_even(0.8e0 * total, 0) THEN 'train'
  WHEN rank < round_even(0.9e0 * total, 0) THEN 'val' ELSE 'test' END AS split FROM ranked)"""
BLOCKS = f"""
chosen AS (SELECT * FROM v_sample WHERE {IN_SAMPLE}), {SHUFFLE},
blocked AS (SELECT * EXCLUDE (rank, total),
  {" + ".join(f"(CASE WHEN rank >= round_even({i / 10!r}e0 * total, 0) THEN 1 ELSE 0 END)" for i in range(1, 10))} AS block FROM ranked)"""


def sample(v):
    return v.sample.filter(IN_SAMPLE)


@query("flt_has_z", "SELECT targetid, z > 0 AND zwarn = 0 AS has_z FROM v_targets")
def flt_has_z(v):
    return v.targets.select("targetid", has_redshift("z", "zwarn").alias("has_z"))


@query("flt_has_wise", f"""
SELECT ero_detuid, xray_dec, (ls10_flux_w1 > 0 AND ls10_flux_ivar_w1 > 0) OR (ls10_flux_w2 > 0 AND ls10_flux_ivar_w2 > 0)
  OR (ls10_flux_w3 > 0 AND ls10_flux_ivar_w3 > 0) AS has_wise FROM v_detections""")
def flt_has_wise(v):
    return v.detections.select("ero_detuid", "xray_dec", has_infrared().alias("has_wise"))


@query("flt_sample_ledger", """
WITH n AS (SELECT count(*) AS n0, count_if(NOT split_source) AS n1, count_if(NOT split_source AND has_spectrum) AS n2,
  count_if(NOT split_source AND has_spectrum AND has_image) AS n3 FROM v_sample)
SELECT 1 AS ord, 'split_source_pairs_excluded' AS filter, n1 AS kept, n0 - n1 AS dropped, CAST(NULL AS VARCHAR) AS note FROM n
UNION ALL SELECT 2, 'has_spectrum', n2, n1 - n2, NULL FROM n UNION ALL SELECT 3, 'has_image', n3, n2 - n3, NULL FROM n""")
def flt_sample_ledger(v):
    return cut_ledger(v.sample, sm.sample_cuts())


@query("flt_common_subsample", """
SELECT source_id, has_z AND has_spectrum AND has_image AND has_wise AND log_sfr IS NOT NULL AND logmstar_cigale IS NOT NULL AS common FROM v_labels""")
def flt_common_subsample(v):
    common = sm.common_rows(HEADS[4], ["has_z", "has_spectrum", "has_image", "has_wise"])
    return sm.with_masks(v.labels).select("source_id", common.alias("common"))


@query("flt_withhold", """
SELECT count(*) AS rows, count_if(spectype = 'GALAXY') AS withheld,
  count(CASE WHEN spectype <> 'GALAXY' THEN log_lx END) AS log_lx_left, count(CASE WHEN spectype <> 'GALAXY' THEN ape_cts_p3 END) AS cts_left FROM v_labels""")
def flt_withhold(v):
    flag = F.col("spectype") == "GALAXY"
    out = sm.withhold(v.labels, flag, ["lx", "rate_p3"])
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("withheld"), F.count("log_lx").alias("log_lx_left"),
                   F.count("ape_cts_p3").alias("cts_left"))


_P2 = "(ape_cts_p2 IS NOT NULL AND ape_exp_p2 > 0)"
_P3 = "(ape_cts_p3 IS NOT NULL AND ape_exp_p3 > 0)"
_SM = "(log_sfr IS NOT NULL OR logmstar_cigale IS NOT NULL)"


@query("flt_scorable_counts", f"""
SELECT 'flux' AS head, count(log_flux_1) AS rows FROM v_labels UNION ALL SELECT 'lx', count(log_lx) FROM v_labels
UNION ALL SELECT 'sfr', count(log_sfr) FROM v_labels UNION ALL SELECT 'mstar', count(logmstar_cigale) FROM v_labels
UNION ALL SELECT 'sfr_mstar', count_if({_SM}) FROM v_labels UNION ALL SELECT 'rates', count_if({_P2} OR {_P3}) FROM v_labels
UNION ALL SELECT 'joint4', count_if(({_P2} OR {_P3} OR {_SM}) AND {_SM}) FROM v_labels""")
def flt_scorable_counts(v):
    return sm.scorable_counts(sm.with_masks(v.labels), HEADS)


@query("dq_dead_heads", f"""
SELECT 'flux' AS head, count(log_flux_1) AS rows, FALSE AS dead FROM v_labels UNION ALL SELECT 'lx', count(log_lx), FALSE FROM v_labels
UNION ALL SELECT 'sfr', 0, TRUE UNION ALL SELECT 'mstar', count(logmstar_cigale), FALSE FROM v_labels
UNION ALL SELECT 'sfr_mstar', count(logmstar_cigale), FALSE FROM v_labels UNION ALL SELECT 'rates', count_if({_P2} OR {_P3}), FALSE FROM v_labels
UNION ALL SELECT 'joint4', count(logmstar_cigale), FALSE FROM v_labels""")
def dq_dead_heads(v):
    """Labels without a star-formation rate: its head has no row to be scored on."""
    masked = sm.with_masks(sm.withhold(v.labels, F.lit(True), ["sfr"]))
    return sm.dead_heads(sm.scorable_counts(masked, HEADS))


@query("join_existence", """
SELECT targetid, targetid IN (SELECT targetid FROM v_host_fits) AS has_fit FROM v_targets""")
def join_existence(v):
    return joins.with_membership(v.targets.select("targetid"), v.host_fits, "targetid", "has_fit")


@query("join_anti_resume", """
SELECT targetid, survey FROM v_targets WHERE targetid NOT IN (SELECT targetid FROM v_host_fits WHERE chi2 > 40)""")
def join_anti_resume(v):
    return v.targets.select("targetid", "survey").join(v.host_fits.filter("chi2 > 40").select("targetid"), "targetid", "left_anti")


@query("join_two_hop", f"""
WITH {SPLIT} SELECT s.targetid, s.ero_detuid, s.split, m.det_like_0 FROM split s JOIN v_main m USING (ero_detuid) WHERE s.split = 'test'""")
def join_two_hop(v):
    manifest = sm.assign_split(sample(v))
    return joins.two_hop_lookup(manifest.filter("split = 'test'"), manifest, v.main, ["det_like_0"])


@query("agg_group_plan", """
SELECT survey, program, healpix, count(*) AS targets, min(targetid) AS first_target, max(targetid) AS last_target
FROM (SELECT DISTINCT targetid, trim(survey) AS survey, trim(program) AS program, healpix FROM v_targets) GROUP BY survey, program, healpix""")
def agg_group_plan(v):
    from skyframe.plans.crossmatch import clean_numbers
    return sp.plan_groups(clean_numbers(v.targets))


@query("job_fetch_plan", f"""
WITH {STEPS}, plan AS (SELECT survey, program, healpix, count(DISTINCT targetid) AS targets, min(targetid) AS first_target, max(targetid) AS last_target
  FROM resolved WHERE kept GROUP BY survey, program, healpix)
SELECT *, concat('https://host/', survey, '/', program, '/', CAST(healpix // 100 AS VARCHAR), '/', CAST(healpix AS VARCHAR)) AS url FROM plan
WHERE NOT (survey = 'main' AND program = 'dark' AND healpix % 2 = 0)""")
def job_fetch_plan(v):
    done = v.targets.filter("healpix % 2 = 0").select(F.lit("main").alias("survey"), F.lit("dark").alias("program"), "healpix").distinct()
    return sp.fetch_plan(run(v).matched, done, "https://host/{survey}/{program}/{group}/{pix}")


@query("win_split_assign", f"WITH {SPLIT} SELECT targetid, split FROM split")
def win_split_assign(v):
    return sm.assign_split(sample(v)).select("targetid", "split")


@query("win_blocks", f"WITH {BLOCKS} SELECT targetid, block FROM blocked")
def win_blocks(v):
    return sm.assign_blocks(sample(v)).select("targetid", "block")


@query("job_crossval", f"""
WITH {BLOCKS} SELECT targetid, block, fold, CASE WHEN block // 2 = fold THEN 'test' WHEN block = (2 * fold + 2) % 10 THEN 'val' ELSE 'train' END AS role
FROM blocked, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)""")
def job_crossval(v):
    return sp.crossval(sample(v))


@query("win_fold_view", f"WITH {BLOCKS} SELECT targetid FROM blocked WHERE block // 2 <> 4 AND block <> 0")
def win_fold_view(v):
    blocked = sm.assign_blocks(sample(v)).select("targetid", "block")
    parts = [blocked.filter("block < 8"), blocked.filter("block = 8"), blocked.filter("block = 9")]
    return sm.fold_view(parts, 4, "train").select("targetid")


@query("win_blocks_match_split", "SELECT TRUE AS blocks_match_existing_split")
def win_blocks_match_split(v):
    drawn = sm.assign_split(sample(v)).select("targetid", "split")
    return sm.blocks_match_split(sm.assign_blocks(sample(v)).select("targetid", "block").join(drawn, "targetid"))


@query("agg_split_counts", f"""
WITH {SPLIT} SELECT split, count(*) AS rows, round(count(*) / (SELECT count(*) FROM split), 9) AS fraction FROM split GROUP BY split""")
def agg_split_counts(v):
    return sp.split_counts(sm.assign_split(sample(v))).withColumn("fraction", F.round("fraction", 9))


@query("agg_presence_coverage", f"""
WITH chosen AS (SELECT * FROM v_sample WHERE {IN_SAMPLE})
SELECT 'has_z' AS flag, count_if(has_z) AS rows, round(avg(CAST(has_z AS DOUBLE)), 9) AS fraction FROM chosen
UNION ALL SELECT 'has_wise', count_if(has_wise), round(avg(CAST(has_wise AS DOUBLE)), 9) FROM chosen
UNION ALL SELECT 'has_spectrum', count_if(has_spectrum), round(avg(CAST(has_spectrum AS DOUBLE)), 9) FROM chosen
UNION ALL SELECT 'has_image', count_if(has_image), round(avg(CAST(has_image AS DOUBLE)), 9) FROM chosen""")
def agg_presence_coverage(v):
    return sp.presence_coverage(sample(v)).withColumn("fraction", F.round("fraction", 9))


@query("agg_split_census", f"WITH {SPLIT} SELECT split, spectype, count(*) AS rows FROM split GROUP BY ROLLUP (split, spectype)")
def agg_split_census(v):
    return sp.split_census(sm.assign_split(sample(v)))


@query("agg_splits_per_detection", """
SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def agg_splits_per_detection(v):
    return values_per_key(v.table("events"), "user_id", "event_type", "kinds").filter("kinds > 1")


@query("job_build_manifest", f"""
WITH {STEPS}, flagged AS (
  SELECT *, targetid IN (SELECT o_orderkey FROM orders) OR targetid % 5 <> 0 AS has_spectrum, targetid % 7 <> 0 AS has_image,
    z > 0 AND zwarn = 0 AS has_z, (ls10_flux_w1 > 0 AND ls10_flux_ivar_w1 > 0) OR (ls10_flux_w2 > 0 AND ls10_flux_ivar_w2 > 0)
      OR (ls10_flux_w3 > 0 AND ls10_flux_ivar_w3 > 0) AS has_wise FROM resolved WHERE kept),
chosen AS (SELECT targetid, ero_detuid FROM flagged WHERE NOT split_source AND has_spectrum AND has_image),
{SHUFFLE.replace("ranked AS", "drawn AS")}
SELECT f.targetid, f.ero_detuid, d.targetid IS NOT NULL AS in_sample, CASE WHEN rank < round_even(0.8e0 * total, 0) THEN 'train'
  WHEN rank < round_even(0.9e0 * total, 0) THEN 'val' WHEN rank IS NOT NULL THEN 'test' END AS split, has_spectrum, has_z, has_wise, has_image,
  split_source FROM flagged f LEFT JOIN drawn d USING (targetid, ero_detuid)""")
def job_build_manifest(v):
    spectra = v.targets.filter("targetid % 5 <> 0").select("targetid")
    images = v.targets.filter("targetid % 7 <> 0").select("targetid")
    out = sp.build_manifest(settle(run(v).matched), spectra, images).manifest  # jobs hand over written tables
    return out.select("targetid", "ero_detuid", "in_sample", "split", "has_spectrum", "has_z", "has_wise", "has_image", "split_source")


@query("set_cross_split_overlap", """
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_cross_split_overlap(v):
    o = v.table("orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("set_symmetric_difference", """
SELECT coalesce(a.k, b.k) AS targetid, a.k IS NULL AS only_expected FROM (SELECT doc_id AS k FROM documents) a
FULL JOIN (SELECT doc_id + 40 AS k FROM labels) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def set_symmetric_difference(v):
    from skyframe.operators.quality import key_differences
    return key_differences(v.table("documents").select(F.col("doc_id").alias("targetid")),
                           v.table("labels").select((F.col("doc_id") + 40).alias("targetid")), "targetid")


@query("set_union_of_splits", f"""
WITH {SPLIT} SELECT spectype, count(*) AS rows FROM split WHERE split IN ('val', 'test') GROUP BY spectype""")
def set_union_of_splits(v):
    drawn = sm.assign_split(sample(v)).select("targetid", "split", "spectype")
    both = drawn.filter("split = 'val'").unionByName(drawn.filter("split = 'test'"))
    return both.groupBy("spectype").agg(F.count(F.lit(1)).alias("rows"))


@query("set_subset_names", """
SELECT source_id, concat(CASE WHEN has_z THEN 'Z' ELSE '' END, CASE WHEN has_spectrum THEN 'S' ELSE '' END,
  CASE WHEN has_image THEN 'I' ELSE '' END, CASE WHEN has_wise THEN 'W' ELSE '' END) AS subset FROM v_labels""")
def set_subset_names(v):
    return v.labels.select("source_id", subset_name(["has_z", "has_spectrum", "has_image", "has_wise"]).alias("subset"))


SUBSETS_SQL = "(SELECT unnest(['Z','S','I','W','ZS','ZI','ZW','SI','SW','IW','ZSI','ZSW','ZIW','SIW','ZSIW']) AS subset, unnest(range(0, 15)) AS ordinal)"


@query("join_cross_subsets", f"SELECT s_suppkey, subset, ordinal FROM supplier, {SUBSETS_SQL}")
def join_cross_subsets(v):
    return sm.with_subsets(v.table("supplier").select("s_suppkey"))


@query("srt_limit_first", "SELECT targetid, spectype FROM v_sample ORDER BY targetid LIMIT 200")
def srt_limit_first(v):
    return v.sample.orderBy("targetid").limit(200).select("targetid", "spectype")


@query("srt_subset_order", f"""
SELECT ordinal, subset, count(*) AS rows FROM supplier, {SUBSETS_SQL} GROUP BY ordinal, subset ORDER BY ordinal""")
def srt_subset_order(v):
    rows = sm.with_subsets(v.table("supplier").select("s_suppkey")).groupBy("subset").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("ordinal", sm.subset_ordinal("subset")).orderBy("ordinal")


def _moment(name: str, value: str, first: bool = False) -> str:
    return (f"SELECT '{name}' AS target, count({value}) AS n, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS scale "
            "FROM v_labels WHERE split = 'train'")


@query("agg_standardizer", " UNION ALL ".join([
    _moment("flux", "log_flux_1"), _moment("lx", "log_lx"), _moment("sfr", "log_sfr"), _moment("mstar", "logmstar_cigale"),
    _moment("rate_p2", "CASE WHEN ape_exp_p2 > 0 THEN log10(greatest(ape_cts_p2 - ape_bkg_p2, 0.5) / CASE WHEN ape_exp_p2 > 0 THEN ape_exp_p2 END) END"),
    _moment("rate_p3", "log10(greatest(CASE WHEN ape_cts_p3 IS NOT NULL THEN ape_cts_p3 - ape_bkg_p3 END, CASE WHEN ape_cts_p3 IS NOT NULL THEN 0.5 END) / ape_exp_p3)"),
]))
def agg_standardizer(v):
    train = v.labels.filter("split = 'train'")
    out = sm.moments(train, {t: sm.target_value(t) for t in ("flux", "lx", "sfr", "mstar", "rate_p2", "rate_p3")})
    return out.withColumns({"mean": F.round("mean", 6), "scale": F.round("scale", 6)})


@query("fn_standardize", """
WITH m AS (SELECT avg(log_sfr) AS mu, stddev_pop(log_sfr) AS sd FROM v_labels WHERE split = 'train')
SELECT source_id, round(coalesce((log_sfr - mu) / sd, 0), 6) AS encoded, round((log_sfr - mu) / sd * sd + mu, 6) AS decoded FROM v_labels, m""")
def fn_standardize(v):
    s = sm.fit_standardizer(v.labels, ["sfr"])
    encoded = s.encode("sfr", F.col("log_sfr"))
    return v.labels.select("source_id", F.round(F.coalesce(encoded, F.lit(0.0)), 6).alias("encoded"),
                           F.round(s.decode("sfr", encoded), 6).alias("decoded"))


_U = "(CAST(('0x' || substr(md5(concat('7:{m}:', CAST(source_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0e0)"


@query("stat_subset_sampling", f"""
WITH x AS (SELECT source_id, has_z, has_spectrum, has_image, has_wise,
  floor({_U.format(m='size')} * (has_z::INT + has_spectrum::INT + has_image::INT + has_wise::INT)) + 1 AS size,
  [CASE WHEN has_z THEN {_U.format(m='Z')} ELSE -1 END, CASE WHEN has_spectrum THEN {_U.format(m='S')} ELSE -1 END,
   CASE WHEN has_image THEN {_U.format(m='I')} ELSE -1 END, CASE WHEN has_wise THEN {_U.format(m='W')} ELSE -1 END] AS noise FROM v_labels
  WHERE has_z OR has_spectrum OR has_image OR has_wise),
y AS (SELECT source_id, size, unnest(noise) AS u, unnest(['Z', 'S', 'I', 'W']) AS m, unnest([0, 1, 2, 3]) AS i FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY u DESC, i) AS rn FROM y)
SELECT source_id, string_agg(m, '' ORDER BY i) AS subset FROM z WHERE rn <= size GROUP BY source_id""")
def stat_subset_sampling(v):
    present = ["has_z", "has_spectrum", "has_image", "has_wise"]
    some = v.labels.filter("has_z OR has_spectrum OR has_image OR has_wise")
    return some.select("source_id", sm.draw_subset(present, "source_id", 7).alias("subset"))
