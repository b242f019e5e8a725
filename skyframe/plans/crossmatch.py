"""Cross-match job: one counterpart per detection, with the ledger of every row cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import is_finite, on_main_survey, trimmed
from skyframe.operators.joins import DataError, best_per_key, require_unique
from skyframe.operators.ledger import counts_to_ledger
from skyframe.operators.rank import exact_quantiles
from skyframe.operators.sky import counterparts, resolve_shared_targets
from skyframe.session import settle
from skyframe.params import EXCLUDED_CLASSES, MATCHED_COLUMNS, TARGET_COLUMNS, CrossmatchParams


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating columns, and padding is trimmed from strings."""
    fixed = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            fixed[name] = F.when(~F.isnan(name), F.col(name))
        elif kind == "string":
            fixed[name] = trimmed(name)
    return df.withColumns(fixed)


def deduplicated(detections: DataFrame) -> DataFrame:
    """Identical rows collapsed, with the number of `copies` each stood for."""
    return detections.groupBy(*detections.columns).agg(F.count(F.lit(1)).alias("copies"))


def primary_order() -> list[Column]:
    """Primary row of a detection: highest p_i, then highest dist_post, then position."""
    return [F.col("nway_p_i").desc_nulls_last(), F.col("nway_dist_post").desc_nulls_last(),
            F.col("ls10_ra").asc_nulls_last(), F.col("ls10_dec").asc_nulls_last(), F.col("xray_ra"), F.col("xray_dec")]


def detection_counts(detections: DataFrame) -> DataFrame:
    """Raw, distinct and primary-flag row counts of the detection catalogue, in one row."""
    rows = deduplicated(detections)
    return rows.agg(F.sum("copies").alias("n_raw"), F.count(F.lit(1)).alias("n_distinct"),
                    F.count_if(F.col("nway_match_flag") == 1).alias("n_flagged"))


def primary_detections(detections: DataFrame) -> DataFrame:
    """One primary row per detection."""
    flagged = detections.filter(F.col("nway_match_flag") == 1).distinct()
    return best_per_key(flagged, ["ero_detuid"], primary_order())


def primary_targets(targets: DataFrame, releases: tuple[int, ...]) -> DataFrame:
    """Primary targets with a positive id and a finite position; adds `is_main`."""
    return (targets.filter(F.col("zcat_primary") & (F.col("targetid") > 0)
                           & is_finite("target_ra") & is_finite("target_dec"))
            .withColumn("is_main", on_main_survey("targetid", releases)))


def target_counts(targets: DataFrame) -> DataFrame:
    """Row counts of the target catalogue at each step of its filter."""
    primary = F.col("zcat_primary")
    chosen = primary & (F.col("targetid") > 0)
    placed = is_finite("target_ra") & is_finite("target_dec")
    return targets.agg(
        F.count(F.lit(1)).alias("desi_rows_raw"), F.count_if(primary).alias("desi_primary_rows"),
        F.count_if(primary & ~(F.col("targetid") > 0)).alias("desi_primary_targetid_le0"),
        F.count_if(chosen & ~placed).alias("desi_primary_bad_position"),
        F.count_if(chosen & placed).alias("desi_rows_kept"))


def calibrated() -> Column:
    return is_finite("nway_threshold6")


def reliable(uncalibrated_min: float) -> Column:
    """Above the row's own threshold where it has one, otherwise at least the flat floor."""
    p = F.col("nway_p_any")
    return F.coalesce(F.when(calibrated(), p > F.col("nway_threshold6")).otherwise(p >= uncalibrated_min), F.lit(False))


def not_excluded() -> Column:
    """Class outside the excluded ones; an unknown class stays."""
    return F.coalesce(~F.col("spectype").isin(*EXCLUDED_CLASSES), F.lit(True))


@dataclass
class Crossmatch:
    """Lazy results of the job: `matched` is the product, the others describe it."""

    matched: DataFrame
    staged: DataFrame
    resolved: DataFrame
    ledger: DataFrame
    params: CrossmatchParams

    def match_statistics(self) -> DataFrame:
        """Pairs, matches, ambiguous and flipped detections, and exact separation quantiles."""
        found = self.staged.filter("matched")
        counts = found.agg(
            F.sum("n_candidates").cast("long").alias("candidate_pairs"),
            F.count(F.lit(1)).alias("nway_rows_matched"),
            F.count_if(F.col("n_candidates") >= 2).alias("nway_rows_with_2plus_candidates"),
            F.count_if(F.col("targetid") != F.col("nearest_targetid")).alias("flipped_by_main_survey_preference"),
            F.count_if("to_main").alias("matched_to_main_survey"))
        quantiles = exact_quantiles(found, "sep_arcsec", [0.5, 0.99]).agg(
            F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median_sep_arcsec"),
            F.max(F.when(F.col("q") == 0.99, F.col("value"))).alias("p99_sep_arcsec"))
        return counts.join(F.broadcast(quantiles))  # one row each

    def reliability_counts(self) -> DataFrame:
        """The four cells: calibrated or not, kept or dropped."""
        return (self.staged.filter("matched AND not_excluded")
                .groupBy(calibrated().alias("calibrated"), F.col("reliable").alias("keep"))
                .agg(F.count(F.lit(1)).alias("rows")))

    def shared_counts(self) -> DataFrame:
        """How shared targets were resolved."""
        group = F.when(F.col("members") > 1, F.col("targetid"))
        return self.resolved.agg(
            F.count_distinct(group).alias("shared_target_groups"),
            F.count_distinct(F.when(F.col("split_source"), F.col("targetid"))).alias("split_source_groups"),
            F.count_if("split_source").alias("split_source_rows"),
            F.count_distinct(F.when(~F.col("split_source"), group)).alias("collision_groups"),
            F.count_if(~F.col("kept")).alias("collision_rows_dropped"),
            F.max("members").alias("largest_group"))

    def census(self) -> DataFrame:
        return self.matched.groupBy("spectype").agg(F.count(F.lit(1)).alias("rows"))


def crossmatch(detections: DataFrame, targets: DataFrame, params: CrossmatchParams = CrossmatchParams()) -> Crossmatch:
    """Match every detection to its best target and resolve targets that several detections share.

    Flags rather than filters carry the cuts, so the ledger is an aggregate over the same rows, which
    are written once as a stage table.
    """
    detections, targets = clean_numbers(detections), clean_numbers(targets)
    primaries = primary_detections(detections).withColumn(
        "placed", is_finite("ls10_ra") & is_finite("ls10_dec")).drop("nway_match_flag")
    pool = primary_targets(targets, params.main_releases)
    require_unique(pool, ["targetid"], "primary targets")
    found = counterparts(primaries.filter("placed"), pool.select("targetid", "target_ra", "target_dec", "is_main"),
                         params.radius_arcsec, params.cell_per_radius)
    # a target's columns join the few positions that found one; rows without a position get keys of their own outside the sky
    known = found.join(pool.select("targetid", *TARGET_COLUMNS), "targetid").withColumnsRenamed({"ls10_ra": "_ra", "ls10_dec": "_dec"})
    apart = F.xxhash64("ero_detuid").cast("double") * 2.0 + 1.0e6
    ra, dec = (F.when(F.col("placed"), F.col(c)).otherwise(apart) for c in ("ls10_ra", "ls10_dec"))
    staged = (primaries.join(known, (ra == F.col("_ra")) & (dec == F.col("_dec")), "left").drop("_ra", "_dec")
              .withColumn("matched", F.col("targetid").isNotNull())
              .withColumn("not_excluded", not_excluded())
              .withColumn("reliable", reliable(params.uncalibrated_min)))
    staged = settle(staged)  # one row per detection; every result below reads it, none repeats the sky join
    if staged.filter("matched").isEmpty():
        raise DataError(f"no detection has a target within {params.radius_arcsec} arcsec")
    resolved = resolve_shared_targets(staged.filter("matched AND not_excluded AND reliable"), params.split_max_sep_arcsec)
    matched = resolved.filter("kept").select(*MATCHED_COLUMNS)

    passed = staged.agg(
        F.count(F.lit(1)).alias("n_primary"), F.count_if("placed").alias("n_placed"), F.count_if("matched").alias("n_matched"),
        F.count_if(F.expr("matched AND not_excluded")).alias("n_class"),
        F.count_if(F.expr("matched AND not_excluded AND reliable")).alias("n_reliable"))
    totals = (detection_counts(detections).join(F.broadcast(passed))
              .join(F.broadcast(resolved.agg(F.count_if("kept").alias("n_kept")))))  # one row each
    ledger = counts_to_ledger(totals, "n_raw", [
        ("nway_exact_duplicates_collapsed", "n_distinct", None),
        ("nway_match_flag==1", "n_flagged", None),
        ("nway_one_primary_per_detuid", "n_primary", None),
        ("nway_finite_ls10_position", "n_placed", None),
        ("nway_matched_within_radius", "n_matched", None),
        ("spectype_not_stellar", "n_class", None),
        ("nway_p_any_reliability", "n_reliable", None),
        ("collision_losers_dropped", "n_kept", None),
    ])
    return Crossmatch(matched, staged, resolved, ledger, params)
