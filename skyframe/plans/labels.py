"""Label job: X-ray labels by strict lookup, host labels by best fit and gates, aligned to matched rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import is_finite
from skyframe.functions.cosmology import log_sphere_area_cm2
from skyframe.functions.labels import fit_gates, log_flux_columns, log_luminosity, repaired_counts
from skyframe.operators.joins import best_host_fit, best_per_key, strict_lookup
from skyframe.params import COUNTED_LABELS, XRAY_BANDS, LabelParams


def xray_label_columns(params: LabelParams) -> dict[str, Column]:
    """Label columns of one source-catalogue row, in all bands."""
    out: dict[str, Column] = {"det_like_0": F.col("det_like_0").cast("double")}
    for b in XRAY_BANDS:
        value, low, high = log_flux_columns(f"ml_flux_{b}", f"ml_flux_lowerr_{b}", f"ml_flux_uperr_{b}", params.cap_dex)
        out |= {f"log_flux_{b}": value, f"log_flux_{b}_sig_lo": low, f"log_flux_{b}_sig_hi": high}
        if b != "1":
            out[f"det_like_{b}"] = F.col(f"det_like_{b}").cast("double")
        triple = repaired_counts(f"ape_cts_{b}", f"ape_bkg_{b}", f"ape_exp_{b}")
        out |= {f"ape_{q}_{b}": triple[q] for q in ("cts", "bkg", "exp")}
        out[f"ape_bkg_negative_{b}"] = triple["bkg_negative"]
    return out


def xray_labels(main: DataFrame, params: LabelParams = LabelParams()) -> DataFrame:
    """Labels of every source-catalogue row, keyed by detection."""
    return main.select("ero_detuid", *[c.alias(n) for n, c in xray_label_columns(params).items()])


def band_quality(main: DataFrame, params: LabelParams = LabelParams()) -> DataFrame:
    """Per band: measured fluxes, detections over the threshold, and how counts were repaired."""
    labels = main.select(*[c.alias(n) for n, c in xray_label_columns(params).items()],
                         *[F.col(f"ape_cts_{b}").alias(f"raw_cts_{b}") for b in XRAY_BANDS])
    rows = [F.struct(F.lit(b).alias("band"), F.col(f"log_flux_{b}").alias("flux"),
                     F.col("det_like_0" if b == "1" else f"det_like_{b}").alias("like"), F.col(f"raw_cts_{b}").alias("raw"),
                     F.col(f"ape_bkg_{b}").alias("bkg"), F.col(f"ape_exp_{b}").alias("exp"),
                     F.col(f"ape_bkg_negative_{b}").alias("negative")) for b in XRAY_BANDS]
    long = labels.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.groupBy("band").agg(
        F.count("flux").alias("flux_measured"),
        F.count_if(F.col("flux").isNull()).alias("flux_not_a_measurement"),
        F.count_if(F.col("like") > params.det_like_min).alias("det_like_above"),
        F.count_if(F.col("raw") < 0).alias("ape_cts_wrapped"),
        F.count_if("negative").alias("ape_bkg_negative_clipped"),
        F.count_if(F.col("raw") == 0).alias("ape_cts_zero"),
        F.count_if((F.col("raw") >= 0) & F.col("exp").isNotNull() & F.col("bkg").isNotNull()).alias("ape_triple_complete"))


def host_labels(fits: DataFrame, observed: DataFrame, params: LabelParams = LabelParams()) -> DataFrame:
    """Stellar mass and star-formation labels per target with a fit, with the gates that decided them."""
    chosen = best_host_fit(fits, observed)
    gates = fit_gates(params.flag_window, params.max_sigma_dex)
    gated = chosen.select("targetid", "logm", "logsfr", F.abs("logm_err").alias("_em"), F.abs("logsfr_err").alias("_es"),
                          *[c.alias(n) for n, c in gates.items()])
    out = {}
    for name, value, error, part in (("logmstar_cigale", "logm", "_em", "mass"), ("log_sfr", "logsfr", "_es", "sfr")):
        usable = ~(F.col(f"unusable_{part}") | F.col(f"wide_{part}"))
        out |= {name: F.when(usable, F.col(value)), f"{name}_sig_lo": F.when(usable, F.col(error)),
                f"{name}_sig_hi": F.when(usable, F.col(error))}
    return gated.select("targetid", *[c.alias(n) for n, c in out.items()], *gates)


def host_statistics(fits: DataFrame, observed: DataFrame, params: LabelParams = LabelParams()) -> DataFrame:
    """Fits of our targets, duplicates resolved, and what each gate removed."""
    ours = fits.join(observed.select("targetid"), "targetid", "left_semi").agg(
        F.count(F.lit(1)).alias("vac_rows_for_our_targets"), F.count_distinct("targetid").alias("targets_in_vac"))
    labels = host_labels(fits, observed, params)
    gated = labels.agg(
        F.count(F.lit(1)).alias("_kept"),
        *[F.count_if(g).alias(g) for g in ("failed_fit", "sentinel", "broad_mass_pdf", "broad_sfr_pdf")],
        F.count("logmstar_cigale").alias("mass_usable"), F.count_if("unusable_mass").alias("mass_unusable"),
        F.count_if("wide_mass").alias("mass_removed_by_max_sigma"),
        F.count("log_sfr").alias("sfr_usable"), F.count_if("unusable_sfr").alias("sfr_unusable"),
        F.count_if("wide_sfr").alias("sfr_removed_by_max_sigma"))
    both = ours.join(F.broadcast(gated))  # one row each
    return both.withColumn("duplicate_fits_resolved", F.col("vac_rows_for_our_targets") - F.col("_kept")).drop("_kept")


def observed_targets(matched: DataFrame) -> DataFrame:
    """One (targetid, survey, program) per target; rows of one target carry the same observation."""
    return best_per_key(matched.select("targetid", "survey", "program", "ero_detuid"), ["targetid"],
                        [F.col("ero_detuid")]).drop("ero_detuid")


@dataclass
class Labels:
    labels: DataFrame
    params: LabelParams

    def coverage(self) -> DataFrame:
        """Finite count of each headline label, and rows below the redshift floor."""
        return label_coverage(self.labels)

    def below_floor(self) -> DataFrame:
        return self.labels.agg(F.count_if(is_finite("z") & (F.col("z") < self.params.z_floor)).alias("z_below_floor"))


def label_coverage(labels: DataFrame, columns: tuple[str, ...] = COUNTED_LABELS) -> DataFrame:
    """(label, finite) rows."""
    counts = labels.agg(*[F.count_if(is_finite(c)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "label", "finite")


def derive_labels(matched: DataFrame, main: DataFrame, fits: DataFrame,
                  params: LabelParams = LabelParams()) -> Labels:
    """All labels, one row per matched row.

    Every detection must be in the source catalogue; a target without a host fit gets missing labels.
    """
    xray = strict_lookup(matched, main, ["ero_detuid"], "source catalogue")
    labelled = xray.select(*matched.columns, *[c.alias(n) for n, c in xray_label_columns(params).items()])
    labelled = labelled.withColumn("log_lx", log_luminosity("log_flux_1", "z", log_sphere_area_cm2("z"), params.z_floor))
    host = host_labels(fits, observed_targets(matched), params)
    names = [f"{n}{s}" for n in ("log_sfr", "logmstar_cigale") for s in ("", "_sig_lo", "_sig_hi")]
    return Labels(labelled.join(host.select("targetid", *names), "targetid", "left"), params)
