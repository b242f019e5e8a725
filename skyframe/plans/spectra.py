"""Spectra, staging and line jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators import lines as ln
from skyframe.operators import spectra as sp
from skyframe.operators.joins import strict_lookup
from skyframe.params import Grid
from skyframe.session import settle


@dataclass
class MergedSpectra:
    spectra: DataFrame
    shards: DataFrame
    targets: DataFrame

    def counts(self) -> DataFrame:
        missing = self.targets.select("targetid").distinct().join(self.spectra.select("targetid"), "targetid", "left_anti")
        lacking = missing.agg(F.count(F.lit(1)).alias("targets_without_spectrum"))
        return sp.merge_counts(self.shards).join(F.broadcast(lacking))  # one row each


def coadd_spectra(camera: DataFrame, targets: DataFrame, grid: Grid = Grid()) -> MergedSpectra:
    """Coadd the wanted targets group by group and keep the best copy of each."""
    shards = settle(sp.coadd(sp.wanted_spectra(camera, targets), grid))  # two results read it
    return MergedSpectra(sp.merge_best(shards), shards, targets)


def stage(manifest: DataFrame, spectra: DataFrame, images: DataFrame) -> DataFrame:
    """Staged rows of the sample: scalars narrowed to floats, spectrum and image attached by strict lookup.

    `spectra` carries `source_row`; write with `sources.sinks.write_staged` to keep rows in that order.
    """
    sample = manifest.filter("in_sample")
    joined = strict_lookup(sample, spectra.select("targetid", "source_row", "flux", "ivar"), ["targetid"], "spectra")
    joined = strict_lookup(joined, images.select("targetid", "image"), ["targetid"], "images")
    return joined.select(
        "targetid", "split", "source_row", F.col("flux").cast("array<float>").alias("spectra"),
        F.col("ivar").cast("array<float>").alias("spectra_ivar"), F.col("z").cast("float").alias("redshift"),
        *[F.col(f"ls10_flux_{b}").cast("float").alias(f"flux_{b}") for b in ("w1", "w2", "w3")],
        F.col("image").cast("array<float>").alias("image_flux"), "has_z", "has_wise")


@dataclass
class LineFeatures:
    features: DataFrame
    fits: DataFrame

    def status_counts(self) -> DataFrame:
        return ln.status_counts(self.features)


def line_features(sample: DataFrame, spectra: DataFrame, grid: Grid = Grid()) -> LineFeatures:
    """Fit the covered lines of every sample target and assemble one feature row per target.

    Fits are written once as a stage table: they are the costly step, and two results read them.
    """
    joined = strict_lookup(sample.select("targetid", "z"), spectra.select("targetid", "flux", "ivar"), ["targetid"], "spectra")
    fits = settle(ln.fit_lines(ln.line_windows(joined, grid)))
    return LineFeatures(ln.features_from_fits(sample, fits, grid), fits)
