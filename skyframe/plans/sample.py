"""Manifest, fold and fetch-plan jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import all_of, group_url
from skyframe.operators import sample as sm
from skyframe.operators.joins import DataError, require_unique
from skyframe.operators.ledger import cut_ledger
from skyframe.params import MANIFEST_COLUMNS, PRESENCE_FLAGS, SplitParams


@dataclass
class Manifest:
    manifest: DataFrame
    ledger: DataFrame

    def split_table(self) -> DataFrame:
        return self.manifest.filter("in_sample").select("targetid", "split")

    def split_counts(self) -> DataFrame:
        """Rows per split and their share of the sample."""
        return split_counts(self.manifest.filter("in_sample"))

    def presence_coverage(self) -> DataFrame:
        return presence_coverage(self.manifest.filter("in_sample"))

    def census(self) -> DataFrame:
        return split_census(self.manifest.filter("in_sample"))


def split_counts(sample: DataFrame) -> DataFrame:
    rows = sample.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    total = sample.agg(F.count(F.lit(1)).alias("_total"))
    return rows.join(F.broadcast(total)).select("split", "rows", (F.col("rows") / F.col("_total")).alias("fraction"))


def presence_coverage(sample: DataFrame, flags: tuple[str, ...] = PRESENCE_FLAGS) -> DataFrame:
    """(flag, rows, fraction) of the sample that carries each flag."""
    entries = [F.struct(F.lit(f).alias("flag"), F.count_if(f).alias("rows"), F.avg(F.col(f).cast("double")).alias("fraction"))
               for f in flags]
    return sample.agg(F.array(*entries).alias("_f")).select(F.explode("_f").alias("_f")).select("_f.*")


def split_census(sample: DataFrame) -> DataFrame:
    """Rows by split and class, with totals (split NULL is all splits; class NULL is all classes)."""
    return sample.rollup("split", "spectype").agg(F.count(F.lit(1)).alias("rows"))


def build_manifest(matched: DataFrame, spectra: DataFrame, images: DataFrame,
                   params: SplitParams = SplitParams()) -> Manifest:
    """Flag every matched row, choose the sample and draw its split."""
    flagged = sm.with_presence(matched, spectra, images)
    cuts = sm.sample_cuts()
    flagged = flagged.withColumn("in_sample", all_of(c for _, c in cuts))
    sample = flagged.filter("in_sample")
    require_unique(sample, ["targetid"], "sample")
    if sample.isEmpty():
        raise DataError("no row passes the sample cuts")
    drawn = sm.assign_split(sample.select("targetid", "ero_detuid"), "targetid", params)
    manifest = flagged.join(drawn, ["targetid", "ero_detuid"], "left").select(*MANIFEST_COLUMNS)
    return Manifest(manifest, cut_ledger(flagged, cuts))


def crossval(sample: DataFrame, seed: int = 42, folds: int = 5) -> DataFrame:
    """(targetid, block, fold, role) for every sample row and fold."""
    return sm.with_folds(sm.assign_blocks(sample.select("targetid"), "targetid", seed), folds)


def plan_groups(matched: DataFrame) -> DataFrame:
    """Distinct targets per (survey, program, healpix), as counts; the targets stay one per row.

    A group may be large, so members are not gathered into an array.
    """
    targets = matched.select("targetid", "survey", "program", "healpix").dropDuplicates(["targetid", "survey", "program", "healpix"])
    return targets.groupBy("survey", "program", "healpix").agg(
        F.count(F.lit(1)).alias("targets"), F.min("targetid").alias("first_target"), F.max("targetid").alias("last_target"))


def fetch_plan(matched: DataFrame, done: DataFrame, template: str) -> DataFrame:
    """Groups with no shard yet, with the address of each; `done` lists finished or absent groups."""
    keys = ["survey", "program", "healpix"]
    todo = plan_groups(matched).join(done.select(*keys), keys, "left_anti")
    return todo.withColumn("url", group_url(template, *keys))
