"""Declarative data-quality checks, each one row (check, passed, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import is_finite
from skyframe.functions.labels import has_redshift
from skyframe.functions.spectra import all_finite, any_nonzero
from skyframe.operators.sample import cut_points
from skyframe.params import COUNTED_LABELS, IMAGE_BANDS, Grid, SplitParams
from skyframe.session import settle

# The columns and types of a staged split.
STAGED_CONTRACT = {
    "targetid": "bigint", "spectra": "array<float>", "spectra_ivar": "array<float>", "redshift": "float", "flux_w1": "float",
    "flux_w2": "float", "flux_w3": "float", "image_flux": "array<float>", "has_z": "boolean", "has_wise": "boolean",
}
PLACEMENT = ("split", "source_row")


def verdict(name: str, totals: DataFrame) -> DataFrame:
    """Turn one row of problem counts into a check: passed when every count is 0, else the non-zero ones."""
    named = [F.when(F.col(c) > 0, F.format_string(f"{c}: %d", F.col(c).cast("long"))) for c in totals.columns]
    found = F.concat_ws("; ", *named)
    return totals.select(F.lit(name).alias("check"), (found == "").alias("passed"), F.when(found == "", "ok").otherwise(found).alias("detail"))


def fact(spark, name: str, problems: Sequence[str]) -> DataFrame:
    """A check decided on the driver from metadata."""
    return spark.createDataFrame([(name, not problems, "; ".join(problems) or "ok")], "check string, passed boolean, detail string")


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def overall(checks: DataFrame) -> DataFrame:
    """(passed, failed): whether every check passed, and the names of those that did not."""
    return checks.agg(F.every("passed").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failed"))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only; `only_expected` marks those of the right side."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    return (a.join(b, key, "full_outer").filter("_l IS NULL OR _r IS NULL")
            .select(key, F.col("_l").isNull().alias("only_expected")))


def check_files(statuses: DataFrame) -> DataFrame:
    """No expected file missing, short or long, and no leftover."""
    kinds = ("missing", "partial", "wrong_size", "unexpected")
    return verdict("files_present", statuses.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds]))


def check_schema(staged: DataFrame, grid: Grid, size: int, contract: dict[str, str] = STAGED_CONTRACT) -> DataFrame:
    """Exact columns and types, and array lengths of every row."""
    problems = contract_problems(staged, contract)
    return fact(staged.sparkSession, "schema", problems) if problems else verdict("schema", staged.agg(*_named(_shape_counts(grid, size))))


def contract_problems(staged: DataFrame, contract: dict[str, str] = STAGED_CONTRACT) -> list[str]:
    """What the columns and types of a staged table lack or have too many of; no row is read."""
    have = {n: k for n, k in staged.dtypes if n not in PLACEMENT}
    problems = [f"column {n}" for n in sorted(set(have) ^ set(contract))]
    return problems + [f"{n} is {have[n]}, not {k}" for n, k in contract.items() if n in have and have[n] != k]


def _named(counts: dict[str, Column], prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for n, c in counts.items()]


def _shape_counts(grid: Grid, size: int) -> dict[str, Column]:
    wrong = {"spectra_shape": F.size("spectra") != grid.nbin, "ivar_shape": F.size("spectra_ivar") != grid.nbin,
             "image_shape": F.size("image_flux") != len(IMAGE_BANDS) * size * size}
    return {n: F.count_if(F.coalesce(w, F.lit(True))) for n, w in wrong.items()}


def check_targetids(staged: DataFrame, split_table: DataFrame) -> DataFrame:
    """Ids unique within a split, in one split only, and the same set as the split table."""
    per = staged.groupBy("targetid", "split").agg(F.count(F.lit(1)).alias("_rows"))
    expected = split_table.select("targetid", "split").withColumn("_expected", F.lit(True))
    both = per.join(expected, ["targetid", "split"], "full_outer")
    ids = both.groupBy("targetid").agg(
        F.count_if(F.col("_rows") > 1).alias("_dup"), F.count("_rows").alias("_in"),
        F.count_if(F.col("_rows").isNull() | F.col("_expected").isNull()).alias("_diff"))
    return verdict("targetids", ids.agg(F.sum("_dup").alias("duplicates"), F.count_if(F.col("_in") > 1).alias("in_two_splits"),
                                        F.sum("_diff").alias("differ_from_split_table")))


def check_split_sizes(staged: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """Sizes within one row of the rounded cumulative fractions."""
    return verdict("split_sizes", staged.agg(*_split_counts(params)).select(*_sizes_off(params)))


def _split_counts(params: SplitParams) -> list[Column]:
    return [F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in params.names]]


def _sizes_off(params: SplitParams) -> list[Column]:
    edges = [F.lit(0).cast("long"), *cut_points(params.fractions, F.col("_total")), F.col("_total")]
    return [F.when(F.abs(F.col(f"_{s}") - (hi - lo)) > 1, 1).otherwise(0).alias(s) for s, lo, hi in zip(params.names, edges, edges[1:])]


def with_manifest(staged: DataFrame, manifest: DataFrame) -> DataFrame:
    """Staged rows beside what the manifest's sample rows say of them, in columns that begin with an underscore."""
    sample = manifest.filter("in_sample").select("targetid", F.col("split").alias("_split"), F.col("has_z").alias("_has_z"), F.col("has_wise").alias("_has_wise"),
                                                 F.col("z").cast("float").alias("_z"), F.col("zwarn").alias("_zwarn"))
    return staged.join(sample, "targetid", "left")


def check_manifest_agreement(staged: DataFrame, manifest: DataFrame) -> DataFrame:
    """Split, flags and redshift equal to the manifest's sample rows."""
    return verdict("manifest_agreement", with_manifest(staged, manifest).agg(*_named(_agreement_counts())))


def _agreement_counts() -> dict[str, Column]:
    known = F.col("_split").isNotNull()

    def differs(a: str, b: str) -> Column:
        return F.count_if(known & ~F.col(a).eqNullSafe(F.col(b)))

    return {"absent": F.count_if(~known), "split": differs("split", "_split"), "has_z": differs("has_z", "_has_z"),
            "has_wise": differs("has_wise", "_has_wise"), "redshift": differs("redshift", "_z")}


def values_per_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): how many different values a key has."""
    return df.groupBy(key).agg(F.count_distinct(value).alias(name))


def check_detections(manifest: DataFrame) -> DataFrame:
    """No detection reaches two splits."""
    per = values_per_key(manifest.filter("in_sample"), "ero_detuid", "split", "_n")
    return verdict("detections_in_one_split", per.agg(F.count_if(F.col("_n") > 1).alias("detections")))


def check_content(staged: DataFrame, manifest: DataFrame) -> DataFrame:
    """Finite non-zero images, usable spectra, the redshift rule, plausible redshifts; one pass over the arrays."""
    return verdict("content", with_manifest(staged, manifest).agg(*_named(_content_counts())))


def _content_counts() -> dict[str, Column]:
    bad_flux = F.exists(F.arrays_zip("spectra", "spectra_ivar"), lambda p: (p["spectra_ivar"] > 0) & ~is_finite(p["spectra"]))
    bad_ivar = F.exists("spectra_ivar", lambda v: ~is_finite(v) | (v < 0))
    z = F.col("redshift")
    return {"image_not_finite": F.count_if(~all_finite("image_flux")), "image_all_zero": F.count_if(~any_nonzero("image_flux")),
            "bad_ivar": F.count_if(bad_ivar), "bad_flux": F.count_if(bad_flux), "has_z_rule": F.count_if(has_redshift(z, "_zwarn") != F.col("has_z")),
            "implausible_redshift": F.count_if(~is_finite(z) | (F.abs(z) >= 10))}


def check_rows(staged: DataFrame, manifest: DataFrame, grid: Grid, size: int, params: SplitParams = SplitParams()) -> dict[str, DataFrame]:
    """The checks schema, split_sizes, manifest_agreement and content from one pass over the staged rows, joined once with the manifest.

    The pass runs when this is called; the checks read its one row of counts.
    """
    groups = {"schema": _shape_counts(grid, size), "manifest_agreement": _agreement_counts(), "content": _content_counts()}
    counts = [c for name, group in groups.items() for c in _named(group, f"{name}__")]
    totals = settle(with_manifest(staged, manifest).agg(*_split_counts(params), *counts))
    checks = {name: verdict(name, totals.select(*[F.col(f"{name}__{n}").alias(n) for n in group])) for name, group in groups.items()}
    return checks | {"split_sizes": verdict("split_sizes", totals.select(*_sizes_off(params)))}


def check_labels(staged: DataFrame, labels: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns present and a label row for every staged target."""
    lacking = [c for c in ["targetid", *required] if c not in labels.columns]
    if lacking:
        return fact(staged.sparkSession, "labels", [f"lacks {c}" for c in lacking])
    absent = staged.select("targetid").join(labels.select("targetid"), "targetid", "left_anti")
    return verdict("labels", absent.agg(F.count(F.lit(1)).alias("without_label")))


def staged_label_counts(staged: DataFrame, labels: DataFrame, columns: Sequence[str] = COUNTED_LABELS) -> DataFrame:
    """(label, finite) over the staged targets, one label row per target."""
    rows = labels.join(staged.select("targetid"), "targetid", "left_semi").dropDuplicates(["targetid"])
    return rows.agg(*[F.count_if(is_finite(c)).alias(c) for c in columns]).unpivot([], list(columns), "label", "finite")
