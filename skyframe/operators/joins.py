"""Joins with the failure rules of the jobs: strict lookups, existence flags, best rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


class DataError(RuntimeError):
    """The input breaks a rule the job relies on."""


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    found = [tuple(r)[:-1] for r in repeated_keys(df, keys).orderBy(*keys).limit(5).collect()]
    if found:
        raise DataError(f"{what}: {', '.join(keys)} is not unique (first: {found})")


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of `left` that `right` lacks."""
    return left.select(*keys).join(right.select(*keys), list(keys), "left_anti").distinct()


def strict_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Inner join where every left key must exist in `right`, exactly once.

    Spark takes an array for one element when it guesses sizes, so spectra worked out from a small table would be broadcast. Where `right` holds
    arrays, the left rows of a partition are hashed and the right ones stream past them, neither sorted nor sent to the driver.
    """
    require_unique(right, keys, what)
    missing = missing_keys(left, right, keys)
    examples = [tuple(r) for r in missing.orderBy(*keys).limit(5).collect()]
    if examples:
        raise DataError(f"{what}: {missing.count()} keys are absent (first: {examples})")
    arrays = any(isinstance(f.dataType, ArrayType) for f in right.schema)
    return (left.hint("shuffle_hash") if arrays else left).join(right, list(keys), "inner")


def two_hop_lookup(staged: DataFrame, manifest: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Label columns of staged targets through the manifest's detection; both hops are strict, and both must agree on the split."""
    own = staged.select("targetid", F.col("split").alias("_staged_split"))
    hop = strict_lookup(own, manifest.select("targetid", "ero_detuid", "split"), ["targetid"], "manifest")
    if not hop.filter(~F.col("split").eqNullSafe(F.col("_staged_split"))).isEmpty():
        raise DataError("the manifest puts staged rows in another split")
    out = strict_lookup(hop.drop("_staged_split"), labels.select("ero_detuid", *columns), ["ero_detuid"], "labels")
    return out.select("targetid", "ero_detuid", "split", *columns)


def with_membership(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean saying whether the key occurs in `members`."""
    known = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    Filtering row_number on 1 lets Spark keep one row per key in each map task before the shuffle
    (WindowGroupLimit), so a key that holds a large share of the rows does not reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")


def best_host_fit(fits: DataFrame, observed: DataFrame) -> DataFrame:
    """One fit per observed target: same observation, then main survey, then the lowest chi2.

    `observed` has one (targetid, survey, program) per target. Remaining ties fall to the fit's own columns.
    Fits are first cut to the best one per (target, survey, program), before any join, so a target with a
    great many fits sends only a handful of rows on.
    """
    rest = [F.col(c).asc_nulls_last() for c in sorted(set(fits.columns) - {"targetid", "chi2"})]
    few = best_per_key(fits, ["targetid", "survey", "program"], [F.col("chi2").asc_nulls_last(), *rest])
    seen = observed.select("targetid", F.col("survey").alias("_survey"), F.col("program").alias("_program"))
    joined = few.join(seen, "targetid", "inner")
    same = F.coalesce((F.col("survey") == F.col("_survey")) & (F.col("program") == F.col("_program")), F.lit(False))
    order = [same.desc(), F.coalesce(F.col("survey") == "main", F.lit(False)).desc(),
             F.col("chi2").asc_nulls_last(), *rest]
    return best_per_key(joined, ["targetid"], order).drop("_survey", "_program")
