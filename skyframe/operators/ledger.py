"""Ordered ledger of row cuts, and the record a job writes about itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("step", T.StringType()),
    T.StructField("written_utc", T.StringType()),
    T.StructField("config_sha256", T.StringType()),
    T.StructField("inputs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("filters", T.ArrayType(T.StructType([
        T.StructField("ord", T.IntegerType()),
        T.StructField("filter", T.StringType()),
        T.StructField("kept", T.LongType()),
        T.StructField("dropped", T.LongType()),
        T.StructField("note", T.StringType()),
    ]))),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])


def counts_to_ledger(totals: DataFrame, first: str, cuts: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Turn one row of counts into ledger rows (ord, filter, kept, dropped, note).

    `first` names the count before any cut; each cut is (name, count column, note).
    """
    before = first
    rows = []
    for i, (name, column, note) in enumerate(cuts, 1):
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("filter"),
                             F.col(column).cast("long").alias("kept"),
                             (F.col(before) - F.col(column)).cast("long").alias("dropped"),
                             F.lit(note).cast("string").alias("note")))
        before = column
    return totals.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def cut_ledger(df: DataFrame, cuts: Sequence[tuple[str, Column]], notes: dict[str, str] | None = None) -> DataFrame:
    """Apply cuts in order and report what each kept and dropped, in one pass over the rows.

    A row counts as kept by a cut when it passes that cut and all earlier ones; NULL does not pass.
    """
    notes = notes or {}
    passed: list[Column] = []
    so_far = F.lit(True)
    for _, keep in cuts:
        so_far = so_far & F.coalesce(keep, F.lit(False))
        passed.append(so_far)
    totals = df.agg(F.count(F.lit(1)).alias("n_in"), *[F.count_if(c).alias(f"kept_{i}") for i, c in enumerate(passed)])
    return counts_to_ledger(totals, "n_in", [(name, f"kept_{i}", notes.get(name)) for i, (name, _) in enumerate(cuts)])


def apply_cuts(df: DataFrame, cuts: Sequence[tuple[str, Column]]) -> DataFrame:
    return reduce(lambda d, cut: d.filter(cut[1]), cuts, df)


def ledger_record(step: str, counts: DataFrame, filters: DataFrame | None = None,
                  inputs: dict[str, str] | None = None, extra: dict[str, str] | None = None,
                  config_sha256: str = "") -> DataFrame:
    """One nested record of a step: its inputs, counts (name, value), ordered filters and extras."""
    from skyframe.functions.core import utc_seconds

    named = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("name"), F.col("value").cast("long"))))).alias("counts"))
    if filters is None:
        steps = named.select(F.array().cast(LEDGER_SCHEMA["filters"].dataType).alias("filters"))
    else:
        steps = filters.agg(F.sort_array(F.collect_list(
            F.struct("ord", "filter", "kept", "dropped", "note"))).alias("filters"))
    record = named.join(F.broadcast(steps))  # one row each
    return record.select(F.lit(step).alias("step"), utc_seconds().alias("written_utc"),
                         F.lit(config_sha256).alias("config_sha256"), _map(inputs).alias("inputs"),
                         "counts", "filters", _map(extra).alias("extra"))


def _map(values: dict[str, str] | None) -> Column:
    pairs = [F.lit(v) for item in sorted((values or {}).items()) for v in item]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def named_counts(totals: DataFrame) -> DataFrame:
    """One row of counts as (name, value) rows."""
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in totals.columns]
    return totals.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
