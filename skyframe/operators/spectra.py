"""Spectra in array columns: scan by target, coaddition on a grid, merge of copies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions.spectra import count_positive
from skyframe.operators.joins import best_per_key
from skyframe.params import Grid
from skyframe.session import spread

SHARD_KEYS = ("survey", "program", "healpix")


def wanted_spectra(camera: DataFrame, targets: DataFrame) -> DataFrame:
    """Camera rows of the wanted targets; the shard keys in the join prune partitions of the store."""
    keys = [*SHARD_KEYS, "targetid"]
    return camera.join(targets.select(*keys), keys, "left_semi")


def _sums_of_rows(keys: Sequence[str], grid: Grid):
    """In a task: per key of a batch the weighted sums of its pixels between the first and the last bin that it touches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[tuple, list[np.ndarray]] = {}
            for key, wave, flux, ivar in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf["wave"], pdf["flux"], pdf["ivar"]):
                if wave is None or flux is None or ivar is None:
                    continue
                n = max(len(wave), len(flux), len(ivar))
                w, f, v = (np.pad(np.asarray(x, dtype=float), (0, n - len(x)), constant_values=np.nan) for x in (wave, flux, ivar))
                place = np.rint((w - grid.lam0) / grid.dlam)
                on = np.isfinite(place) & (place >= 0) & (place < grid.nbin)
                good = np.isfinite(f) & np.isfinite(v) & (v > 0)
                at = place[on].astype(np.int64)
                sums = held.setdefault(key, [np.zeros(grid.nbin), np.zeros(grid.nbin), np.zeros(grid.nbin, dtype=bool)])
                sums[0] += np.bincount(at, np.where(good, f * v, 0.0)[on], grid.nbin)
                sums[1] += np.bincount(at, np.where(good, v, 0.0)[on], grid.nbin)
                sums[2][at] = True
            rows = []
            for key, (num, den, touched) in held.items():
                if touched.any():
                    bins = np.flatnonzero(touched)
                    rows.append((*key, int(bins[0]), num[bins[0]:bins[-1] + 1], den[bins[0]:bins[-1] + 1]))
            yield pd.DataFrame(rows, columns=[*keys, "first", "num", "den"])

    return run


def _merged_sums(keys: Sequence[str], grid: Grid):
    """In a task over rows sorted by key: add up the sums of a key, however many rows hold them, and divide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, num, den = None, np.zeros(grid.nbin), np.zeros(grid.nbin)

        def spectrum() -> tuple:
            flux = np.divide(num, den, out=np.zeros(grid.nbin), where=den > 0)
            return (*key, flux.astype(np.float32), den.astype(np.float32))

        for pdf in batches:
            rows = []
            for own, first, n, d in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf["first"], pdf["num"], pdf["den"]):
                if own != key:
                    if key is not None:
                        rows.append(spectrum())
                    key, num, den = own, np.zeros(grid.nbin), np.zeros(grid.nbin)
                num[first:first + len(n)] += n
                den[first:first + len(d)] += d
            yield pd.DataFrame(rows, columns=[*keys, "flux", "ivar"])
        if key is not None:
            yield pd.DataFrame([spectrum()], columns=[*keys, "flux", "ivar"])

    return run


def coadd(camera: DataFrame, grid: Grid, keys: Sequence[str] = (*SHARD_KEYS, "targetid")) -> DataFrame:
    """One spectrum per key on the grid: inverse-variance mean flux and summed ivar, zero where empty.

    A pixel counts only with a finite flux and a positive finite ivar; keys without a pixel on the grid are left out. Sums of arrays are formed
    before the only shuffle and added up in sorted order after it, so a task holds one spectrum whatever the number of exposures.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {camera.schema[k].dataType.simpleString()}" for k in keys)
    rows = camera.select(*keys, "wave", "flux", "ivar")
    parts = rows.mapInPandas(_sums_of_rows(keys, grid), f"{kinds}, first int, num array<double>, den array<double>")
    return spread(parts, *keys).sortWithinPartitions(*keys).mapInPandas(_merged_sums(keys, grid), f"{kinds}, flux array<float>, ivar array<float>")


def with_shard(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("shard", F.concat_ws("__", *[F.col(k).cast("string") for k in SHARD_KEYS]))


def merge_best(spectra: DataFrame) -> DataFrame:
    """One spectrum per target: the copy with the most positive-ivar pixels, ties to the first shard name.

    One pass over the copies: each task keeps its best one per target before the shuffle.
    """
    copies = with_shard(spectra).select("targetid", "shard", count_positive("ivar").alias("n_good"), "flux", "ivar")
    return best_per_key(copies, ["targetid"], [F.col("n_good").desc(), F.col("shard")])


def merge_counts(spectra: DataFrame) -> DataFrame:
    out = with_shard(spectra).agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("rows"),
                                  F.count_distinct("targetid").alias("unique_targets"))
    return out.withColumn("duplicates_dropped", F.col("rows") - F.col("unique_targets"))


def group_status(planned: DataFrame, fetched: DataFrame, absent: DataFrame) -> DataFrame:
    """Status of each planned group: done, absent or todo. Stands in for empty shards, which Spark does not write."""
    keys = list(SHARD_KEYS)
    done = fetched.select(*keys).distinct().withColumn("_done", F.lit(True))
    gone = absent.select(*keys).distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_done"), "done").when(F.col("_gone"), "absent").otherwise("todo")
    return planned.select(*keys).distinct().join(done, keys, "left").join(gone, keys, "left").select(*keys, status.alias("status"))
