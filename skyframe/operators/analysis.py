"""Post-processing of scores and draws: gains by modality, hardness, within-object correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.operators.rank import bootstrap_se, exact_quantiles, rolling_band, rolling_bands, rolling_mean, small_group_quantiles
from skyframe.operators.sample import Standardizer
from skyframe.operators.scoring import information_gain
from skyframe.params import BOOTSTRAP_REPLICATES, NEARBY_REDSHIFT, RHO_BIN, ROLLING_WINDOW


def combination_table(scores: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, seed: int = 0) -> DataFrame:
    """Information gain and its bootstrap error for every head and combination."""
    gains = scores.filter("common").withColumn("_gain", F.col("ll") - F.col("prior"))
    errors = bootstrap_se(gains, "_gain", "source_id", ["head", "subset"], replicates, seed)
    return information_gain(scores).join(errors.drop("n"), ["head", "subset"], "left")


def source_gains(scores: DataFrame, head: str) -> DataFrame:
    """Per common source: ll(Z) - prior, and ll(Z+m) - ll(Z) for each other modality."""
    mine = scores.filter(F.col("common") & (F.col("head") == head))

    def pick(subset: str) -> Column:
        return F.max(F.when(F.col("subset") == subset, F.col("ll")))

    wide = mine.groupBy("source_id").agg(pick("Z").alias("_z"), pick("ZS").alias("_s"), pick("ZI").alias("_i"), pick("ZW").alias("_w"),
                                         F.max("prior").alias("_prior"), F.max("redshift").alias("redshift"))
    z = F.col("_z")
    return wide.select("source_id", "redshift", (z - F.col("_prior")).alias("redshift_alone"), (F.col("_s") - z).alias("S"),
                       (F.col("_i") - z).alias("I"), (F.col("_w") - z).alias("W"))


def modality_gains(scores: DataFrame, head: str = "lx", replicates: int = BOOTSTRAP_REPLICATES, seed: int = 0) -> DataFrame:
    """(modality, n, pooled, se, attributed_fraction), with redshift alone as modality Z."""
    gains = source_gains(scores, head)
    long = gains.unpivot(["source_id"], ["redshift_alone", "S", "I", "W"], "modality", "gain")
    long = long.withColumn("modality", F.when(F.col("modality") == "redshift_alone", "Z").otherwise(F.col("modality")))
    pooled = long.groupBy("modality").agg(F.avg("gain").alias("pooled"))
    errors = bootstrap_se(long, "gain", "source_id", ["modality"], replicates, seed)
    total = pooled.filter("modality <> 'Z'").agg(F.sum("pooled").alias("_total"))
    out = pooled.join(errors, "modality").join(F.broadcast(total))  # one row
    share = F.when((F.col("modality") != "Z") & (F.col("_total") != 0), F.col("pooled") / F.when(F.col("_total") != 0, F.col("_total")))
    return out.select("modality", "n", "pooled", "se", share.alias("attributed_fraction"))


def gain_trend(gains: DataFrame, modality: str, window: float = ROLLING_WINDOW) -> DataFrame:
    """Rolling mean of one modality's gain by redshift."""
    return rolling_mean(gains, "redshift", modality, "source_id", window)


def gain_band(gains: DataFrame, modality: str, window: float = ROLLING_WINDOW, replicates: int = BOOTSTRAP_REPLICATES,
              seed: int = 0) -> DataFrame:
    return rolling_band(gains, "redshift", modality, "source_id", window, replicates, seed)


def gain_bands(gains: DataFrame, modalities: Sequence[str], window: float = ROLLING_WINDOW, replicates: int = BOOTSTRAP_REPLICATES,
               seed: int = 0) -> dict[str, DataFrame]:
    """`gain_band` of several modalities, which share the order of redshifts and the weights."""
    return rolling_bands(gains, "redshift", modalities, "source_id", window, replicates, seed)


# ---- posterior draws: rows (source_id, u0 = rate_p2, u1 = rate_p3, u2 = sfr, u3 = mstar)

def hardness_ratio(soft: Column, hard: Column) -> Column:
    total = hard + soft
    return F.when(total != 0, (hard - soft) / F.when(total != 0, total))


def decoded(draws: DataFrame, targets: Sequence[str], standardizer: Standardizer, columns: Sequence[str]) -> DataFrame:
    """Draws in natural units: rates as rates, not logs."""
    out = {}
    for t, c in zip(targets, columns):
        natural = standardizer.decode(t, F.col(c))
        out[t] = F.pow(F.lit(10.0), natural) if t.startswith("rate_") else natural
    return draws.withColumns(out)


def posterior_means(draws: DataFrame, columns: Sequence[str]) -> DataFrame:
    return draws.groupBy("source_id").agg(*[F.avg(c).alias(c) for c in columns])


def with_hardness(draws: DataFrame, standardizer: Standardizer) -> DataFrame:
    natural = decoded(draws, ["rate_p2", "rate_p3", "sfr", "mstar"], standardizer, ["u0", "u1", "u2", "u3"])
    return natural.select("source_id", hardness_ratio(F.col("rate_p2"), F.col("rate_p3")).alias("hr"),
                          (F.col("sfr") - F.col("mstar")).alias("log_ssfr"))


def within_object_correlation(draws: DataFrame, standardizer: Standardizer) -> DataFrame:
    """(source_id, draws, rho): Pearson correlation of hardness and log sSFR over each source's draws.

    NULL when either has no spread. Moments combine before the shuffle, however many draws a source has.
    """
    pairs = with_hardness(draws, standardizer)
    spread = F.sqrt(F.var_pop("hr") * F.var_pop("log_ssfr"))
    return pairs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("draws"),
        F.when(spread > 0, F.covar_pop("hr", "log_ssfr") / F.when(spread > 0, spread)).alias("rho"))


def population_shares(rho: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, seed: int = 0) -> DataFrame:
    """Summary of rho for galaxies, nearby galaxies, quasars and all; a source may be in several."""
    galaxy = F.col("spectype") == "GALAXY"
    member = F.array(F.lit("all"), F.when(galaxy, "galaxies"), F.when(galaxy & (F.col("redshift") < NEARBY_REDSHIFT), "nearby_galaxies"),
                     F.when(F.col("spectype") == "QSO", "quasars"))
    long = (rho.filter("rho IS NOT NULL").withColumn("population", F.explode(F.filter(member, lambda m: m.isNotNull())))
            .select("population", "source_id", "rho"))
    base = long.groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rho") < 0).cast("double")).alias("fraction_negative"),
                                          F.avg("rho").alias("mean"))
    middle = exact_quantiles(long, "rho", [0.5], ["population"]).select("population", F.col("value").alias("median"))
    errors = bootstrap_se(long, "rho", "source_id", ["population"], replicates, seed).drop("n")
    return base.join(middle, "population").join(errors, "population", "left")


def hardness_summary(draws: DataFrame, standardizer: Standardizer) -> DataFrame:
    """Median and 16/84 % points of the hardness ratio of each source."""
    return small_group_quantiles(with_hardness(draws, standardizer), "hr", {"hr_median": 0.5, "hr_lo": 0.16, "hr_hi": 0.84}, ["source_id"])


def fixed_width_histogram(df: DataFrame, value: str, width: float = RHO_BIN) -> DataFrame:
    """(edge, rows) for bins aligned to multiples of the width, empty bins between the ends included."""
    index = F.floor(F.col(value) / width)
    counts = df.filter(F.col(value).isNotNull()).groupBy(index.alias("_i")).agg(F.count(F.lit(1)).alias("rows"))
    ends = counts.agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    span = ends.select(F.explode(F.sequence("_first", "_last")).alias("_i"))
    return span.join(counts, "_i", "left").select((F.col("_i") * width).alias("edge"), F.coalesce("rows", F.lit(0)).alias("rows"))
