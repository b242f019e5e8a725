"""Scores of predictive densities: quadrature likelihoods, information gain, R2, coverage."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import computed_once
from skyframe.functions.poisson import log_sum_exp, pinned_axis, prior_axis, rate_axis
from skyframe.operators.density import CorrelatedNormal, Density, GaussianKDE
from skyframe.operators.linear import JointHead
from skyframe.operators.rank import small_group_quantiles
from skyframe.operators.sample import Standardizer, scorable, subset_names, target_value
from skyframe.params import (
    COVERAGE_LEVELS, MASS_NODES, MASS_SPAN, QUADRATURE_NODES, QUADRATURE_SPAN, TARGETS, Head,
)
from skyframe.session import settle, spread

MAX_NODES = 262_144


def _grid_sums(score, d: int):
    """Task-side sum over the product grid: axis columns in, one log marginal per row out.

    A further column, if given, holds the point that each row's density is centred on.
    """

    def marginal(*parts: pd.Series) -> pd.Series:
        nodes, spacing, like = parts[:d], parts[d:2 * d], parts[2 * d:3 * d]
        centre = np.stack(parts[3 * d]) if len(parts) > 3 * d and len(parts[0]) else None
        sizes = np.column_stack([[-1 if n is None else len(n) for n in axis] for axis in nodes])
        out = np.full(len(sizes), np.nan)
        for shape in np.unique(sizes, axis=0):
            if (shape < 1).any():
                continue
            rows = np.flatnonzero((sizes == shape).all(axis=1))
            step = max(1, MAX_NODES // int(shape.prod()))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                grid, terms = [], np.zeros((len(some), *shape))
                for i in range(d):
                    view = [len(some)] + [1] * d
                    view[i + 1] = shape[i]
                    grid.append(np.broadcast_to(np.stack(nodes[i].iloc[some]).reshape(view), terms.shape).ravel())
                    terms = terms + np.stack(like[i].iloc[some]).reshape(view)
                points = np.column_stack(grid)
                if centre is not None:
                    points = points - np.repeat(centre[some], len(points) // len(some), axis=0)
                terms = terms.reshape(len(some), -1) + score(points).reshape(len(some), -1)
                top = terms.max(axis=1)
                jacobian = sum(s.iloc[some].to_numpy(float) for s in spacing)
                out[some] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1)) + jacobian
        return pd.Series(out).where(np.isfinite(out), None)

    return marginal


def log_marginal(df: DataFrame, axes: Sequence[Column], density: Density, name: str) -> DataFrame:
    """Add the log of the density times the count likelihood, integrated over the product of the axes.

    Axes are short arrays built by expressions. Under a density in closed form only they cross to the task-side sum, and the product grid never
    leaves a batch. Under a kernel density the nodes become rows, which are scored by its joins, equal nodes once, and summed up per row.
    """
    held = computed_once(df, {f"_axis{i}": a for i, a in enumerate(axes)})
    parts = [F.col(f"_axis{i}.{field}") for field in ("nodes", "spacing", "like") for i in range(len(axes))]
    if isinstance(density, GaussianKDE):
        return _summed_over_nodes(held, parts, len(axes), density, name).drop(*[f"_axis{i}" for i in range(len(axes))])
    sums = F.pandas_udf(_grid_sums(density.of_points(), len(axes)), "double")
    return held.withColumn(name, sums(*parts)).drop(*[f"_axis{i}" for i in range(len(axes))])


def _summed_over_nodes(held: DataFrame, parts: Sequence[Column], d: int, density: Density, name: str) -> DataFrame:
    """The quadrature of `log_marginal` with one row per node; a row's nodes, a product of short axes, meet again as one array."""
    rows = settle(held.withColumn("_rid", F.monotonically_increasing_id()))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes, spacing, like = (pdf.iloc[:, 1 + k * d:1 + (k + 1) * d] for k in range(3))
            sizes = np.column_stack([[-1 if n is None else len(n) for n in nodes.iloc[:, i]] for i in range(d)])
            for shape in np.unique(sizes, axis=0):
                if (shape < 1).any():
                    continue
                rows = np.flatnonzero((sizes == shape).all(axis=1))
                step = max(1, MAX_NODES // int(shape.prod()))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    views = [[len(some)] + [int(shape[i]) if k == i else 1 for k in range(d)] for i in range(d)]
                    grid = {f"_u{i}": np.broadcast_to(np.stack(nodes.iloc[some, i]).reshape(views[i]), (len(some), *shape)).ravel() for i in range(d)}
                    terms = sum(np.stack(like.iloc[some, i]).reshape(views[i]) for i in range(d)) + spacing.iloc[some].to_numpy(float).sum(axis=1).reshape([-1] + [1] * d)
                    yield pd.DataFrame({"_rid": np.repeat(pdf.iloc[some, 0].to_numpy(), int(shape.prod())), **grid,
                                        "_term": np.broadcast_to(terms, (len(some), *shape)).ravel()})

    kinds = "_rid long, " + ", ".join(f"_u{i} double" for i in range(d)) + ", _term double"
    nodes = spread(rows.select("_rid", *[p.alias(f"_p{i}") for i, p in enumerate(parts)]), "_rid").mapInPandas(expand, kinds)
    scored = density.scored(nodes, [F.col(f"_u{i}") for i in range(d)], "_lp")
    sums = scored.groupBy("_rid").agg(log_sum_exp(F.collect_list(F.col("_term") + F.col("_lp"))).alias(name))
    return rows.drop(name).join(sums, "_rid", "left").drop("_rid")


def head_axis(target: str, standardizer: Standardizer, nodes: int, span: float) -> Column:
    """The axis of one target of each row: pinned where a scalar is observed, recentred where a rate is, else the prior grid."""
    columns = TARGETS[target].columns
    if TARGETS[target].is_rate:
        seen = rate_axis(*columns, standardizer.mean[target], standardizer.scale[target], nodes, span)
    else:
        seen = pinned_axis(standardizer.encode(target, F.col(columns[0])))
    return F.when(F.col(f"{target}_ok"), seen).otherwise(prior_axis(nodes, span))


def head_log_likelihood(masked: DataFrame, head: Head, standardizer: Standardizer, density: Density,
                        name: str = "ll", nodes: int = QUADRATURE_NODES, span: float = QUADRATURE_SPAN) -> DataFrame:
    """Add the log likelihood of a head's targets; NULL on rows the head is not scored on.

    `masked` carries the label columns and `<target>_ok`. Rows of every observation pattern are handled
    in one pass, each with its own axes.
    """
    axes = [F.when(scorable(head), head_axis(t, standardizer, nodes, span)) for t in head.targets]
    return log_marginal(masked, axes, density, name)


def joint_log_likelihood(masked: DataFrame, head: Head, standardizer: Standardizer, features: Sequence[str], fits: Sequence[JointHead],
                         key: str = "source_id", keep: Sequence[str] = (), nodes: int = QUADRATURE_NODES, span: float = QUADRATURE_SPAN) -> DataFrame:
    """(key, keep..., head, subset, ll): a head of several targets, or of a rate, under every combination of inputs.

    The axes are built once per row; a task integrates them under each combination's density around the row's own regression.
    """
    d = len(head.targets)
    axes = {f"_axis{i}": F.when(scorable(head), head_axis(t, standardizer, nodes, span)) for i, t in enumerate(head.targets)}
    held = computed_once(masked, axes | {"_x": F.array(*[F.col(f).cast("double") for f in features])})
    parts = [F.col(f"_axis{i}.{field}") for field in ("nodes", "spacing", "like") for i in range(d)]
    models = [(np.array(f.coefficients), _grid_sums(CorrelatedNormal(f.covariance).of_points(), d)) for f in fits]

    @F.pandas_udf("array<double>")
    def every(*columns: pd.Series) -> pd.Series:
        *grid, x = columns
        rows = np.column_stack([np.ones(len(x)), np.stack(x) if len(x) else np.empty((0, len(features)))])
        found = [marginal(*grid, pd.Series(list(rows @ beta.T))) for beta, marginal in models]
        return pd.Series([list(v) for v in zip(*found)], dtype=object)

    scored = held.withColumn("_ll", every(*parts, "_x"))
    entries = F.arrays_zip(F.array(*[F.lit(f.subset) for f in fits]).alias("subset"), F.col("_ll").alias("ll"))
    out = scored.select(key, *keep, F.explode(entries).alias("_e"))
    return out.select(key, *keep, F.lit(head.name).alias("head"), "_e.subset", "_e.ll")


def fit_prior(labels: DataFrame, head: Head, standardizer: Standardizer, bandwidth: float = 1.0) -> GaussianKDE:
    """Kernel density over the training rows that carry every target of the head, in standardized units."""
    train = labels.filter("split = 'train'")
    values = [standardizer.encode(t, target_value(t)).alias(t) for t in head.targets]
    return GaussianKDE.fit(train.select(*values), list(head.targets), bandwidth)


def quadrature_sweep(masked: DataFrame, head: Head, standardizer: Standardizer, density: Density,
                     nodes: Sequence[int] = (12, 24, 48)) -> DataFrame:
    """Mean log likelihood at several node counts: (nodes, n, mean_ll)."""
    parts = [head_log_likelihood(masked, head, standardizer, density, "ll", k)
             .agg(F.count("ll").alias("n"), F.avg("ll").alias("mean_ll")).withColumn("nodes", F.lit(k)) for k in nodes]
    return reduce(DataFrame.unionByName, parts)


def bandwidth_sweep(train: DataFrame, points: DataFrame, columns: Sequence[str], bandwidths: Sequence[float]) -> DataFrame:
    """Mean log density of the points under several bandwidths: (bandwidth, n, mean_log_prob)."""
    parts = []
    for b in bandwidths:
        scored = GaussianKDE.fit(train, columns, b).scored(points.select(*columns), [F.col(c) for c in columns], "_l")
        parts.append(scored.agg(F.count("_l").alias("n"), F.avg("_l").alias("mean_log_prob")).withColumn("bandwidth", F.lit(float(b))))
    return reduce(DataFrame.unionByName, parts)


# ---- scores over (source_id, head, subset, ll, prior, common)

def information_gain(scores: DataFrame) -> DataFrame:
    """Mean of ll - prior on common rows, per head and combination."""
    return (scores.filter("common").groupBy("head", "subset")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ll") - F.col("prior")).alias("information_gain")))


def wide_scores(scores: DataFrame, heads: Sequence[str]) -> DataFrame:
    """One row per source with a `ll_<head>_<subset>` column for each pair."""
    picks = [F.max(F.when((F.col("head") == h) & (F.col("subset") == s), F.col("ll"))).alias(f"ll_{h}_{s}")
             for h in heads for s in subset_names()]
    return scores.groupBy("source_id").agg(*picks)


def score_grid(gains: DataFrame, heads: Sequence[str], values: Sequence[str] = ("information_gain",)) -> DataFrame:
    """One row per combination in size order, one column per head and value."""
    from skyframe.operators.sample import subset_ordinal
    picks = [F.max(v).alias(v) for v in values]
    if len(values) == 1:
        wide = gains.groupBy("subset").pivot("head", list(heads)).agg(picks[0])
        wide = wide.withColumnsRenamed({h: f"{h}_{values[0]}" for h in heads})
    else:
        wide = gains.groupBy("subset").pivot("head", list(heads)).agg(*picks)
    return wide.withColumn("ordinal", subset_ordinal("subset"))


def incomplete_heads(gains: DataFrame, heads: Sequence[str]) -> DataFrame:
    """Heads that lack a row for some combination: (head, missing)."""
    expected = gains.sparkSession.createDataFrame([(h,) for h in heads], "head string")
    seen = gains.groupBy("head").agg(F.count_distinct("subset").alias("_n"))
    missing = F.lit(len(subset_names())) - F.coalesce("_n", F.lit(0))
    return expected.join(seen, "head", "left").select("head", missing.alias("missing")).filter("missing > 0")


def ranked_combinations(gains: DataFrame, head: str, baseline: float | Column) -> DataFrame:
    """Combinations of one head by rising gain, beside a baseline level."""
    level = F.lit(baseline) if isinstance(baseline, float) else baseline
    return (gains.filter(F.col("head") == head).orderBy("information_gain", "subset")
            .select("subset", "information_gain", level.alias("baseline"), (F.col("information_gain") > level).alias("above")))


def r_squared(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - residual over total sum of squares per group; NULL where the truth has no spread."""
    residual = F.sum(F.pow(F.col(truth) - F.col(predicted), F.lit(2.0)))
    total = F.var_pop(truth) * F.count(truth)
    return df.groupBy(*by).agg(F.count(truth).alias("n"), F.when(total > 0, 1 - residual / F.when(total > 0, total)).alias("r2"))


def interval_coverage(draws: DataFrame, truths: DataFrame, key: str, draw: str, truth: str,
                      levels: Sequence[float] = COVERAGE_LEVELS) -> DataFrame:
    """(level, n, coverage): share of truths inside the central interval of their own draws."""
    named = {}
    for i, level in enumerate(levels):
        named |= {f"lo{i}": (1 - level) / 2, f"hi{i}": (1 + level) / 2}
    edges = small_group_quantiles(draws, draw, named, [key]).drop("n")
    joined = truths.select(key, truth).join(edges, key)
    inside = [F.struct(F.lit(float(level)).alias("level"),
                       ((F.col(truth) >= F.col(f"lo{i}")) & (F.col(truth) <= F.col(f"hi{i}"))).alias("inside")) for i, level in enumerate(levels)]
    return (joined.select(F.explode(F.array(*inside)).alias("_e")).groupBy(F.col("_e.level").alias("level"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_e.inside").cast("double")).alias("coverage")))


def predicted_coverage(predictions: DataFrame, by: Sequence[str], levels: Sequence[float] = COVERAGE_LEVELS) -> DataFrame:
    """(by..., level, n, coverage): share of truths inside the central interval of their predictive normal (columns truth, mean, sigma)."""
    gap = F.abs(F.col("truth") - F.col("mean"))
    entries = F.array(*[F.struct(F.lit(float(v)).alias("level"), (gap <= F.col("sigma") * NormalDist().inv_cdf((1 + v) / 2)).alias("inside")) for v in levels])
    return predictions.select(*by, F.explode(entries).alias("_e")).groupBy(*by, F.col("_e.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_e.inside").cast("double")).alias("coverage"))


def validation_metric(scores: DataFrame) -> DataFrame:
    """Unweighted mean over heads of the mean negative log likelihood on scorable rows."""
    heads = scores.filter("ll IS NOT NULL").groupBy("head").agg(F.avg(-F.col("ll")).alias("_nll"))
    return heads.agg(F.count(F.lit(1)).alias("heads"), F.avg("_nll").alias("metric"))


# ---- specific star-formation rate from the pair

def specific_rate_densities(df: DataFrame, s: str, standardizer: Standardizer, joint: Density, sfr: Density, mstar: Density,
                            nodes: int = MASS_NODES) -> DataFrame:
    """Add `log_p_joint` and `log_p_independent`: ln p(log SFR - log M*) under the pair, and under its two margins.

    The density of the difference is the integral over mass of the pair's density along the line that
    keeps the difference fixed.
    """
    mean, scale = standardizer.mean, standardizer.scale
    step = 2 * MASS_SPAN / (nodes - 1)
    rows = settle(df.withColumn("_rid", F.monotonically_increasing_id()))
    mass = F.explode(F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda i: F.lit(-float(MASS_SPAN)) + i * step))
    rate = (F.col(s) + F.col("_m") * scale["mstar"] + mean["mstar"] - mean["sfr"]) / scale["sfr"]
    points = spread(rows.select("_rid", s), "_rid").filter(F.col(s).isNotNull()).withColumn("_m", mass).withColumn("_r", rate).select("_rid", "_m", "_r")
    scored = joint.scored(points, [F.col("_r"), F.col("_m")], "_pair")
    scored = mstar.scored(sfr.scored(scored, [F.col("_r")], "_first"), [F.col("_m")], "_second")
    shift = math.log(step) - math.log(scale["sfr"])
    sums = scored.groupBy("_rid").agg((log_sum_exp(F.collect_list("_pair")) + shift).alias("log_p_joint"),
                                      (log_sum_exp(F.collect_list(F.col("_first") + F.col("_second"))) + shift).alias("log_p_independent"))
    return rows.join(sums, "_rid", "left").select(*df.columns, "log_p_joint", "log_p_independent")


def specific_rate_gain(densities: DataFrame) -> DataFrame:
    """n, both means, and the gain of the pair over its margins in nats with its standard error, over rows where both are known."""
    gain = F.col("log_p_joint") - F.col("log_p_independent")
    known = densities.filter(gain.isNotNull() & ~F.isnan(gain))
    return known.agg(F.count(F.lit(1)).alias("n"), F.avg("log_p_joint").alias("mean_joint"), F.avg("log_p_independent").alias("mean_independent"),
                     F.avg(gain).alias("gain"), (F.stddev_samp(gain) / F.sqrt(F.count(F.lit(1)))).alias("gain_se"))
