"""Scoring and analysis jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.operators import analysis as an
from skyframe.operators import linear, scoring
from skyframe.operators import sample as sm
from skyframe.operators.density import Density
from skyframe.operators.joins import DataError, strict_lookup
from skyframe.params import COVERAGE_LEVELS, TARGETS, Head, ScoreParams
from skyframe.session import settle

PRESENCE = ("has_z", "has_spectrum", "has_image", "has_wise")


@dataclass
class Evaluation:
    """Scores per (source, head, combination), predictions per scalar target of each head, and their summaries.

    `predictions`: source_id, head, subset, target, mean, truth, sigma, common, in standardized units. A target of a joint head is predicted by its
    margin: the normal around its own regression, whatever the other targets are.
    """

    scores: DataFrame
    standardizer: sm.Standardizer
    predictions: DataFrame
    heads: Sequence[Head]

    def gains(self) -> DataFrame:
        return scoring.information_gain(self.scores)

    def known(self) -> DataFrame:
        return self.predictions.filter("common AND truth IS NOT NULL")

    def r_squared(self) -> DataFrame:
        """(head, subset, target, n, r2) of every scalar target of every head; standardizing does not change it."""
        return scoring.r_squared(self.known(), "truth", "mean", ["head", "subset", "target"])

    def coverage(self, levels: Sequence[float] = COVERAGE_LEVELS) -> DataFrame:
        """(head, target, level, n, coverage) under the full combination: how often central intervals of the predictive normal hold the truth."""
        full = self.known().filter(F.col("subset") == sm.subset_names()[-1])
        return scoring.predicted_coverage(full, ["head", "target"], levels)

    def summary(self) -> DataFrame:
        """One row per head and combination: n, information_gain, and r2_<target> for every scalar target."""
        targets = sorted({t for h in self.heads for t in h.scalars()})
        picks = [F.max(F.when(F.col("target") == t, F.col("r2"))).alias(f"r2_{t}") for t in targets]
        wide = self.r_squared().groupBy("head", "subset").agg(*picks) if picks else None
        return self.gains() if wide is None else self.gains().join(wide, ["head", "subset"], "left")


def require_columns(labels: DataFrame, heads: Sequence[Head]) -> None:
    """Every head's label columns must be there: a head is scored or refused, never left out."""
    absent = {h.name: sorted({c for t in h.targets for c in TARGETS[t].columns} - set(labels.columns)) for h in heads}
    absent = {name: columns for name, columns in absent.items() if columns}
    if absent:
        raise DataError(f"label columns of heads are absent: {absent}")


def evaluate(labels: DataFrame, blocks: dict[str, Sequence[str]], params: ScoreParams = ScoreParams()) -> Evaluation:
    """Score every head on the test split under every combination of inputs.

    `labels` carries split, label columns, presence flags and the feature columns that `blocks` names by modality. A head of one scalar target is
    linear-Gaussian; one of several targets, or of a rate, is normal around its regressions with the residuals' covariance, integrated over what
    is not observed. Each is compared with the kernel prior of its own targets, through the same quadrature. A head whose label columns are absent
    or that can score no row is an error. Scores and predictions are written once as stage tables, since every summary reads them.
    """
    require_columns(labels, params.heads)
    masked = sm.with_masks(labels)
    sm.require_live_heads(sm.scorable_counts(masked.filter("split = 'train'"), params.heads))
    targets = sorted({t for h in params.heads for t in h.targets})
    standardizer = sm.fit_standardizer(labels, targets)
    encoded = masked.withColumns({t: standardizer.encode(t, sm.target_value(t)) for t in targets})
    train, test = encoded.filter("split = 'train'"), encoded.filter("split = 'test'")
    scalar = [h for h in params.heads if len(h.targets) == 1 and h.scalars()]
    joint = [h for h in params.heads if h not in scalar]
    keep = ["redshift", "spectype"]
    results, predictions = [], []
    if scalar:
        fitted = linear.fit_heads(train, blocks, [h.targets[0] for h in scalar])
        known = test.withColumns({f"common_{h.name}": sm.common_rows(h, PRESENCE) for h in scalar})
        for h in scalar:
            known = scoring.fit_prior(labels, h, standardizer, params.bandwidth).scored(known, [F.col(h.targets[0])], f"prior_{h.name}")
        scored = linear.score_heads(known, fitted, "source_id", [*keep, *[f"{p}_{h.name}" for h in scalar for p in ("prior", "common")]])

        def of_head(prefix: str):
            return reduce(lambda c, h: c.when(F.col("head") == h.targets[0], F.col(f"{prefix}_{h.name}")), scalar, F.when(F.lit(False), None))

        told = settle(scored.select("source_id", "head", "subset", "ll", "mean", "truth", "sigma", of_head("prior").alias("prior"), of_head("common").alias("common"), *keep))
        # a scalar head is told apart by its target, which is also the name of its score
        results.append(told.select("source_id", "head", "subset", "ll", "prior", "common", *keep))
        predictions.append(told.select("source_id", "head", "subset", F.col("head").alias("target"), "mean", "truth", "sigma", "common"))
    if joint:
        fits = linear.fit_joint_heads(train, blocks, {h.name: h.targets for h in joint})
        features = [c for names in blocks.values() for c in names]
        for h in joint:
            prior = scoring.fit_prior(labels, h, standardizer, params.bandwidth)
            known = scoring.head_log_likelihood(test.withColumn("common", sm.common_rows(h, PRESENCE)), h, standardizer, prior, "prior", params.nodes, params.span)
            scored = scoring.joint_log_likelihood(known, h, standardizer, features, [f for f in fits if f.head == h.name], "source_id", [*keep, "prior", "common"],
                                                  params.nodes, params.span)
            results.append(scored)
            if h.scalars():
                own = linear.marginal_heads([f for f in fits if f.head == h.name], h.targets, features, h.scalars())
                told = linear.score_heads(test.withColumn("common", sm.common_rows(h, PRESENCE)), own, "source_id", ["common"])
                predictions.append(told.select("source_id", F.lit(h.name).alias("head"), "subset", F.col("head").alias("target"), "mean", "truth", "sigma", "common"))
    none = labels.sparkSession.createDataFrame([], "source_id long, head string, subset string, target string, mean double, truth double, sigma double, common boolean")
    return Evaluation(settle(reduce(DataFrame.unionByName, results)), standardizer, settle(reduce(DataFrame.unionByName, predictions)) if predictions else none,
                      params.heads)


def line_baseline(labels: DataFrame, fluxes: DataFrame, columns: Sequence[str], target: str, standardizer: sm.Standardizer, prior: Density) -> DataFrame:
    """A linear head on measured line fluxes alone: (source_id, ll, mean, truth, prior, common), on the rows that the other heads are scored on.

    Every source needs its fluxes. They are standardized on the training split.
    """
    head = Head(target, (target,))
    joined = strict_lookup(sm.with_masks(labels), fluxes.select("source_id", *columns), ["source_id"], "line fluxes")
    found = {r["target"]: r for r in sm.moments(joined.filter("split = 'train'"), {c: F.col(c) for c in columns}).collect()}
    scaled = {c: (F.col(c) - found[c]["mean"]) / (found[c]["scale"] or 1.0) for c in columns}
    encoded = joined.withColumns(scaled | {target: standardizer.encode(target, sm.target_value(target)), "common": sm.common_rows(head, PRESENCE)})
    fitted = linear.fit_heads(encoded.filter("split = 'train'"), {"L": columns}, [target], ["L"])
    known = prior.scored(encoded.filter("split = 'test'"), [F.col(target)], "prior")
    return linear.score_heads(known, fitted, "source_id", ["prior", "common"]).drop("head", "subset", "sigma")


def fold_scores(labels: DataFrame, blocks: dict[str, Sequence[str]], flagged: Column, params: ScoreParams = ScoreParams(), folds: int = 5) -> DataFrame:
    """Scores of every fold's test rows by heads fitted on its training rows, tagged with `fold`. `labels` carries `block`.

    Flagged rows are withheld from training: their labels are NULL there and kept where they are scored.
    """
    parts = []
    for fold in range(folds):
        roles = labels.withColumn("split", sm.fold_role("block", fold, folds))
        held = sm.withhold(roles, flagged & (F.col("split") == "train"), sorted({t for h in params.heads for t in h.targets}))
        parts.append(evaluate(held, blocks, params).scores.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, parts)


def fold_predictions(labels: DataFrame, blocks: dict[str, Sequence[str]], flagged: Column, targets: Sequence[str], folds: int = 5,
                     subsets: Sequence[str] | None = None) -> DataFrame:
    """(source_id, fold, head, subset, ll, mean, truth, sigma): every row under linear heads fitted on the training rows of the fold that tests it.

    `labels` carries `block` (0 to 9) and numeric columns named like the targets, in whose own units all is given. Products of features and targets are
    added up per block in one pass, and each fold's sums are those of its training blocks, so all folds cost one scan. Flagged rows are tested but
    never learned from. Rows without a block take no part.
    """
    features = [c for names in blocks.values() for c in names]
    sums = linear.gram_by_part(labels.filter(~F.coalesce(flagged, F.lit(False))), "block", features, targets)
    width = 10 // folds
    heads: dict[int, list[linear.LinearHead]] = {}
    for fold in range(folds):
        tested = range(fold * width, (fold + 1) * width)
        learned = [sums[b] for b in sums if b not in tested and b != (fold * width + width) % 10]
        heads[fold] = []
        for t in targets:
            matrix = sum((m[t] for m in learned if t in m), np.zeros((2 + len(features), 2 + len(features))))
            heads[fold] += [linear.fit_head(matrix, features, [c for m in s for c in blocks[m]], t, s) for s in (subsets or sm.subset_names())]
    placed = labels.filter(F.col("block").isNotNull()).withColumn("fold", F.floor(F.col("block") / width).cast("int"))
    return linear.score_heads_by_part(placed, heads, "fold")


@dataclass
class Analysis:
    table: DataFrame
    modality_gains: DataFrame
    trends: dict[str, DataFrame]
    bands: dict[str, DataFrame]
    rho: DataFrame
    shares: DataFrame
    hardness: DataFrame
    withheld_shares: DataFrame | None = None
    specific_rate: DataFrame | None = None


def analyse(scores: DataFrame, draws: DataFrame, sources: DataFrame, standardizer: sm.Standardizer, head: str = "lx",
            replicates: int = 1000, withheld_draws: DataFrame | None = None, rate_densities: DataFrame | None = None) -> Analysis:
    """Combination table, modality gains, trends and their bands from scores; correlations, shares and hardness from draws.

    `withheld_draws`: draws made without the photometry, summarized like the others. `rate_densities`: rows of `specific_rate_densities`.
    """
    gains = settle(an.source_gains(scores, head))

    def correlations(rows: DataFrame) -> DataFrame:
        return an.within_object_correlation(rows, standardizer).join(sources, "source_id")

    rho = correlations(draws)
    return Analysis(an.combination_table(scores, replicates), an.modality_gains(scores, head, replicates),
                    {m: an.gain_trend(gains, m) for m in ("S", "I", "W")}, an.gain_bands(gains, ("S", "I", "W"), replicates=replicates),
                    rho, an.population_shares(rho, replicates), an.hardness_summary(draws, standardizer),
                    None if withheld_draws is None else an.population_shares(correlations(withheld_draws), replicates),
                    None if rate_densities is None else scoring.specific_rate_gain(rate_densities))
