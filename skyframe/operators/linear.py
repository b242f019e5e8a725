"""Linear-Gaussian heads: one regression per target and combination of inputs, from shared normal equations."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import computed_once
from skyframe.operators.joins import DataError
from skyframe.operators.sample import subset_names


@dataclass(frozen=True)
class LinearHead:
    """y is normal around intercept + coefficients . features with a fixed deviation."""

    target: str
    subset: str
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    sigma: float


def _product_sums(train: DataFrame, features: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, np.ndarray]:
    """Per group of targets, the products of (1, features, targets) summed over the rows where all of them are present.

    One pass: each task adds up its own matrices, and only matrices are shuffled.
    """
    widths = {name: 1 + len(features) + len(targets) for name, targets in groups.items()}

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: np.zeros((width, width)) for name, width in widths.items()}
        for pdf in batches:
            x = pdf[list(features)].to_numpy(float)
            for name, targets in groups.items():
                y = pdf[list(targets)].to_numpy(float)
                known = np.isfinite(y).all(axis=1) & np.isfinite(x).all(axis=1)
                rows = np.column_stack([np.ones(known.sum()), x[known], y[known]])
                total[name] += rows.T @ rows
        yield pd.DataFrame({"name": np.repeat(list(total), [w * w for w in widths.values()]),
                            "at": np.concatenate([np.arange(w * w) for w in widths.values()]), "value": np.concatenate([m.ravel() for m in total.values()])})

    columns = sorted({t for targets in groups.values() for t in targets})
    parts = train.select(*features, *columns).mapInPandas(add_up, "name string, at int, value double")
    sums = parts.groupBy("name", "at").agg(F.sum("value").alias("value")).toPandas()  # (features + targets + 1)^2 numbers per group
    out = {}
    for name, rows in sums.groupby("name"):
        flat = np.zeros(widths[name] ** 2)
        flat[rows["at"].to_numpy()] = rows["value"].to_numpy()
        out[name] = flat.reshape(widths[name], widths[name])
    return out


def gram(train: DataFrame, features: Sequence[str], targets: Sequence[str]) -> dict[str, np.ndarray]:
    """Per target, the products of (1, features, y) summed over the rows where the target is present."""
    return _product_sums(train, features, {t: [t] for t in targets})


def gram_by_part(rows: DataFrame, part: str, features: Sequence[str], targets: Sequence[str]) -> dict[int, dict[str, np.ndarray]]:
    """`gram` of every part (a whole-number column of few values) in one pass over the rows; matrices of parts add up."""
    width = 2 + len(features)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for pdf in batches:
            x, parts = pdf[list(features)].to_numpy(float), pdf[part].to_numpy()
            for t in targets:
                y = pdf[t].to_numpy(float)
                known = np.isfinite(y) & np.isfinite(x).all(axis=1)
                for p in np.unique(parts[known]).tolist():
                    some = known & (parts == p)
                    block = np.column_stack([np.ones(some.sum()), x[some], y[some]])
                    total[p, t] = total.get((p, t), 0.0) + block.T @ block
        for (p, t), matrix in total.items():
            yield pd.DataFrame({"part": p, "target": t, "at": np.arange(width * width), "value": matrix.ravel()})

    sums = rows.select(F.col(part).cast("int").alias(part), *features, *targets).filter(F.col(part).isNotNull()).mapInPandas(
        add_up, "part int, target string, at int, value double")
    out: dict[int, dict[str, np.ndarray]] = {}
    for (p, t), found in sums.groupBy("part", "target", "at").agg(F.sum("value").alias("value")).toPandas().groupby(["part", "target"]):
        flat = np.zeros(width * width)
        flat[found["at"].to_numpy()] = found["value"].to_numpy()
        out.setdefault(int(p), {})[t] = flat.reshape(width, width)
    return out


@dataclass(frozen=True)
class JointHead:
    """Several targets, normal around their regressions with the covariance of the residuals. One row of coefficients per target."""

    head: str
    subset: str
    coefficients: tuple[tuple[float, ...], ...]
    covariance: tuple[tuple[float, ...], ...]


def fit_joint_heads(train: DataFrame, blocks: dict[str, Sequence[str]], groups: dict[str, Sequence[str]]) -> list[JointHead]:
    """For each named group of targets one head per combination of inputs, from the rows that carry every target of the group.

    Coefficients cover the constant and all features; features outside the combination have 0.
    """
    features = [c for names in blocks.values() for c in names]
    out = []
    for name, matrix in _product_sums(train, features, groups).items():
        n, d = matrix[0, 0], len(groups[name])
        if n <= d:
            raise DataError(f"targets {list(groups[name])} have {int(n)} usable training rows")
        yy = matrix[-d:, -d:]
        for subset in subset_names():
            keep = [0] + [1 + features.index(c) for m in subset for c in blocks[m]]
            a, b = matrix[np.ix_(keep, keep)], matrix[keep][:, -d:]
            scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale[:, None], rcond=1e-12)[0] / scale[:, None]
            residual = (yy - beta.T @ b - b.T @ beta + beta.T @ a @ beta) / n
            residual = (residual + residual.T) / 2 + np.diag(1e-12 * np.maximum(np.diag(yy) / n, 1e-300))
            full = np.zeros((d, 1 + len(features)))
            full[:, keep] = beta.T
            out.append(JointHead(name, subset, tuple(map(tuple, full)), tuple(map(tuple, residual))))
    return out


def marginal_heads(fits: Sequence[JointHead], targets: Sequence[str], features: Sequence[str], chosen: Sequence[str]) -> list[LinearHead]:
    """Each chosen target of joint heads by itself: normal around its own regression with its own deviation, whatever the others are."""
    return [LinearHead(t, f.subset, tuple(features), f.coefficients[i][0], f.coefficients[i][1:], math.sqrt(f.covariance[i][i]))
            for f in fits for i, t in enumerate(targets) if t in chosen]


def fit_head(matrix: np.ndarray, features: Sequence[str], chosen: Sequence[str], target: str, subset: str) -> LinearHead:
    """Solve one regression from a shared product matrix; deviation is the residual's, over n."""
    keep = [0] + [1 + list(features).index(c) for c in chosen]
    n, yy = matrix[0, 0], matrix[-1, -1]
    if n < 2:
        raise DataError(f"target {target!r} has {int(n)} usable training rows")
    a, b = matrix[np.ix_(keep, keep)], matrix[keep, -1]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    residual = max(float(yy - 2 * beta @ b + beta @ a @ beta), 1e-12 * max(yy, 1e-300))
    return LinearHead(target, subset, tuple(chosen), float(beta[0]), tuple(float(v) for v in beta[1:]), math.sqrt(residual / n))


def fit_heads(train: DataFrame, blocks: dict[str, Sequence[str]], targets: Sequence[str],
              subsets: Sequence[str] | None = None) -> list[LinearHead]:
    """One head per (target, combination); `blocks` maps a modality to its feature columns."""
    features = [c for names in blocks.values() for c in names]
    matrices = gram(train, features, targets)
    return [fit_head(matrices[t], features, [c for m in s for c in blocks[m]], t, s)
            for t in targets for s in (subsets or subset_names())]


HEADS_TYPE = "array<struct<head string, subset string, target int, intercept double, sigma double, beta array<double>>>"


def score_heads(rows: DataFrame, heads: Sequence[LinearHead], key: str = "source_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep..., head, subset, ll, mean, truth, sigma): every row under every head.

    The coefficients form one literal table that each row walks; absent features have coefficient 0.
    """
    return score_heads_by_part(rows.withColumn("_part", F.lit(0)), {0: heads}, "_part", key, keep).drop("_part")


def score_heads_by_part(rows: DataFrame, heads_of: dict[int, Sequence[LinearHead]], part: str, key: str = "source_id", keep: Sequence[str] = ()) -> DataFrame:
    """As `score_heads`, with (key, keep..., part, ...): each row under the heads of its own part (from 0)."""
    every = [h for p in sorted(heads_of) for h in heads_of[p]]
    features = sorted({f for h in every for f in h.features})
    targets = sorted({h.target for h in every})
    tables = [[{"head": h.target, "subset": h.subset, "target": targets.index(h.target), "intercept": h.intercept, "sigma": h.sigma,
              "beta": [dict(zip(h.features, h.coefficients)).get(f, 0.0) for f in features]} for h in heads_of[p]] for p in sorted(heads_of)]
    held = computed_once(rows, {"_x": F.array(*[F.col(f).cast("double") for f in features]),
                                "_y": F.array(*[F.col(t).cast("double") for t in targets])})

    def score(h: Column) -> Column:
        mean = F.aggregate(F.zip_with("_x", h["beta"], lambda x, b: x * b), h["intercept"], lambda a, p: a + p)
        return F.struct(h["head"].alias("head"), h["subset"].alias("subset"), h["sigma"].alias("sigma"), mean.alias("mean"),
                        F.get("_y", h["target"]).alias("truth"))

    own = F.get(F.from_json(F.lit(json.dumps(tables)), f"array<{HEADS_TYPE}>"), F.col(part))
    out = held.select(key, *keep, part, F.explode(F.transform(own, score)).alias("_e"))
    t = (F.col("_e.truth") - F.col("_e.mean")) / F.col("_e.sigma")
    ll = -0.5 * t * t - F.ln("_e.sigma") - 0.5 * math.log(2 * math.pi)
    return out.select(key, *keep, part, "_e.head", "_e.subset", ll.alias("ll"), "_e.mean", "_e.truth", "_e.sigma")


def image_features(image: Column | str, size: int, bands: str = "griz") -> dict[str, Column]:
    """Summed flux of each band of a flattened image, with non-finite pixels left out."""
    img = F.col(image) if isinstance(image, str) else image
    out = {}
    for i, band in enumerate(bands):
        pixels = F.slice(img, i * size * size + 1, size * size)
        out[f"image_{band}"] = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x.cast("double"), F.lit(0.0))))
    return out
