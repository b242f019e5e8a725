"""Emission lines: window extraction, quality gates, bounded fits, features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import computed_once, is_finite
from skyframe.functions.spectra import array_median, in_window, window_pixels
from skyframe.params import (
    LIGHT_KMS, LINE_COMPLEXES, LINE_EDGE, LINE_MIN_COVER, LINE_MAX_STEPS, LINE_MIN_PIXELS, LINE_MIN_WIDTH, LINE_START_WIDTHS, Grid, LineComplex,
)
from skyframe.session import spread

LINE_BATCH = 128  # windows that join at a time, and fits left open while more windows come
FIT_COLUMNS = ("n", "noise", "c0", "slope", "v_kms", "sigma_kms", "amp", "an", "flux", "flux_err", "chi2", "rchi2", "at_bound")
FIT_SCHEMA = ("targetid long, z double, line string, status string, n int, noise double, c0 double, slope double, v_kms double, "
              "sigma_kms double, amp double, an double, flux double, flux_err double, chi2 double, rchi2 double, at_bound int")


def lines_in_window(sources: DataFrame, grid: Grid) -> DataFrame:
    """One row per (source, line complex) whose window is covered at the source's redshift."""
    table = F.array(*[F.struct(F.lit(c.name).alias("line"), F.lit(c.window[0]).alias("lo"), F.lit(c.window[1]).alias("hi"))
                      for c in LINE_COMPLEXES])
    covered = F.filter(table, lambda c: in_window(F.col("z"), (c["lo"], c["hi"]), grid.lam0, grid.last))
    return (sources.withColumn("_c", F.explode(covered))
            .select(*sources.columns, F.col("_c.line").alias("line"), F.col("_c.lo").alias("lo"), F.col("_c.hi").alias("hi")))


def line_windows(spectra: DataFrame, grid: Grid) -> DataFrame:
    """Cut each covered window out of (targetid, z, flux, ivar), and gate it.

    Adds n_window, the good pixels `x, y, v`, `noise` (median error), `c0` (median flux near the edges),
    `peak`, and `status`: off_grid, window_ivar, bad_ivar, bad_flux, or NULL when the window is fit to use.
    """
    cut = lines_in_window(spectra, grid)
    pixels = window_pixels(F.col("flux"), F.col("ivar"), F.col("z"), (F.col("lo"), F.col("hi")), grid)
    cut = computed_once(cut, {"_pixels": pixels}).select("targetid", "z", "line", "lo", "hi", "_pixels")
    cut = computed_once(cut, {"_good": F.filter("_pixels", lambda p: (p["v"] > 0) & is_finite(p["y"]))})
    span = F.col("hi") - F.col("lo")
    edge = F.filter("_good", lambda p: (p["x"] < F.col("lo") + LINE_EDGE * span) | (p["x"] > F.col("hi") - LINE_EDGE * span))
    cut = cut.select("targetid", "z", "line", "lo", "hi", F.size("_pixels").alias("n_window"), F.size("_good").alias("n_good"),
                     F.col("_good.x").alias("x"), F.col("_good.y").alias("y"), F.col("_good.v").alias("v"), edge.alias("_edge"))
    noise = array_median(F.transform("v", lambda v: 1 / F.sqrt(v)))
    base = F.when(F.size("_edge") > 10, array_median(F.col("_edge.y"))).otherwise(array_median(F.col("y")))
    cut = computed_once(cut, {"noise": noise, "c0": base}).withColumn("peak", F.array_max("y") - F.col("c0"))
    status = (F.when(F.col("n_window") < LINE_MIN_PIXELS, "off_grid")
              .when(F.col("n_good") < LINE_MIN_COVER * F.col("n_window"), "window_ivar")
              .when(~is_finite("noise") | (F.col("noise") <= 0), "bad_ivar")
              .when(~is_finite("peak"), "bad_flux"))
    return cut.withColumn("status", status).drop("_edge")


def moment_flux(windows: DataFrame) -> DataFrame:
    """Line flux without a fit: a weighted straight continuum from the window's edges, subtracted and summed.

    Everything is folded inside the row; pixels share one rest-frame spacing. Moments are taken before the
    line is solved, so no lambda walks pixels with a value that is itself computed from pixels.
    """
    lo, hi = F.col("lo"), F.col("hi")
    span, mid = hi - lo, (lo + hi) / 2
    zipped = F.arrays_zip("x", "y", "v")
    edge = F.filter(zipped, lambda p: (p["x"] < lo + LINE_EDGE * span) | (p["x"] > hi - LINE_EDGE * span))
    rows = windows.filter("status IS NULL").select("targetid", "line", "z", "n_window", "lo", "hi", "x", "y", "v")
    rows = computed_once(rows, {"_edge": edge})

    def total(pixels: Column | str, term) -> Column:
        return F.aggregate(pixels, F.lit(0.0), lambda a, p: a + term(p))

    sums = rows.select(
        "targetid", "line", "z", "n_window", span.alias("_span"),
        total("_edge", lambda p: p["v"]).alias("_w"), total("_edge", lambda p: p["v"] * (p["x"] - mid)).alias("_x"),
        total("_edge", lambda p: p["v"] * (p["x"] - mid) * (p["x"] - mid)).alias("_xx"),
        total("_edge", lambda p: p["v"] * p["y"]).alias("_y"), total("_edge", lambda p: p["v"] * p["y"] * (p["x"] - mid)).alias("_xy"),
        total("y", lambda y: y).alias("_all_y"), total("x", lambda x: x - mid).alias("_all_x"), F.size("x").alias("_n"))
    sums = computed_once(sums, {c: F.col(c) for c in ("_w", "_x", "_xx", "_y", "_xy")})
    det = F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x")
    fitted = sums.filter(det > 0).withColumns({
        "slope": (F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y")) / det,
        "level": (F.col("_y") * F.col("_xx") - F.col("_x") * F.col("_xy")) / det})
    over = F.col("_all_y") - F.col("level") * F.col("_n") - F.col("slope") * F.col("_all_x")
    step = F.col("_span") / F.col("n_window")
    return fitted.select("targetid", "line", "level", "slope", ((1 + F.col("z")) * over * step).alias("flux"))


# ---- bounded least squares, many windows of one complex at a time

def _gaussians(x: np.ndarray, lines, v: np.ndarray, s: np.ndarray):
    """Per line of a species: rest wavelength, the row's centre and width, the pixels' distances t in widths, and the unit Gaussian g there; arrays are
    (rows, pixels)."""
    for rest, ratio in lines:
        centre = rest * (1.0 + v / LIGHT_KMS)
        sigma = centre * s / LIGHT_KMS
        t = x - centre[:, None]
        t /= sigma[:, None]
        g = t * t
        g *= -0.5
        np.exp(g, out=g)
        g *= ratio
        yield rest, centre, sigma, t, g


def _residual(p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, cx: LineComplex):
    """Weighted residuals (rows, pixels), and per species its lines, for `_jacobian`."""
    model = x - cx.primary
    model *= p[:, 1:2]
    model += p[:, :1]
    species = [list(_gaussians(x, lines, p[:, 2], p[:, 3])) for lines in cx.species]
    for k, lines in enumerate(species):
        model += p[:, 4 + k:5 + k] * sum((line[4] for line in lines[1:]), lines[0][4])
    model -= y
    model *= w
    return model, species


def _jacobian(p: np.ndarray, x: np.ndarray, w: np.ndarray, cx: LineComplex, species, at=slice(None)) -> np.ndarray:
    """Weighted slopes of the model (rows, pixels, parameters) of the rows `at` of what `_residual` found; the other arrays hold these rows only."""
    jac = np.zeros((*x.shape, p.shape[1]))
    jac[..., 0] = w
    jac[..., 1] = (x - cx.primary) * w
    by_v, by_s = np.zeros_like(x), np.zeros_like(x)
    for k, lines in enumerate(species):
        total, of_v, of_s = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
        for rest, centre, sigma, t, g in lines:
            centre, sigma, t, g = centre[at], sigma[at, None], t[at], g[at]
            total += g
            slope = g * t
            wider = slope * t
            slope /= sigma
            wider /= sigma
            of_s += wider * (centre / LIGHT_KMS)[:, None]
            wider *= (p[:, 3] / LIGHT_KMS)[:, None]
            slope += wider
            slope *= rest / LIGHT_KMS
            of_v += slope
        amp = p[:, 4 + k:5 + k]
        by_v += amp * of_v
        by_s += amp * of_s
        jac[..., 4 + k] = total * w
    jac[..., 2], jac[..., 3] = by_v * w, by_s * w
    return jac


def _evaluate(p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, cx: LineComplex):
    """Weighted residuals (rows, pixels) and their Jacobian (rows, pixels, parameters)."""
    residual, species = _residual(p, x, y, w, cx)
    return residual, _jacobian(p, x, w, cx, species)


def _products(jac: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the products of slopes with each other and with the residuals."""
    return np.einsum("rnp,rnq->rpq", jac, jac), np.einsum("rnp,rn->rp", jac, residual)


class _Fits:
    """Open fits of one complex, which advance together: Levenberg-Marquardt with steps clipped to the bounds and bound parameters held while they
    push outward. Settled fits leave and new ones join, so that a few slow fits do not hold a batch of others or run on their own.
    """

    def __init__(self, cx: LineComplex, steps: int = LINE_MAX_STEPS) -> None:
        self.cx, self.steps = cx, steps
        self.rows: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.rows["tag"]) if self.rows else 0

    def add(self, tag: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Rows join; pixels are padded to a rectangle with zero weight."""
        residual, jac = _evaluate(p, x, y, w, self.cx)
        normal, gradient = _products(jac, residual)
        new = {"tag": tag, "p": p, "low": low, "high": high, "x": x, "y": y, "w": w, "cost": 0.5 * (residual**2).sum(axis=1), "turn": np.zeros(len(p), int),
               "damping": np.full(len(p), 1e-3), "exact": 0.5e-24 * ((y * w)**2).sum(axis=1),  # residuals of this size are rounding
               "normal": normal, "gradient": gradient}
        if len(self):
            width = max(x.shape[1], self.rows["x"].shape[1])
            for name, pad in (("x", self.cx.primary), ("y", 0.0), ("w", 0.0)):
                new[name], self.rows[name] = (np.pad(rows[name], ((0, 0), (0, width - rows[name].shape[1])), constant_values=pad) for rows in (new, self.rows))
            new = {name: np.concatenate((self.rows[name], rows)) for name, rows in new.items()}
        self.rows = new

    def advance(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of all; tag, parameters and cost of those that leave. The cost of one that has not settled is infinite: never the best of the
        starts, and a failed fit if no start settles."""
        r, cx = self.rows, self.cx
        p, gradient, cost, damping = r["p"], r["gradient"], r["cost"], r["damping"]
        held = ((p <= r["low"]) & (gradient > 0)) | ((p >= r["high"]) & (gradient < 0))
        normal = np.where(held[:, :, None] | held[:, None, :], 0.0, r["normal"])
        k = np.arange(p.shape[1])
        diagonal = normal[:, k, k]
        diagonal[diagonal <= 0] = 1.0
        normal[:, k, k] += damping[:, None] * diagonal + held
        step = np.linalg.solve(normal, -np.where(held, 0.0, gradient)[..., None])[..., 0]
        trial = np.clip(p + step, r["low"], r["high"])
        residual, species = _residual(trial, r["x"], r["y"], r["w"], cx)
        new_cost = 0.5 * (residual**2).sum(axis=1)
        better = np.isfinite(new_cost) & (new_cost <= cost)
        settled = better & (cost - new_cost <= 1e-8 * cost) & (damping <= 1.0)
        took = np.flatnonzero(better)
        if took.size:
            at = slice(None) if took.size == len(p) else took
            jac = _jacobian(trial[at], r["x"][at], r["w"][at], cx, species, at)
            p[at], cost[at] = trial[at], new_cost[at]
            r["normal"][at], gradient[at] = _products(jac, residual[at])
        damping[:] = np.where(better, np.maximum(damping / 5.0, 1e-12), damping * 4.0)
        r["turn"] += 1
        active = ~settled & (damping < 1e12) & (cost > r["exact"])
        late = active & (r["turn"] >= self.steps)
        gone = ~active | late
        out = r["tag"][gone], p[gone], np.where(late, np.inf, cost)[gone]
        if gone.any():
            self.rows = {name: rows[~gone] for name, rows in r.items()}
        return out


def _solve(p: np.ndarray, low: np.ndarray, high: np.ndarray, x, y, w, cx: LineComplex, steps: int = LINE_MAX_STEPS):
    """All rows together until each has left: parameters, cost, Jacobian."""
    fits, p, cost = _Fits(cx, steps), p.copy(), np.empty(len(p))
    fits.add(np.arange(len(p)), p.copy(), low, high, x, y, w)
    while len(fits):
        tag, found, costs = fits.advance()
        p[tag], cost[tag] = found, costs
    return p, cost, _evaluate(p, x, y, w, cx)[1]


class _Windows:
    """Fits of all windows of one complex that a task gets, from each start; a window is given out when its last start is done."""

    def __init__(self, cx: LineComplex) -> None:
        self.cx, self.fits, self.next = cx, _Fits(cx), 0
        self.open: dict[int, list] = {}  # by number: the window, then per start (cost, parameters) or None
        self.done: list[list] = []

    def add(self, pdf: pd.DataFrame) -> None:
        cx, starts, rows = self.cx, len(LINE_START_WIDTHS), list(pdf.itertuples(index=False))
        x, y, w = self._pixels(rows)
        noise, c0, peak = (pdf[c].to_numpy(float) for c in ("noise", "c0", "peak"))
        species = len(cx.species)
        ceiling = np.maximum(np.maximum(10.0 * np.abs(peak), 50.0 * noise), 1e-3)
        low = np.tile([-np.inf, -np.inf, -cx.max_velocity, LINE_MIN_WIDTH] + [0.0] * species, (len(rows), 1))
        high = np.tile([np.inf, np.inf, cx.max_velocity, cx.max_width] + [0.0] * species, (len(rows), 1))
        high[:, 4:] = ceiling[:, None]
        number = self.next + np.arange(len(rows))
        self.open.update((n, [row] + [None] * starts) for n, row in zip(number.tolist(), rows))
        self.next += len(rows)
        for i, width0 in enumerate(LINE_START_WIDTHS):
            start = np.zeros((len(rows), 4 + species))
            start[:, 0], start[:, 3] = c0, width0
            start[:, 4:] = np.maximum(peak, 3.0 * noise)[:, None]
            self.fits.add(number * starts + i, np.clip(start, low + 1e-9, high - 1e-9), low, high, x, y, w)

    def run(self, most: int) -> Iterator[pd.DataFrame]:
        """Steps until at most so many fits are open."""
        starts = len(LINE_START_WIDTHS)
        while len(self.fits) > most:
            for tag, p, cost in zip(*self.fits.advance()):
                number, i = divmod(int(tag), starts)
                self.open[number][1 + i] = (cost, p)
                if None not in self.open[number][1:]:
                    self.done.append(self.open.pop(number))
        if self.done:
            yield self._found(self.done)
            self.done = []

    def _pixels(self, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = max(len(r.x) for r in rows)
        x, y, w = np.full((len(rows), width), self.cx.primary), np.zeros((len(rows), width)), np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, :len(r.x)], y[i, :len(r.y)], w[i, :len(r.v)] = r.x, r.y, np.sqrt(r.v)
        return x, y, w

    def _found(self, done: list[list]) -> pd.DataFrame:
        """The best of each window's starts, the first of equals, with the errors of its flux."""
        cx, rows, species = self.cx, [d[0] for d in done], len(self.cx.species)
        best = []
        for _, first, *others in done:
            for other in others:
                first = other if other[0] < first[0] else first
            best.append(first)
        cost, p = np.array([b[0] for b in best]), np.array([b[1] for b in best])
        x, y, w = self._pixels(rows)
        n, z, noise = (w > 0).sum(axis=1), np.array([r.z for r in rows], float), np.array([r.noise for r in rows], float)
        normal = _products(*_evaluate(p, x, y, w, cx)[::-1])[0]
        amp, v, s = p[:, 4], p[:, 2], p[:, 3]
        sigma = cx.primary * (1.0 + v / LIGHT_KMS) * s / LIGHT_KMS
        flux = (1.0 + z) * amp * sigma * math.sqrt(2.0 * math.pi)
        error = np.full(len(rows), np.nan)
        diagonal = np.einsum("rpp->rp", normal)
        some = np.flatnonzero((amp > 0) & np.isfinite(normal).all(axis=(1, 2)))
        scaled = normal[some] / np.sqrt(diagonal[some, :, None] * diagonal[some, None, :] + 1e-300)
        some = some[np.linalg.cond(scaled) < 1e14] if some.size else some
        cov = np.linalg.inv(normal[some])
        known = (cov[:, 4, 4] >= 0) & (cov[:, 3, 3] >= 0)
        some, cov = some[known], cov[known]
        error[some] = flux[some] * np.sqrt(cov[:, 4, 4] / amp[some]**2 + cov[:, 3, 3] / s[some]**2)
        failed = ~np.isfinite(cost)
        out = pd.DataFrame({
            "targetid": [r.targetid for r in rows], "z": z, "line": cx.name,
            "status": np.where(failed, "fit_fail", "ok"), "n": n, "noise": noise, "c0": p[:, 0], "slope": p[:, 1], "v_kms": v,
            "sigma_kms": s, "amp": amp, "an": amp / noise, "flux": flux, "flux_err": error, "chi2": 2.0 * cost,
            "rchi2": 2.0 * cost / np.maximum(n - 4 - species, 1),
            "at_bound": ((np.abs(v) > cx.max_velocity - 10) | (s > cx.max_width - 10)).astype(int)})
        out.loc[failed, list(FIT_COLUMNS)] = None
        return out


def fit_lines(windows: DataFrame) -> DataFrame:
    """Fit every usable window in one pass; gated windows keep their status, and they and unsettled fits carry no numbers."""
    names = {c.name: c for c in LINE_COMPLEXES}
    columns = [c.split()[0] for c in FIT_SCHEMA.split(", ")]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_windows = {name: _Windows(cx) for name, cx in names.items()}
        for batch in batches:
            gated = batch["status"].notna()
            yield batch.loc[gated, ["targetid", "z", "line", "status"]].reindex(columns=columns)
            for line, pdf in batch[~gated].groupby("line"):
                for start in range(0, len(pdf), LINE_BATCH):
                    open_windows[line].add(pdf.iloc[start:start + LINE_BATCH])
                    yield from open_windows[line].run(LINE_BATCH)
        for own in open_windows.values():
            yield from own.run(0)

    pixels = [F.when(F.col("status").isNull(), F.col(c)).alias(c) for c in ("x", "y", "v")]
    rows = windows.select("targetid", "z", "line", "status", *pixels, "noise", "c0", "peak")
    return spread(rows, "targetid", "line").mapInPandas(fit, FIT_SCHEMA)


# ---- features

def features_from_fits(sample: DataFrame, fits: DataFrame, grid: Grid) -> DataFrame:
    """One row per sample target: each line's flux (0 where missing), error, significance and status."""
    picks = []
    for c in LINE_COMPLEXES:
        mine = F.col("line") == c.name
        picks += [F.max(F.when(mine, F.col("status"))).alias(f"_{c.stem}_status")]
        picks += [F.max(F.when(mine & (F.col("status") == "ok"), F.col(q))).alias(f"_{c.stem}_{q}") for q in ("flux", "flux_err", "an")]
    wide = fits.groupBy("targetid").agg(*picks)
    joined = sample.select("targetid", "split", "spectype", "z").join(wide, "targetid", "left")
    known = is_finite("z") & F.coalesce(F.col("z") > 0, F.lit(False))
    out = {}
    for c in LINE_COMPLEXES:
        idle = (F.when(in_window("z", c.window, grid.lam0, grid.last), "unfitted")
                .when(known, "not_in_window").otherwise("no_redshift"))
        out |= {f"{c.stem}_flux": F.coalesce(F.col(f"_{c.stem}_flux"), F.lit(0.0)), f"{c.stem}_flux_err": F.col(f"_{c.stem}_flux_err"),
                f"{c.stem}_an": F.col(f"_{c.stem}_an"), f"{c.stem}_status": F.coalesce(F.col(f"_{c.stem}_status"), idle)}
    return joined.select("targetid", "split", "spectype", "z", *[v.alias(k) for k, v in out.items()])


def status_counts(features: DataFrame) -> DataFrame:
    """(line, status, rows)."""
    stems = [c.stem for c in LINE_COMPLEXES]
    entries = F.array(*[F.struct(F.lit(s).alias("line"), F.col(f"{s}_status").alias("status")) for s in stems])
    return features.select(F.explode(entries).alias("_e")).groupBy("_e.line", "_e.status").agg(F.count(F.lit(1)).alias("rows"))


def line_totals(statuses: DataFrame) -> DataFrame:
    """Per line: measured, and in window (every status but not_in_window and no_redshift)."""
    outside = F.col("status").isin("not_in_window", "no_redshift")
    return statuses.groupBy("line").agg(
        F.sum(F.when(F.col("status") == "ok", F.col("rows")).otherwise(0)).alias("measured"),
        F.sum(F.when(~outside, F.col("rows")).otherwise(0)).alias("in_window"))
