"""Expressions over spectra held in array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions.core import as_col, is_finite
from skyframe.params import LIGHT_KMS, Grid, LineComplex


def grid_bin(wave: Column | str, grid: Grid) -> Column:
    """Nearest grid bin of a wavelength, half to even; NULL outside the grid."""
    i = F.rint((as_col(wave) - grid.lam0) / grid.dlam).cast("int")
    return F.when((i >= 0) & (i < grid.nbin), i)


def bin_wavelength(i: Column | str, grid: Grid) -> Column:
    return as_col(i) * F.lit(grid.dlam) + F.lit(grid.lam0)


def count_positive(values: Column | str) -> Column:
    return F.size(F.filter(as_col(values), lambda v: v > 0))


def all_finite(values: Column | str) -> Column:
    return F.forall(as_col(values), is_finite)


def any_nonzero(values: Column | str) -> Column:
    return F.exists(as_col(values), lambda v: v != 0)


def array_median(values: Column) -> Column:
    """Exact median of a short array; NULL when empty."""
    ordered = F.sort_array(values)
    n = F.size(values)
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def in_window(z: Column | str, window: tuple[float, float] | tuple[Column, Column], lo: float, hi: float) -> Column:
    """Whether a rest-frame window falls inside observed coverage [lo, hi] at redshift z > 0."""
    zc = as_col(z)
    inside = (zc > 0) & (zc >= F.lit(lo) / window[0] - 1) & (zc <= F.lit(hi) / window[1] - 1)
    return is_finite(zc) & F.coalesce(inside, F.lit(False))


def window_pixels(flux: Column, ivar: Column, z: Column, window: tuple[Column, Column], grid: Grid) -> Column:
    """Pixels of a rest-frame window as (x, y, v): rest wavelength, flux density, inverse variance.

    Only a slice two pixels wider than the window is walked.
    """
    first = F.greatest(F.ceil((window[0] * (1 + z) - grid.lam0) / grid.dlam) - 2, F.lit(0).cast("long")).cast("int")
    last = F.least(F.floor((window[1] * (1 + z) - grid.lam0) / grid.dlam) + 2, F.lit(grid.nbin - 1).cast("long")).cast("int")
    length = F.greatest(last - first + 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(flux, first + 1, length).alias("y"), F.slice(ivar, first + 1, length).alias("v"))
    pixels = F.transform(zipped, lambda p, i: F.struct(
        (bin_wavelength(first + i, grid) / (1 + z)).alias("x"), p["y"].cast("double").alias("y"), p["v"].cast("double").alias("v")))
    return F.filter(pixels, lambda p: (p["x"] >= window[0]) & (p["x"] <= window[1]))


def line_model(wave: Column, complex_: LineComplex, c0: Column, slope: Column, velocity: Column, width: Column,
               amplitudes: list[Column]) -> Column:
    """Flux density of a fitted complex on an array of rest wavelengths."""
    def at(x: Column) -> Column:
        y = c0 + slope * (x - complex_.primary)
        for amp, lines in zip(amplitudes, complex_.species):
            for rest, ratio in lines:
                centre = F.lit(rest) * (1 + velocity / LIGHT_KMS)
                t = (x - centre) / (centre * width / LIGHT_KMS)
                y = y + amp * ratio * F.exp(-0.5 * t * t)
        return y
    return F.transform(wave, at)


def integrated_flux(amp: Column, velocity: Column, width: Column, z: Column, primary: float) -> Column:
    """(1 + z) times the area of the primary Gaussian, with the width carried to wavelength units."""
    sigma = (1 + velocity / LIGHT_KMS) * primary * width / LIGHT_KMS
    return (1 + z) * amp * sigma * math.sqrt(2 * math.pi)


def integrated_flux_error(flux: Column, amp: Column, width: Column, var_amp: Column, var_width: Column) -> Column:
    """Relative errors of amplitude and width in quadrature."""
    usable = (amp > 0) & (width > 0) & (var_amp >= 0) & (var_width >= 0)
    return F.when(usable, flux * F.sqrt(var_amp / F.pow(amp, F.lit(2.0)) + var_width / F.pow(width, F.lit(2.0))))
