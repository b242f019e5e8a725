"""Poisson count likelihoods and quadrature axes, as expressions on array columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions.core import as_col, bind
from skyframe.params import COUNT_FLOOR, NET_COUNT_FLOOR, QUADRATURE_NODES, QUADRATURE_SPAN

LN10 = math.log(10.0)
HALF_LN_2PI = 0.5 * math.log(2.0 * math.pi)


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: Stirling's series at n + 9, divided back by eight factors."""
    y = n + 9.0
    inverse = 1.0 / y
    square = inverse * inverse
    series = inverse * (1.0 / 12 - square * (1.0 / 360 - square * (1.0 / 1260 - square / 1680.0)))
    factors = reduce(lambda a, k: a * (n + float(k)), range(2, 9), n + 1.0)
    return (y - 0.5) * F.ln(y) - y + HALF_LN_2PI + series - F.ln(factors)


def log_pmf(counts: Column | str, background: Column | str, exposure: Column | str, u: Column, mean: float,
            scale: float) -> Column:
    """ln P(N) at expected counts t * 10^(scale u + mean) + B."""
    n, b, t = (as_col(c).cast("double") for c in (counts, background, exposure))
    expected = t * F.pow(F.lit(10.0), u * scale + mean) + b
    return n * F.ln(expected) - expected - log_factorial(n)


def proposal(counts: Column | str, background: Column | str, exposure: Column | str, mean: float,
             scale: float) -> tuple[Column, Column]:
    """Centre and width of the Laplace proposal in standardized units."""
    n, b, t = (as_col(c).cast("double") for c in (counts, background, exposure))
    net = F.greatest(n - b, F.lit(NET_COUNT_FLOOR))
    peak = (F.log10(net / F.when(t > 0, t)) - mean) / scale
    variance = F.greatest(n, F.lit(COUNT_FLOOR)) / (F.lit((LN10 * scale) ** 2) * net * net)
    return peak / (1.0 + variance), F.sqrt(variance / (1.0 + variance))


def _offsets(k: int, span: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i * F.lit(2.0 * span / (k - 1)) - span)


def axis(nodes: Column, log_spacing: Column, log_like: Column) -> Column:
    """One dimension at quadrature time: nodes, log of their spacing, log likelihood at the nodes."""
    return F.struct(nodes.alias("nodes"), log_spacing.alias("spacing"), log_like.alias("like"))


def pinned_axis(value: Column) -> Column:
    """An observed scalar: one node, no spacing."""
    return axis(F.array(value.cast("double")), F.lit(0.0), F.array(F.lit(0.0)))


def prior_axis(k: int = QUADRATURE_NODES, span: float = QUADRATURE_SPAN) -> Column:
    """No measurement: closed nodes over the span."""
    return axis(_offsets(k, span), F.lit(math.log(2.0 * span / (k - 1))), F.array_repeat(F.lit(0.0), k))


def rate_axis(counts: Column | str, background: Column | str, exposure: Column | str, mean: float, scale: float,
              k: int = QUADRATURE_NODES, span: float = QUADRATURE_SPAN) -> Column:
    """A measured rate: nodes recentred on the proposal, with the count likelihood at each."""
    n, b, t = (as_col(c).cast("double") for c in (counts, background, exposure))
    centre, width = proposal(n, b, t, mean, scale)

    def place(held: Column) -> Column:
        def like(o: Column) -> Column:
            expected = held["t"] * F.pow(F.lit(10.0), (held["centre"] + held["width"] * o) * scale + mean) + held["b"]
            return held["n"] * F.ln(expected) - expected - held["factorial"]

        return axis(F.transform(_offsets(k, span), lambda o: held["centre"] + held["width"] * o),
                    F.ln(held["width"]) + math.log(2.0 * span / (k - 1)), F.transform(_offsets(k, span), like))

    return bind({"n": n, "b": b, "t": t, "centre": centre, "width": width, "factorial": log_factorial(n)}, place)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array."""
    def shifted(held: Column) -> Column:
        return held["top"] + F.ln(F.aggregate(held["x"], F.lit(0.0), lambda a, x: a + F.exp(x - held["top"])))
    return bind({"x": values, "top": F.array_max(values)}, shifted)
