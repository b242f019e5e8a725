"""Scalar expressions shared by every job: finiteness, ids, sky distance, names, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.params import MAIN_RELEASES, MODALITIES, RELEASE_MASK, RELEASE_SHIFT


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_finite(c: Column | str) -> Column:
    """True only for a number: not NULL, not NaN, not infinite."""
    d = as_col(c).cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    return F.when(is_finite(c), as_col(c).cast("double"))


def safe_log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def trimmed(c: Column | str) -> Column:
    return F.trim(as_col(c))


def release_of(targetid: Column | str) -> Column:
    """The imaging release packed into bits 42-57 of a target id."""
    return F.shiftright(as_col(targetid), RELEASE_SHIFT).bitwiseAND(F.lit(RELEASE_MASK).cast("long"))


def on_main_survey(targetid: Column | str, releases: Sequence[int] = MAIN_RELEASES) -> Column:
    return release_of(targetid).isin(list(releases))


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation by the haversine form, which is accurate at small angles."""
    half_dec = F.sin(F.radians(dec2 - dec1) / 2)
    half_ra = F.sin(F.radians(ra2 - ra1) / 2)
    h = half_dec * half_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half_ra * half_ra
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * 3600.0


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def hash_uniform(*parts: Column | str | int) -> Column:
    """A reproducible uniform in [0, 1) from the first 32 bits of an md5 of the parts."""
    columns = [F.lit(p).cast("string") if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    digest = F.md5(F.concat_ws(":", *columns))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def subset_name(flags: Sequence[Column | str]) -> Column:
    """Name of a combination of modalities, in the fixed modality order."""
    return F.concat(*[F.when(as_col(f), F.lit(m)).otherwise("") for m, f in zip(MODALITIES, flags)])


def group_url(template: str, survey: Column | str, program: Column | str, pixel: Column | str) -> Column:
    """Fill `{survey} {program} {group} {pix}` where the group is the pixel divided by 100."""
    pix = as_col(pixel).cast("long")
    return _fill(template, {"survey": trimmed(survey), "program": trimmed(program),
                            "group": F.floor(pix / 100).cast("string"), "pix": pix.cast("string")})


def cutout_url(template: str, ra: Column | str, dec: Column | str, **fixed: object) -> Column:
    """Fill `{ra:.6f}` and `{dec:.6f}` per row and the remaining fields with constants."""
    values = {"ra:.6f": F.format_string("%.6f", as_col(ra)), "dec:.6f": F.format_string("%.6f", as_col(dec))}
    values.update({name: F.lit(str(value)) for name, value in fixed.items()})
    return _fill(template, values)


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def utc_seconds(moment: Column | None = None) -> Column:
    """A moment, by default now, as text in UTC to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if moment is None else moment, F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def shape_problem(image: Column | str, bands: Column | str, size: int, expected_bands: str) -> Column:
    """Verdict on one flattened image: ok, bad_bands, bad_shape or not_finite."""
    img = as_col(image)
    return (
        F.when(F.lower(as_col(bands)) != expected_bands, "bad_bands")
        .when(F.size(img) != len(expected_bands) * size * size, "bad_shape")
        .when(~F.forall(img, is_finite), "not_finite")
        .otherwise("ok")
    )


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    Neighbouring projections are merged by the optimizer, which would repeat a costly expression for
    every element of a lambda that mentions it. A generator of one element keeps them apart.
    """
    held = F.struct(*[c.alias(name) for name, c in columns.items()])
    out = df.withColumn("_held", F.explode(F.array(held)))
    return out.select(*[c for c in df.columns if c not in columns], *[F.col(f"_held.{name}").alias(name) for name in columns])


def bind(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of a struct of values that are evaluated once per row, for use inside lambdas over arrays."""
    held = F.struct(*[c.alias(name) for name, c in values.items()])
    return F.get(F.transform(F.array(held), body), F.lit(0))
