"""Sky cross-match: radius join on declination zones and right-ascension cells, and counterpart rules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.core import separation_arcsec, unit_vector

SLACK_DEG = 1e-9


def _cells_in_zone(zone: Column, cell: float) -> Column:
    """Cells around a zone: as many as fit while each stays at least one cell wide on the sky."""
    edge = F.greatest(F.abs(zone * cell - 90.0), F.abs((zone + 1) * cell - 90.0))
    return F.greatest(F.lit(1.0), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / cell)).cast("long")


def with_cell(df: DataFrame, ra: str, dec: str, cell: float) -> DataFrame:
    """The (zone, cell) that holds each position."""
    zone = F.floor((F.col(dec) + 90.0) / cell)
    out = df.withColumn("_zone", zone).withColumn("_n", _cells_in_zone(F.col("_zone"), cell))
    index = F.pmod(F.floor(F.col(ra) / 360.0 * F.col("_n")), F.col("_n"))
    return out.withColumn("_cell", index).drop("_n")


def with_reachable_cells(df: DataFrame, ra: str, dec: str, radius_deg: float, cell: float) -> DataFrame:
    """One row per (zone, cell) a circle around each position can touch; the cells of a row are distinct."""
    h = radius_deg + SLACK_DEG
    top = int(math.floor(180.0 / cell))
    first = F.greatest(F.floor((F.col(dec) - h + 90.0) / cell), F.lit(0).cast("long"))
    last = F.least(F.floor((F.col(dec) + h + 90.0) / cell), F.lit(top).cast("long"))
    out = df.withColumn("_zone", F.explode(F.sequence(first, last)))
    out = out.withColumn("_n", _cells_in_zone(F.col("_zone"), cell))
    ratio = F.lit(math.sin(math.radians(h))) / F.cos(F.radians(F.col(dec)))
    reach = F.when(F.abs(F.col(dec)) + h < 90.0, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + SLACK_DEG).otherwise(180.0)
    low = F.floor((F.col(ra) - reach) / 360.0 * F.col("_n"))
    high = F.floor((F.col(ra) + reach) / 360.0 * F.col("_n"))
    span = F.least(high - low, F.col("_n") - 1)
    cells = F.transform(F.sequence(low, low + span), lambda i: F.pmod(i, F.col("_n")))
    return out.withColumn("_cell", F.explode(cells)).drop("_n")


def radius_pairs(left: DataFrame, right: DataFrame, left_pos: tuple[str, str], right_pos: tuple[str, str],
                 radius_arcsec: float, cell_per_radius: float = 4.0) -> DataFrame:
    """All (left, right) rows within the radius, with `sep_arcsec`.

    The left side is copied to the cells it can reach, so an equality join on (zone, cell) holds every
    pair exactly once; pass the smaller side as `left`. Rows without a position match nothing.
    """
    cell = max(cell_per_radius * radius_arcsec / 3600.0, 1.0 / 3600.0)
    lhs = left.filter(F.col(left_pos[0]).isNotNull() & F.col(left_pos[1]).isNotNull())
    rhs = right.filter(F.col(right_pos[0]).isNotNull() & F.col(right_pos[1]).isNotNull())
    lhs = with_reachable_cells(lhs, *left_pos, radius_arcsec / 3600.0, cell)
    rhs = with_cell(rhs, *right_pos, cell)
    sep = separation_arcsec(F.col(left_pos[0]), F.col(left_pos[1]), F.col(right_pos[0]), F.col(right_pos[1]))
    return (lhs.join(rhs, ["_zone", "_cell"]).withColumn("sep_arcsec", sep)
            .filter(F.col("sep_arcsec") <= radius_arcsec).drop("_zone", "_cell"))


def counterparts(detections: DataFrame, targets: DataFrame, radius_arcsec: float,
                 cell_per_radius: float = 4.0) -> DataFrame:
    """Per detection position: candidate count, preferred and nearest target.

    `detections` has (ls10_ra, ls10_dec); `targets` has (targetid, target_ra, target_dec, is_main). Both
    sides are reduced to distinct positions first, so copies stacked on one position cost one row each.
    A main-survey target is preferred over a nearer other one; ties go to the smaller id.
    """
    spots = targets.groupBy("target_ra", "target_dec").agg(
        F.count(F.lit(1)).alias("_held"),
        F.min(F.when(F.col("is_main"), F.col("targetid"))).alias("_main"),
        F.min("targetid").alias("_any"))
    places = detections.select("ls10_ra", "ls10_dec").distinct()
    pairs = radius_pairs(places, spots, ("ls10_ra", "ls10_dec"), ("target_ra", "target_dec"),
                         radius_arcsec, cell_per_radius)
    main = F.when(F.col("_main").isNotNull(), F.struct("sep_arcsec", F.col("_main").alias("targetid")))
    near = F.struct("sep_arcsec", F.col("_any").alias("targetid"))
    found = pairs.groupBy("ls10_ra", "ls10_dec").agg(
        F.sum("_held").alias("n_candidates"), F.min(main).alias("_best_main"), F.min(near).alias("_nearest"))
    chosen = F.coalesce("_best_main", "_nearest")
    return found.select(
        "ls10_ra", "ls10_dec", "n_candidates",
        chosen["targetid"].alias("targetid"), chosen["sep_arcsec"].alias("sep_arcsec"),
        F.col("_nearest.targetid").alias("nearest_targetid"),
        F.col("_best_main").isNotNull().alias("to_main"))


# ---- several detections on one target

def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull of points in a plane."""
    order = np.lexsort((y, x))

    def half(indices: np.ndarray) -> list[int]:
        kept: list[int] = []
        for i in indices:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                kept.pop()
            kept.append(int(i))
        return kept

    return np.unique(np.array(half(order) + half(order[::-1]), dtype=int))


def _hull_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows on the hull of a small patch of sky, seen in the tangent plane at its mean direction.

    Great circles are straight lines there, and the farthest pair of a patch lies on its hull.
    """
    xyz = pdf[["_x", "_y", "_z"]].to_numpy()
    centre = xyz.mean(axis=0)
    centre /= np.linalg.norm(centre)
    pole = np.array([0.0, 0.0, 1.0]) if abs(centre[2]) < 0.9 else np.array([1.0, 0.0, 0.0])
    east = np.cross(pole, centre)
    east /= np.linalg.norm(east)
    north = np.cross(centre, east)
    depth = xyz @ centre
    return pdf.iloc[_corners((xyz @ east) / depth, (xyz @ north) / depth)]


def _widest(pdf: pd.DataFrame) -> pd.DataFrame:
    hull = _hull_rows(pdf)
    xyz = hull[["_x", "_y", "_z"]].to_numpy()
    widest = 0.0
    for start in range(0, len(xyz), 1024):
        gaps = xyz[start:start + 1024, None, :] - xyz[None, :, :]
        widest = max(widest, float(np.sqrt((gaps * gaps).sum(axis=2)).max()))
    return pd.DataFrame({"targetid": hull["targetid"].iloc[:1].to_numpy(), "_widest": [widest]})


def shared_groups(matched: DataFrame, split_max_sep_arcsec: float) -> DataFrame:
    """Per target held by two or more detections: row count, and whether it is one split source.

    A group is a split source when no two of its X-ray positions are farther apart than the limit. The
    extent of the group along x, y and z decides almost every group inside one aggregation (for two
    members it is exact); the rest, all smaller than the limit in every axis, are reduced to their hull
    in pieces of bounded size, then in pieces of pieces, before the widest pair is measured.
    """
    x, y, z = unit_vector(F.col("xray_ra"), F.col("xray_dec"))
    placed = matched.select("targetid", "ero_detuid", x.alias("_x"), y.alias("_y"), z.alias("_z"))
    limit = 2.0 * math.sin(math.radians(split_max_sep_arcsec / 3600.0) / 2.0)
    sides = [F.max(c) - F.min(c) for c in ("_x", "_y", "_z")]
    groups = placed.groupBy("targetid").agg(
        F.count(F.lit(1)).alias("members"),
        F.greatest(*sides).alias("_side"),
        F.sqrt(sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2]).alias("_diagonal"),
    ).filter("members > 1")
    inside, outside = F.col("_diagonal") <= limit, (F.col("_side") > limit) | (F.col("members") == 2)
    decided = groups.filter(inside | outside).select("targetid", "members", inside.alias("split_source"))
    unclear = groups.filter(~inside & ~outside).select("targetid", "members")
    pieces = placed.join(unclear, "targetid").withColumn(
        "_piece", F.pmod(F.xxhash64("ero_detuid"), F.ceil(F.col("members") / 4096)))
    pieces = pieces.select("targetid", "_piece", "_x", "_y", "_z")
    hulls = pieces.groupBy("targetid", "_piece").applyInPandas(_hull_rows, pieces.schema)
    hulls = hulls.withColumn("_piece", F.floor(F.col("_piece") / 512))
    hulls = hulls.groupBy("targetid", "_piece").applyInPandas(_hull_rows, pieces.schema)
    widest = hulls.groupBy("targetid").applyInPandas(
        _widest, T.StructType([T.StructField("targetid", T.LongType()), T.StructField("_widest", T.DoubleType())]))
    measured = unclear.join(widest, "targetid").select(
        "targetid", "members", (F.col("_widest") <= limit).alias("split_source"))
    return decided.unionByName(measured)


def resolve_shared_targets(matched: DataFrame, split_max_sep_arcsec: float) -> DataFrame:
    """Add `members`, `split_source` and `kept` to matched rows.

    A split source keeps all its rows, flagged. Any other shared target keeps its best row: highest
    dist_post, then p_any, then the smallest separation, then the smallest detection id.
    """
    def descending(c: str) -> list[Column]:
        return [F.col(c).isNull(), -F.col(c).cast("double")]

    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(
        [*descending("nway_dist_post"), *descending("nway_p_any"), F.col("sep_arcsec"), F.col("ero_detuid")])])
    winners = matched.groupBy("targetid").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    winners = winners.filter("_n > 1").select("targetid", F.col("_first.k5").alias("_winner"))
    verdict = shared_groups(matched, split_max_sep_arcsec).join(winners, "targetid")
    out = matched.join(verdict, "targetid", "left")
    split = F.coalesce(F.col("split_source"), F.lit(False))
    kept = F.col("members").isNull() | split | (F.col("ero_detuid") == F.col("_winner"))
    return (out.withColumn("kept", kept).withColumn("split_source", split)
            .withColumn("members", F.coalesce("members", F.lit(1).cast("long"))).drop("_winner"))
