"""Densities: a Gaussian kernel estimate that scales with its cells, and Gaussian densities from regressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.operators.joins import DataError
from skyframe.session import settle, spread

CELL = 0.125          # cell side, in bandwidths
ORDER = 12            # highest moment kept of a dense cell
FEW = 16              # cells with at most this many points keep the points, which is as exact and cheaper
FAR = 30.0            # beyond this many bandwidths a dense cell is taken to second order
PLACE = 0.75          # side of the cells whose interleaved numbers put rows in order, in bandwidths
BLOCK_ROWS = 4096     # most rows of a block of points
HELD_ROWS = 512       # most rows of a block of the summary
BOX_ROWS = 128        # rows of a box within a block
FAN_BITS = 4          # a box of the tree covers 16 boxes of the level below
HOME = 8              # blocks nearest to a block of points, which bound its sums from below
SLOTS = 16            # tasks among which a block of points deals what it meets
TOLERANCE = 1e-7      # share of a kernel sum that what is too far away to be looked at may hold
MAX_TERMS = 2_000_000
SIDE = 1.0            # side, in bandwidths, of the squares in which many points are interpolated
KNOTS = 16            # Chebyshev knots per side of a square
SETTLED = 1e-7        # last coefficients of a square, as a share of its smallest value, up to which it is interpolated
PIECE_ROWS = 65_536   # points of a square that one task interpolates at a time


class Density(Protocol):
    """What scoring asks of a density: ln p at points given by columns, NULL where a coordinate is missing."""

    def scored(self, df: DataFrame, columns: Sequence[Column], name: str) -> DataFrame: ...


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and sample covariance of every pair of columns, in one row."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}{j}") for i, j in pairs])


def covariance_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, covariance) for each pair of columns."""
    row = covariance(df, columns)
    entries = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"c{i}{j}").alias("covariance"))
               for i in range(len(columns)) for j in range(i, len(columns))]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def _powers(d: int) -> list[tuple[int, ...]]:
    return [a for a in product(range(ORDER + 1), repeat=d) if sum(a) <= ORDER]


def _kernel_sums(u: np.ndarray, summary: dict, far: float = FAR) -> np.ndarray:
    """ln of the kernel sum at whitened points u (rows, d), over exact points and dense-cell moments."""
    points, centres, moments = summary["points"], summary["centres"], summary["moments"]
    d = u.shape[1]
    out = np.full(len(u), -np.inf)
    width = max(1, MAX_TERMS // max(1, len(points) + len(centres) * (ORDER + 1)))
    for start in range(0, len(u), width):
        x = u[start:start + width]
        terms = []
        if len(points):
            square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2.0 * (x @ points.T)
            terms.append(summary["weights"] - 0.5 * np.maximum(square, 0.0))
        if len(centres):
            y = x[:, None, :] - centres[None, :, :]
            square = (y * y).sum(axis=2)
            hermite = np.empty((ORDER + 1, *y.shape))
            hermite[0], hermite[1] = 1.0, y
            for k in range(2, ORDER + 1):
                hermite[k] = y * hermite[k - 1] - (k - 1) * hermite[k - 2]
            series = np.zeros(square.shape)
            for alpha, weight in moments.items():
                series += weight * reduce(np.multiply, [hermite[a][..., i] for i, a in enumerate(alpha)])
            n, mean, variance = summary["count"], summary["mean"], summary["variance"]
            second = np.log(n) + (y * mean).sum(axis=2) + 0.5 * (y * y * variance).sum(axis=2)
            near = (square <= far * far) & (series > 0)
            terms.append(np.where(near, np.log(np.where(near, series, 1.0)), second) - 0.5 * square)
        every = np.concatenate(terms, axis=1)
        top = every.max(axis=1)
        out[start:start + width] = top + np.log(np.exp(every - top[:, None]).sum(axis=1))
    return out


@dataclass
class GaussianKDE:
    """Gaussian kernel estimate at Scott's bandwidth times a multiplier, in one to four dimensions.

    Training points are whitened so the kernel is round. In one and two dimensions they are counted in cells an eighth of a bandwidth wide, and a
    cell of more than `few` points is replaced by its moments (Hermite series, relative error below 1e-6 out to `far` bandwidths); in three and four,
    equal points are merged. What is left is put in the order of interleaved cell numbers and written as a stage table of blocks of near rows, each
    with the boxes of its runs of 128 rows. Points to be scored become blocks in the same way. The two trees of boxes meet level by level in equality
    joins, from one pair of roots down; a pair that can't hold a tolerated share of a sum goes no further. Each block of points first adds up its
    nearest blocks, which bounds its sums from below and tells what else it must look at, down to single boxes. Nothing is collected and no table is
    sent to tasks whole, so one path serves every number of rows and of dimensions.

    In one and two dimensions, squares a bandwidth wide with far more points than knots are added up at Chebyshev knots, and their points are
    interpolated: the sum times exp(|u|^2 / 2), less its slope, is smooth there. A square whose last coefficients are not small has its points added
    up one by one, as those of all other squares are.
    """

    columns: tuple[str, ...]
    n: int
    whitener: np.ndarray
    log_norm: float
    blocks: DataFrame
    size: int
    tolerance: float = TOLERANCE
    far: float = FAR

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str], bandwidth: float = 1.0, tolerance: float = TOLERANCE, few: int = FEW,
            far: float = FAR) -> GaussianKDE:
        if not bandwidth > 0:
            raise ValueError(f"bandwidth must be positive, got {bandwidth}")
        d = len(columns)
        complete = train.select(*columns).dropna()
        row = covariance(complete, columns).first()
        if row["n"] < 2:
            raise DataError(f"a density over {list(columns)} has {row['n']} complete training rows")
        matrix = np.array([[row[f"c{min(i, j)}{max(i, j)}"] for j in range(d)] for i in range(d)])
        lower = np.linalg.cholesky(matrix * (row["n"] ** (-1.0 / (d + 4)) * bandwidth) ** 2)
        whitener = np.linalg.inv(lower)
        log_norm = -0.5 * d * math.log(2 * math.pi) - float(np.log(np.diag(lower)).sum()) - math.log(row["n"])
        whitened = complete.select(*[_combine([F.col(c) for c in columns], whitener[i]).alias(f"_w{i}") for i in range(d)])
        cells = _summarize(whitened, d, few)
        centre = [(F.get("cell", F.lit(i)) + 0.5) * CELL for i in range(d)]
        blocks, size = _numbered(_blocks(cells, centre, d, _summary_block(d), HELD_ROWS))
        return cls(tuple(columns), row["n"], whitener, log_norm, blocks, size, tolerance, far)

    def scored(self, df: DataFrame, columns: Sequence[Column], name: str) -> DataFrame:
        """df with ln density at the points that the columns give. Equal points are scored once."""
        d = len(self.columns)
        white = [_combine(columns, self.whitener[i]) for i in range(d)]
        # rows without a point get keys of their own, which no point has
        apart = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]).cast("double")
        apart = (F.abs(apart) + 1.0e10) * 1.0e30
        keyed = df.withColumns({f"_k{i}": F.coalesce(white[i], apart) for i in range(d)})
        points = df.select(*[white[i].alias(f"_w{i}") for i in range(d)]).dropna().distinct()
        found = self._sums(points).select(*[F.col(f"_w{i}").alias(f"_f{i}") for i in range(d)], (F.col("log_sum") + self.log_norm).alias(name))
        same = reduce(lambda a, b: a & b, [F.col(f"_k{i}") == F.col(f"_f{i}") for i in range(d)])
        return keyed.join(found, same, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)

    def _sums(self, points: DataFrame) -> DataFrame:
        """(_w0.., log_sum) of distinct whitened points."""
        d = len(self.columns)
        if d > 2:
            return self._direct(points)
        names, squares = [f"_w{i}" for i in range(d)], [f"_c{i}" for i in range(d)]
        placed = settle(points.withColumns({c: F.floor(F.col(w) / SIDE) for c, w in zip(squares, names)}))
        crowded = settle(placed.groupBy(*squares).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 2 * KNOTS**d))
        if crowded.isEmpty():
            return self._direct(placed.select(*names))
        place = F.array(*[F.lit(float(t)) for t in _knots()])
        knots = crowded.select(*squares, F.explode(F.sequence(F.lit(0), F.lit(KNOTS**d - 1))).alias("_j"))
        knots = knots.select(*[((F.col(c) + 0.5 + 0.5 * F.get(place, F.expr(f"CAST(_j DIV {KNOTS**i} % {KNOTS} AS INT)"))) * SIDE).alias(w)
                               for i, (c, w) in enumerate(zip(squares, names))])
        found = self._direct(knots).groupBy(*[F.floor(F.col(w) / SIDE).alias(c) for c, w in zip(squares, names)]).agg(
            F.sort_array(F.collect_list(F.struct(*names, "log_sum"))).alias("_k"))
        series = spread(found.select(*squares, F.col("_k.log_sum").alias("_l")), *squares).mapInPandas(_series(d), ", ".join(f"{c} long" for c in squares) + ", _series binary")
        smooth = settle(series.join(crowded, squares).withColumn("_pieces", F.ceil(F.col("_n") / PIECE_ROWS).cast("int")))
        rest = self._direct(placed.join(smooth, squares, "left_anti").select(*names))
        piece = F.pmod(F.xxhash64(*names), "_pieces").cast("int").alias("_piece")
        inside = placed.join(smooth.select(*squares, "_pieces"), squares).select(*squares, piece, F.lit(1).alias("_kind"), *names, F.lit(None).cast("binary").alias("_series"))
        first = smooth.select(*squares, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"), F.lit(0).alias("_kind"),
                              *[F.lit(None).cast("double").alias(w) for w in names], "_series")
        rows = spread(first.unionByName(inside), *squares, "_piece").sortWithinPartitions(*squares, "_piece", "_kind")
        read = rows.mapInPandas(_interpolated(d), ", ".join(f"{w} double" for w in names) + ", log_sum double")
        return read.unionByName(rest)

    def _direct(self, points: DataFrame) -> DataFrame:
        """(_w0.., log_sum), every point added up on its own."""
        d = len(self.columns)
        asked, size = _numbered(_blocks(points, [F.col(f"_w{i}") for i in range(d)], d, _point_block(d), BLOCK_ROWS))
        levels = max(1, math.ceil(math.log(max(size, self.size, 2), 1 << FAN_BITS)))
        spare = math.log(self.tolerance / (levels + 1))
        near = _near_blocks(asked, self.blocks, d, levels, spare)
        order = Window.partitionBy("q").orderBy(F.col("most").desc(), "apart", "t")
        placed = settle(near.withColumn("_rank", F.row_number().over(order)))
        home = _added(_met(placed.filter(F.col("_rank") <= HOME).select("q", "t"), asked.withColumn("floor", F.lit(b"")), self.blocks), d, -math.inf, self.far)
        ready = settle(asked.join(home, F.col("node") == F.col("q")).select("node", "low", "high", "points", "moments", "boxes", F.col("total").alias("floor")))
        # at most this share may be lost in each of all boxes together
        rest = spare - math.log(max(1, self.size) * (HELD_ROWS / BOX_ROWS + 2))
        others = placed.filter(F.col("_rank") > HOME).select("q", "t")
        others = others.join(ready.select(F.col("node").alias("q"), "boxes", "floor"), "q").join(
            self.blocks.select(F.col("node").alias("t"), "n", "low", "high"), "t").mapInArrow(_may_matter(d, rest), "q long, t long")
        more = _added(_met(others, ready, self.blocks), d, rest, self.far)
        both = ready.join(more, F.col("node") == F.col("q"), "left").select("points", "floor", "total")

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x, total = np.frombuffer(batch.column(0)[i].as_py()).reshape(-1, d + 1), np.frombuffer(batch.column(1)[i].as_py())
                    further = batch.column(2)[i].as_py()
                    total = total if further is None else np.logaddexp(total, np.frombuffer(further))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(d)), pa.array(total)], names=[*[f"_w{k}" for k in range(d)], "log_sum"])

        return both.mapInArrow(spell, ", ".join(f"_w{k} double" for k in range(d)) + ", log_sum double")


def _knots() -> np.ndarray:
    """Chebyshev knots in (-1, 1), rising."""
    return -np.cos((2 * np.arange(KNOTS) + 1) * math.pi / (2 * KNOTS))


def _at_knots(d: int) -> np.ndarray:
    """Places of a square's knots, the last coordinate fastest: (knots, d)."""
    return np.stack(np.meshgrid(*[_knots()] * d, indexing="ij"), axis=-1).reshape(-1, d)


def _series(d: int):
    """Of rows (square, log sums at its knots in order) those that a Chebyshev series of sum * exp(|u|^2 / 2 - slope * t) is exact enough for.

    The series is a binary of the largest exponent, the slopes and the coefficients.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _at_knots(d)
        terms = np.polynomial.chebyshev.chebvander(_knots(), KNOTS - 1).T * (2.0 / KNOTS)
        terms[0] /= 2.0
        for pdf in batches:
            squares, packed = pdf.iloc[:, :d].to_numpy(np.int64), []
            for square, sums in zip(squares, pdf["_l"]):
                u = (square + 0.5 + 0.5 * t) * SIDE
                level = np.asarray(sums, dtype=float) + 0.5 * (u * u).sum(axis=1)
                slope = (level @ t) / (t * t).sum(axis=0)
                level = level - t @ slope
                top = level.max()
                values = np.exp(level - top)
                held = values.reshape((KNOTS,) * d)
                for axis in range(d):
                    held = np.moveaxis(np.tensordot(terms, held, axes=(1, axis)), 0, axis)
                last = sum(np.abs(np.take(held, [KNOTS - 2, KNOTS - 1], axis=axis)).sum() for axis in range(d))
                packed.append(np.concatenate(([top], slope, held.ravel())).tobytes() if last <= SETTLED * values.min() else None)
            out = pdf.iloc[:, :d].assign(_series=packed)
            yield out[out["_series"].notna()]

    return run


def _interpolated(d: int):
    """Points of sorted rows (square, piece, kind, point, series), where a row of kind 0 brings the series of the points after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, series = [f"_w{i}" for i in range(d)], None
        value = (np.polynomial.chebyshev.chebval, np.polynomial.chebyshev.chebval2d)[d - 1]
        for pdf in batches:
            heads = np.flatnonzero(pdf["_kind"].to_numpy() == 0)
            points, squares = pdf[names].to_numpy(float), pdf.iloc[:, :d].to_numpy(np.int64)
            for at, end in zip((0, *heads), (*heads, len(pdf))):
                if at in heads and pdf["_kind"].iat[at] == 0:
                    series, at = np.frombuffer(pdf["_series"].iat[at]), at + 1
                if at >= end:
                    continue
                u = points[at:end]
                t = (u / SIDE - squares[at] - 0.5) * 2.0
                sums = value(*t.T, series[1 + d:].reshape((KNOTS,) * d))
                yield pd.DataFrame(u, columns=names).assign(log_sum=np.log(sums) + series[0] + t @ series[1:1 + d] - 0.5 * (u * u).sum(axis=1))

    return run


def _square(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _code(place: Sequence[str], d: int) -> Column:
    """Interleaved bits of the numbers of the cell that holds a place: near places have near codes. Cells beyond the last number share it."""
    bits = min(20, 60 // d)
    middle = 1 << (bits - 1)
    cells = [F.least(F.greatest(F.floor(F.col(p) / PLACE), F.lit(-middle)), F.lit(middle - 1)) + middle for p in place]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), k * d + i)
                                                for i, c in enumerate(cells) for k in range(bits)])


BLOCK = "part int, number long, n double, low array<double>, high array<double>, points binary, moments binary, boxes binary"


def _blocks(rows: DataFrame, place: Sequence[Column], d: int, pack: Callable[[pd.DataFrame], list], most: int) -> DataFrame:
    """Rows as blocks of near rows. A block ends where the code jumps most, between half and all of its allowed rows."""
    names = [f"_x{i}" for i in range(d)]
    coded = rows.withColumns(dict(zip(names, place)))
    coded = coded.withColumn("_code", _code(names, d))
    order = ["_code", *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, waiting = TaskContext.get().partitionId(), 0, [], 0

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            return pd.DataFrame([[part, number - 1, *pack(pdf)]], columns=["part", "number", "n", "low", "high", "points", "moments", "boxes"])

        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting <= most:
                continue
            pdf, at = pd.concat(held, ignore_index=True), 0
            codes = pdf["_code"].to_numpy(np.int64)
            jumps = np.concatenate(([0], codes[1:] ^ codes[:-1]))
            while len(pdf) - at > most:
                cut = at + most // 2 + int(np.argmax(jumps[at + most // 2:at + most + 1]))
                yield packed(pdf.iloc[at:cut])
                at = cut
            held, waiting = [pdf.iloc[at:]], len(pdf) - at
        if waiting:
            yield packed(pd.concat(held, ignore_index=True))

    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, BLOCK)


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks as a stage table with consecutive numbers (node) along their order, and how many there are."""
    kept, total, offsets = settle(blocks), 0, []
    for row in kept.groupBy("part").count().orderBy("part").collect():  # one row per partition
        offsets.append((row["part"], total))
        total += row["count"]
    first = kept.sparkSession.createDataFrame(offsets, "part int, _offset long")
    return kept.join(F.broadcast(first), "part").select((F.col("_offset") + F.col("number")).alias("node"), "n", "low", "high", "points", "moments", "boxes"), total


def _level(blocks: DataFrame, d: int, height: int, name: str) -> DataFrame:
    """Boxes of one level of the tree: name, its parent, rows, corners."""
    corners = [f(F.get(side, F.lit(i))).alias(f"{name}_{side}{i}") for f, side in ((F.min, "low"), (F.max, "high")) for i in range(d)]
    boxes = blocks.groupBy(F.shiftright("node", FAN_BITS * height).alias(name)).agg(F.sum("n").alias(f"{name}_n"), *corners)
    return boxes.withColumn(f"{name}_parent", F.shiftright(name, FAN_BITS))


def _near_blocks(asked: DataFrame, held: DataFrame, d: int, levels: int, spare: float) -> DataFrame:
    """q, t, most, apart: pairs of a block of points and a block of data that may hold more than the tolerated share of a sum.

    Level by level from the roots, by equality with the pairs of parents: `most` and `least` bound what a box adds to any point of the other.
    """
    near = None
    for height in reversed(range(levels)):
        mine, theirs = _level(asked, d, height, "q"), _level(held, d, height, "t")
        if near is None:
            met = mine.join(theirs, F.col("q_parent") == F.col("t_parent"))  # the roots: both parents are 0
        else:
            above = near.select(F.col("q").alias("q_parent"), F.col("t").alias("t_parent"))
            met = above.join(mine, "q_parent").join(theirs, "t_parent")
        corner = lambda side, name, i: F.col(f"{name}_{side}{i}")
        gaps = [F.greatest(F.lit(0.0), corner("low", "t", i) - corner("high", "q", i), corner("low", "q", i) - corner("high", "t", i)) for i in range(d)]
        spans = [F.greatest(corner("high", "t", i) - corner("low", "q", i), corner("high", "q", i) - corner("low", "t", i)) for i in range(d)]
        between = [(corner("high", "t", i) + corner("low", "t", i) - corner("high", "q", i) - corner("low", "q", i)) / 2 for i in range(d)]
        bounds = met.select("q", "t", (F.ln("t_n") - 0.5 * _square(gaps)).alias("most"), (F.ln("t_n") - 0.5 * _square(spans)).alias("least"),
                            _square(between).alias("apart"))
        every = Window.partitionBy("q")
        floor = F.max("least").over(every) + spare - F.ln(F.count(F.lit(1)).over(every))
        near = bounds.withColumn("_floor", floor).filter(F.col("most") >= F.col("_floor")).select("q", "t", "most", "apart")
    return near


def _met(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """q, slot, kind, points, moments, boxes, floor: a block of points (kind 0) once per slot, then the blocks it meets there (kind 1)."""
    dealt = pairs.withColumn("slot", F.pmod("t", F.lit(SLOTS)).cast("int"))
    first = asked.join(dealt.select("q", "slot").distinct(), F.col("node") == F.col("q")).select(
        "q", "slot", F.lit(0).alias("kind"), "points", "moments", "boxes", "floor")
    then = held.join(dealt, F.col("node") == F.col("t")).select("q", "slot", F.lit(1).alias("kind"), "points", "moments", "boxes", F.lit(b"").alias("floor"))
    # by number, since a pair costs far more than its bytes tell
    return spread(first.union(then), "q", "slot").sortWithinPartitions("q", "slot", "kind")


def _added(met: DataFrame, d: int, rest: float, far: float) -> DataFrame:
    """(q, total): the log of what the met blocks add to each point of block q. Boxes that can't hold a share of exp(rest) of a sum are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, points, own, floor, total = None, None, None, None, None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["q", "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                q, slot, kind, data, moments, boxes, bound = (batch.column(k)[i].as_py() for k in range(7))
                if kind == 0:
                    if last is not None:
                        yield found()
                    last, points = (q, slot), np.frombuffer(data).reshape(-1, d + 1)[:, :d]
                    own, total = _box_table(boxes, d), np.full(len(points), -np.inf)
                    sums = np.frombuffer(bound) if bound else np.full(len(points), -np.inf)
                    floor = np.array([sums[int(b[1]):int(b[2])].min() + rest if bound else -np.inf for b in own])
                    continue
                tables, theirs = _tables(data, moments, d), _box_table(boxes, d)
                near = _most(own, theirs, d) >= floor[:, None]
                for box, row in zip(own, near):
                    if row.any():
                        lo, hi = int(box[1]), int(box[2])
                        total[lo:hi] = np.logaddexp(total[lo:hi], _kernel_sums(points[lo:hi], _part_of(tables, theirs[row]), far))
        if last is not None:
            yield found()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        parts = np.stack([np.frombuffer(p) for p in table.column("part").to_pylist()])  # one row per slot
        return pa.table({"q": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([np.logaddexp.reduce(parts, axis=0).tobytes()], pa.binary())})

    return met.mapInArrow(run, "q long, part binary").groupBy("q").applyInArrow(add, "q long, total binary")


def _may_matter(d: int, rest: float):
    """Of pairs (t, q, boxes and sums so far of q, rows and corners of t) those where t may hold a share of exp(rest) of the sum of some point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                own, sums = _box_table(row["boxes"], d), np.frombuffer(row["floor"])
                floor = np.array([sums[int(b[1]):int(b[2])].min() + rest for b in own])
                theirs = np.array([[0.0, 0.0, 0.0, row["n"], *row["low"], *row["high"]]])
                keep.append(bool((_most(own, theirs, d)[:, 0] >= floor).any()))
            good = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([good.column("q"), good.column("t")], names=["q", "t"])

    return run


def _box_table(boxes: bytes, d: int) -> np.ndarray:
    """Rows: whether moments (1) or points (0), first and last row, training rows, low corner, high corner."""
    return np.frombuffer(boxes).reshape(-1, 4 + 2 * d)


def _most(mine: np.ndarray, theirs: np.ndarray, d: int) -> np.ndarray:
    """The log of the most that each of their boxes adds to a point of each of mine."""
    gap = np.maximum(0.0, np.maximum(theirs[None, :, 4:4 + d] - mine[:, None, 4 + d:], mine[:, None, 4:4 + d] - theirs[None, :, 4 + d:]))
    return np.log(theirs[:, 3])[None, :] - 0.5 * (gap * gap).sum(axis=2)


def _boxes(kind: int, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    rows = [[kind, at, min(len(n), at + BOX_ROWS), n[at:at + BOX_ROWS].sum(), *low[at:at + BOX_ROWS].min(axis=0), *high[at:at + BOX_ROWS].max(axis=0)]
            for at in range(0, len(n), BOX_ROWS)]
    return np.array(rows, dtype=float).reshape(len(rows), 4 + 2 * low.shape[1])


def _part_of(tables: dict, boxes: np.ndarray) -> dict:
    """The tables' rows that lie in these boxes."""
    points, dense = (np.concatenate([np.arange(int(b[1]), int(b[2])) for b in boxes if b[0] == kind] or [np.zeros(0, dtype=int)]) for kind in (0, 1))
    out = {"points": tables["points"][points], "weights": tables["weights"][points], "centres": tables["centres"][dense], "moments": {}}
    if len(dense):
        out |= {"moments": {a: v[dense] for a, v in tables["moments"].items()}} | {k: tables[k][dense] for k in ("count", "mean", "variance")}
    return out


def _point_block(d: int) -> Callable[[pd.DataFrame], list]:
    def pack(pdf: pd.DataFrame) -> list:
        x = pdf[[f"_w{i}" for i in range(d)]].to_numpy(float)
        return [float(len(x)), x.min(axis=0), x.max(axis=0), np.column_stack((x, np.zeros(len(x)))).tobytes(), b"", _boxes(0, x, x, np.ones(len(x))).tobytes()]

    return pack


def _summary_block(d: int) -> Callable[[pd.DataFrame], list]:
    """points: coordinates and the log of the copies; moments: cell centre and moments."""

    def pack(pdf: pd.DataFrame) -> list:
        n = pdf["n"].to_numpy(float)
        single = pdf["values"].map(len).to_numpy() == d if d > 2 else n == 1
        points = np.stack(pdf["values"][single]) if single.any() else np.empty((0, d))
        centre = pdf[[f"_x{i}" for i in range(d)]].to_numpy(float)[~single]
        moments = np.column_stack((centre, np.stack(pdf["values"][~single]))) if len(centre) else np.empty((0, 0))
        boxes = np.concatenate((_boxes(0, points, points, n[single]), _boxes(1, centre - CELL / 2, centre + CELL / 2, n[~single])))
        return [float(n.sum()), boxes[:, 4:4 + d].min(axis=0), boxes[:, 4 + d:].max(axis=0), np.column_stack((points, np.log(n[single]))).tobytes(),
                moments.tobytes(), boxes.tobytes()]

    return pack


def _combine(columns: Sequence[Column], weights: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("double") * float(w) for c, w in zip(columns, weights)])


def _summarize(whitened: DataFrame, d: int, few: int = FEW) -> DataFrame:
    """Rows (cell, n, values): the points of sparse cells one by one (n = 1), the moments of dense ones."""
    coordinates = [F.col(f"_w{i}") for i in range(d)]
    placed = whitened.withColumn("cell", F.array(*[F.floor(c / CELL) for c in coordinates]))
    point = F.array(*coordinates)
    if d > 2:
        return placed.groupBy("cell", point.alias("values")).agg(F.count(F.lit(1)).alias("n"))
    offsets = [c - (F.get("cell", F.lit(i)) + 0.5) * CELL for i, c in enumerate(coordinates)]
    sums = []
    for alpha in _powers(d):
        factors = [offsets[i] for i, a in enumerate(alpha) for _ in range(a)]
        scale = math.prod(math.factorial(a) for a in alpha)
        sums.append(F.sum(reduce(lambda x, y: x * y, factors, F.lit(1.0))) / float(scale))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    dense = placed.join(counts.filter(F.col("_n") > few), "cell")
    moments = dense.groupBy("cell").agg(F.array(*sums).alias("values"), F.count(F.lit(1)).alias("n"))
    sparse = placed.join(counts.filter(F.col("_n") <= few), "cell").select("cell", point.alias("values"), F.lit(1).cast("long").alias("n"))
    return moments.unionByName(sparse)


def _tables(points: bytes, moments: bytes, d: int) -> dict:
    """Numpy tables of a block: points with the log of their copies, and moments of dense cells."""
    x = np.frombuffer(points).reshape(-1, d + 1)
    out = {"points": x[:, :d], "weights": x[:, d], "centres": np.empty((0, d)), "moments": {}}
    if not moments:
        return out
    powers = _powers(d)
    rows = np.frombuffer(moments).reshape(-1, d + len(powers))
    values = rows[:, d:]
    n = values[:, powers.index((0,) * d)]
    unit = [tuple(int(i == k) for i in range(d)) for k in range(d)]
    first = np.column_stack([values[:, powers.index(a)] for a in unit]) / n[:, None]
    second = np.column_stack([values[:, powers.index(tuple(2 * i for i in a))] * 2.0 for a in unit]) / n[:, None]
    return out | {"centres": rows[:, :d], "moments": {a: values[:, k] for k, a in enumerate(powers)}, "count": n, "mean": first,
                  "variance": np.maximum(second - first * first, 0.0)}


@dataclass(frozen=True)
class NormalDensity:
    """Independent normal densities, one per dimension."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def _one(self, u: Column, i: int) -> Column:
        t = (u - self.mean[i]) / self.scale[i]
        return -0.5 * t * t - (math.log(self.scale[i]) + 0.5 * math.log(2 * math.pi))

    def log_prob(self, columns: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, [self._one(c, i) for i, c in enumerate(columns)])

    def scored(self, df: DataFrame, columns: Sequence[Column], name: str) -> DataFrame:
        return df.withColumn(name, self.log_prob(columns))

    def of_points(self) -> Callable[[np.ndarray], np.ndarray]:
        mean, scale = np.array(self.mean), np.array(self.scale)
        level = -np.log(scale).sum() - 0.5 * len(mean) * math.log(2 * math.pi)
        return lambda points: level - 0.5 * (((points - mean) / scale) ** 2).sum(axis=1)


@dataclass(frozen=True)
class CorrelatedNormal:
    """A normal density around zero with a full covariance."""

    covariance: tuple[tuple[float, ...], ...]

    def of_points(self) -> Callable[[np.ndarray], np.ndarray]:
        lower = np.linalg.cholesky(np.array(self.covariance))
        inverse = np.linalg.inv(lower)
        level = -np.log(np.diag(lower)).sum() - 0.5 * len(lower) * math.log(2 * math.pi)
        return lambda points: level - 0.5 * ((points @ inverse.T) ** 2).sum(axis=1)
