"""Order-based operators that never sort a whole table in one task: ranks, quantiles, rolling means."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.core import hash_uniform
from skyframe.operators.joins import require_unique
from skyframe.session import settle, spread

BUCKET_DIGITS = 3
ROW_BITS = 33
KEYS_AT_ONCE = 512    # keys whose weights a task draws at once
DIGESTS_AT_ONCE = 8192  # digests a task takes at once
GROUPS_HELD = 512     # groups whose sums a task holds
BAND_ROWS = 256       # ranks of a block of the rolling band, at least
MOST_BAND_ROWS = 8192
CHAIN_BLOCKS = 16     # blocks of a chain of the rolling band that a task takes at a time
MOVES_AT_ONCE = 128   # windows of the rolling band whose sums a task holds


def shuffled_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add `rank` (0-based, a seeded shuffle of unique keys) and `total`; repeated keys are an error.

    The order is md5(seed:key). Its leading digits are 4,096 even buckets: one count per bucket gives
    each bucket's offset, and rows are numbered inside their bucket only.
    """
    require_unique(df, [key], "keys to shuffle")
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_bucket", _before("_size", "_bucket").alias("_offset"),
                           F.sum("_size").over(every).alias("total"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    ranked = hashed.join(F.broadcast(offsets), "_bucket")  # at most 16^3 rows
    return (ranked.withColumn("rank", F.col("_offset") + F.row_number().over(inside) - 1)
            .drop("_hash", "_bucket", "_offset"))


def _before(column: str, order: str) -> Column:
    """Sum of a column over the earlier rows of a table with one row per bucket or partition."""
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def ordered_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the exact 0-based position of each row in the total order of `order` (which must be unique).

    One range shuffle; positions inside a partition are written down in a stage table before the
    partition offsets are counted, so retries cannot renumber rows.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = settle(placed).withColumn("_part", F.shiftright("_at", ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", _before("_size", "_part").alias("_offset"))
    local = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("long"))
    return (placed.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(name, F.col("_offset") + local).drop("_part", "_at", "_offset"))


def running_total(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add running totals (doubles) of never-NULL numbers along the global order of `order`.

    Totals run inside each range partition, are written down in a stage table, and are then shifted by
    the sums of the partitions before theirs.
    """
    names = list(sums)
    parts = df.select("*", *[sums[n].cast("double").alias(f"_add_{n}") for n in names],
                      *[F.lit(0.0).alias(n) for n in names]).repartitionByRange(*order)
    parts = parts.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    added = [f"_add_{n}" for n in names]

    def accumulate(batches):
        carried = np.zeros(len(names))
        for pdf in batches:
            if len(pdf):
                totals = np.cumsum(pdf[added].to_numpy(float), axis=0) + carried
                carried = totals[-1]
                pdf[names] = totals
            yield pdf

    local = settle(parts.mapInPandas(accumulate, parts.schema))
    ends = local.groupBy("_part").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in names])
    shifts = ends.select("_part", *[_before(f"_sum_{n}", "_part").alias(f"_shift_{n}") for n in names])
    shifted = local.join(F.broadcast(shifts), "_part")  # one row per partition
    return shifted.select(*df.columns, *[(F.col(n) + F.col(f"_shift_{n}")).alias(n) for n in names])


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group, as rows (by..., n, q, value).

    Equal values are counted first, then placed in one global order. A group of any size is counted and
    looked up by position; it is never gathered.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_copies"))
    placed = running_total(counted, [*by, "_v"], {"_through": F.col("_copies")})
    placed = placed.withColumn("_from", F.col("_through") - F.col("_copies"))
    spans = placed.groupBy(*by).agg(F.min("_from").alias("_start"), F.sum("_copies").alias("n"))
    ends = []
    for q in quantiles:
        position = F.lit(float(q)) * (F.col("n") - 1)
        below = F.floor(position)
        ends.append(F.struct(F.lit(float(q)).alias("q"), (F.col("_start") + below).alias("i"), (1 - (position - below)).alias("w")))
        ends.append(F.struct(F.lit(float(q)).alias("q"), (F.col("_start") + below + 1).alias("i"), (position - below).alias("w")))
    wanted = spans.select(*by, "n", F.array(*ends).alias("_ends"))
    joined = placed.join(wanted, by) if by else placed.join(F.broadcast(wanted))  # one row without groups
    inside = F.filter("_ends", lambda e: (e["i"] >= F.col("_from")) & (e["i"] < F.col("_through")) & (e["w"] > 0))
    hits = joined.select(*by, "n", "_v", F.explode(inside).alias("_e"))
    return hits.groupBy(*by, "n", F.col("_e.q").alias("q")).agg(F.sum(F.col("_e.w") * F.col("_v")).alias("value"))


def small_group_quantiles(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str]) -> DataFrame:
    """As `quantile_columns`, in one shuffle by group: for many groups of bounded size, such as the draws of a source."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.lit(list(named.values()))).alias("_q"))
    return found.select(*by, "n", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(named)])


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str]) -> DataFrame:
    """Quantiles per group as named columns (by..., n, names...), for groups of any size."""
    long = exact_quantiles(df, value, list(named.values()), by)
    picks = [F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name) for name, q in named.items()]
    return long.groupBy(*by, "n").agg(*picks)


# ---- resampling

def poisson_weight(*parts: Column | str | int) -> Column:
    """A reproducible Poisson(1) weight: the inverse distribution function at a hashed uniform."""
    u = hash_uniform(*parts)
    through, weight = 0.0, None
    for k in range(12):
        through += math.exp(-1.0) / math.factorial(k)
        below = u < F.lit(through)
        weight = F.when(below, k) if weight is None else weight.when(below, k)
    return weight.otherwise(12)


def replicate_weights(keys: Sequence[str], replicates: int, seed: int) -> np.ndarray:
    """`poisson_weight(seed, replicate, key)` of every key and replicate, as small whole numbers: (keys, replicates).

    Heads and keys of one length give texts of one layout, whose digests are taken many at a time.
    """
    out = np.zeros((len(keys), replicates), dtype=np.uint8)
    heads, names = _by_length([f"{seed}:{r}:".encode() for r in range(replicates)]), _by_length([k.encode() for k in keys])
    for (h, (cells, head)), (k, (rows, name)) in product(heads.items(), names.items()):
        step = max(1, DIGESTS_AT_ONCE // len(cells))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            text = np.zeros((len(some), len(cells), h + k), dtype=np.uint8)
            text[:, :, :h], text[:, :, h:] = head[None], name[at:at + step, None]
            out[np.ix_(some, cells)] = _weights_of(_digest_starts(text.reshape(-1, h + k))).reshape(len(some), len(cells))
    return out


def _by_length(texts: Sequence[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the places of its texts and their bytes as a rectangle."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    found = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    return {n: (at, np.frombuffer(b"".join(texts[i] for i in at), dtype=np.uint8).reshape(len(at), n)) for n, at in found.items()}


def _weights_of(starts: np.ndarray) -> np.ndarray:
    """Poisson(1) weights at uniforms given as whole numbers below 2^32."""
    weight = np.zeros(len(starts), dtype=np.uint8)
    for edge in np.ceil(np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)]) * 4294967296.0):
        if edge < 4294967296.0:
            weight += starts >= np.uint32(edge)
    return weight


_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]


def _digest_starts(texts: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of each row of bytes, as numbers."""
    n, length = texts.shape
    if length > 55:  # more than one block
        return np.frombuffer(b"".join(hashlib.md5(t.tobytes()).digest()[:4] for t in texts), dtype=">u4").astype(np.uint32)
    used = length // 4 + 1
    padded = np.zeros((n, 4 * used), dtype=np.uint8)
    padded[:, :length], padded[:, length] = texts, 0x80
    words = np.ascontiguousarray(padded.view("<u4").T)
    a, b, c, d = (np.full(n, start, dtype=np.uint32) for start in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(61):  # the last three steps leave what becomes the first word as it is
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += np.uint32((_SINES[i] + (8 * length if at == 14 else 0)) & 0xFFFFFFFF)
        if at < used:
            f += words[at]
        turn = int(_TURNS[i])
        np.left_shift(f, np.uint32(turn), out=turned), np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def _resampled_sums(by: list[str], replicates: int, seed: int):
    """Per task and group the weighted sums and the weights of every replicate, as two vectors. Rows of a key follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=by) if by else pd.DataFrame(index=range(len(held)))
            return out.assign(_wy=[list(v[0]) for v in held.values()], _w=[list(v[1]) for v in held.values()])

        for pdf in batches:
            if not len(pdf):
                continue
            codes, names = pd.factorize(pdf["_key"])
            for at in range(0, len(names), KEYS_AT_ONCE):
                weights = replicate_weights(names[at:at + KEYS_AT_ONCE], replicates, seed).astype(float)
                some = np.flatnonzero((codes >= at) & (codes < at + KEYS_AT_ONCE))
                part = pdf.iloc[some].reset_index(drop=True)
                groups = part.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(part))}
                own, values = codes[some] - at, part["_y"].to_numpy(float)
                per_key = [f(own[which], which) for which in groups.values() for f in (
                    lambda k, which: np.bincount(k, np.nan_to_num(values[which]), len(weights)), lambda k, which: np.bincount(k, minlength=len(weights)))]
                added = (np.array(per_key, dtype=float) @ weights).reshape(-1, 2, replicates)
                for group, sums in zip(groups, added):
                    name = group if isinstance(group, tuple) else (group,)
                    total = held.setdefault(name, np.zeros((2, replicates)))
                    total += sums
                if len(held) > GROUPS_HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


def bootstrap_se(df: DataFrame, value: str, key: str, by: Sequence[str] = (), replicates: int = 1000,
                 seed: int = 0) -> DataFrame:
    """Standard error of the group mean by Poisson resampling; NULL for a group of one row.

    Rows are spread by key, so that a key's weights are drawn once for all groups it is in; a task adds up vectors of replicates per group, and only
    (task, group, replicate) sums travel.
    """
    by = list(by)
    rows = spread(df.select(*by, F.col(key).cast("string").alias("_key"), F.col(value).cast("double").alias("_y")), "_key").sortWithinPartitions("_key")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema) if by else ""
    sums = rows.mapInPandas(_resampled_sums(by, replicates, seed), f"{kinds}_wy array<double>, _w array<double>")
    long = sums.select(*by, F.posexplode(F.arrays_zip("_wy", "_w")).alias("rep", "_s"))
    means = long.groupBy(*by, "rep").agg(F.try_divide(F.sum("_s._wy"), F.sum("_s._w")).alias("_mean"))
    errors = means.groupBy(*by).agg(F.stddev_samp("_mean").alias("se"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.join(errors, by, "left") if by else sizes.join(F.broadcast(errors))
    return joined.select(*by, "n", F.when(F.col("n") >= 2, F.col("se")).alias("se"))


# ---- rolling mean by rank

def half_window(rows: int, window: float) -> int:
    """Neighbours on each side of a centred window; Python's round is half-to-even, as wanted."""
    return max(1, int(round(window * rows / 2)))


def rolling_mean(df: DataFrame, x: str, y: str, key: str, window: float) -> DataFrame:
    """Mean of `y` over a centred window by rank of (x, key), shortened at both ends.

    Two totals looked up by rank replace the window, whose width grows with the table.
    """
    ranked = running_total(df.select(key, x, y), [x, key], {"_rank": F.lit(1), "_sum": F.col(y)})
    rows = ranked.count()
    half = half_window(rows, window)
    spans = ranked.select(key, x, F.col("_rank").cast("long").alias("rank"),
                          F.least(F.col("_rank") + half, F.lit(float(rows))).cast("long").alias("_hi"),
                          F.greatest(F.col("_rank") - half - 1, F.lit(0.0)).cast("long").alias("_lo"))
    totals = ranked.select(F.col("_rank").cast("long").alias("_hi"), F.col("_sum").alias("_top"))
    out = spans.join(totals, "_hi").join(totals.toDF("_lo", "_bottom"), "_lo", "left")
    mean = (F.col("_top") - F.coalesce("_bottom", F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))
    return out.select(key, x, "rank", mean.alias("mean"))


def rolling_band(df: DataFrame, x: str, y: str, key: str, window: float, replicates: int, seed: int,
                 levels: tuple[float, float] = (0.025, 0.975), block_rows: int | None = None) -> DataFrame:
    """Bootstrap band of the rolling mean: quantiles over replicates of the resampled window means."""
    return rolling_bands(df, x, [y], key, window, replicates, seed, levels, block_rows)[y]


def rolling_bands(df: DataFrame, x: str, ys: Sequence[str], key: str, window: float, replicates: int, seed: int,
                  levels: tuple[float, float] = (0.025, 0.975), block_rows: int | None = None) -> dict[str, DataFrame]:
    """The bands of several columns over one order, whose ranks and weights are found once.

    A replicate's weights are shared by all windows. They follow from the keys, so they are drawn where they are needed and never leave a task. Ranks
    are cut into blocks; a block's sums are kept as vectors of replicates, and running totals of these give what lies before every block. A window is
    a whole number of blocks wide (or a block is a whole number of windows), so that while the windows of one block's centres move on, the rows that
    enter are those of one block and the rows that leave are those of the block one window before. Blocks that are windows apart form a chain, of
    which a task takes `CHAIN_BLOCKS` at a time and draws each block once, and the one before the first again. `block_rows` follows from the rows and
    the session's shuffle partitions if it is not given.
    """
    values = [f"_y{i}" for i in range(len(ys))]
    ranked = ordered_rank(df.select(key, x, *[F.col(y).cast("double").alias(v) for y, v in zip(ys, values)]), [x, key])
    rows = ranked.count()
    half = half_window(rows, window)
    wide = 2 * half + 1
    if block_rows is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        block_rows = min(max(wide // (4 * parts), BAND_ROWS), MOST_BAND_ROWS)
    # `share` blocks are `unit` ranks
    share, unit = (round(wide / block_rows), wide) if wide >= block_rows else (1, block_rows // wide * wide)
    block_of = f"({{}}) * {share} DIV {unit}"
    keyed = ranked.select(F.col(key).cast("string").alias("_key"), *values, "rank", F.expr(block_of.format("rank")).alias("_block"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), KEYS_AT_ONCE):
                part = pdf.iloc[at:at + KEYS_AT_ONCE]
                weights = replicate_weights(part["_key"].tolist(), replicates, seed).astype(float)
                columns, blocks = _columns(part, values), part["_block"].to_numpy(np.int64)
                for block in np.unique(blocks).tolist():
                    own = blocks == block
                    total = held.setdefault(block, np.zeros((len(ys) + 1, replicates)))
                    total += columns[:, own] @ weights[own]
            if len(held) > GROUPS_HELD:
                yield _vectors(held, sums_of)
                held.clear()
        if held:
            yield _vectors(held, sums_of)

    sums_of = [*[f"_s{i}" for i in range(len(ys))], "_w"]  # of each column, and of the weights
    sorted_rows = spread(keyed.drop("rank"), "_block").sortWithinPartitions("_block")  # so that few blocks share a draw
    pieces = sorted_rows.mapInPandas(add_up, "_block long, " + ", ".join(f"{s} array<double>" for s in sums_of))
    sums = settle(pieces.select("_block", F.posexplode(F.arrays_zip(*sums_of)).alias("rep", "_s")).groupBy("_block", "rep").agg(
        *[F.sum(f"_s.{s}").alias(s) for s in sums_of]))
    ends = sums.groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums_of]).orderBy("rep").collect()  # one row per replicate
    whole = np.array([[r[s] for r in ends] for s in sums_of])
    earlier = Window.partitionBy("rep").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", "rep", *[F.coalesce(F.sum(s).over(earlier), F.lit(0.0)).alias(s) for s in sums_of])
    starts = before.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("rep", *sums_of))).alias("_v"))

    # what enters with a block leaves with the next one of its chain; a centre belongs to the block that its window ends in
    link = f"(({{0}}) DIV {share * CHAIN_BLOCKS}) * {share} + ({{0}}) % {share}"
    links = F.explode(F.array_distinct(F.array(F.expr(link.format("_block")), F.expr(link.format(f"_block + {share}"))))).alias("_link")
    kinds = {f.name: f.dataType.simpleString() for f in ranked.select(key, x).schema}
    columns = {"_kind": "int", "_block": "long", "rank": "long", **kinds, "_key": "string", **dict.fromkeys(values, "double"), **dict.fromkeys(sums_of, "array<double>")}

    def shaped(part: DataFrame) -> DataFrame:
        return part.select("_link", *[F.col(c).cast(k).alias(c) if c in part.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()])

    centres = ranked.select(key, x, "rank", F.expr(block_of.format(f"rank + {half}")).alias("_block"))
    own = shaped(centres.withColumns({"_link": F.expr(link.format("_block")), "_kind": F.lit(0)}))
    near = shaped(keyed.select(links, F.lit(1).alias("_kind"), "_block", "rank", "_key", *values))
    base = shaped(starts.select(links, F.lit(2).alias("_kind"), "_block", *[F.col(f"_v.{s}").alias(s) for s in sums_of]))

    def band(table: pa.Table) -> pa.Table:
        kind = table["_kind"].to_numpy()
        middle, rows_of, bases = (table.filter(pa.array(kind == k)).select(c) for k, c in enumerate(([key, x, "rank"], ["_block", "rank", "_key", *values], ["_block", *sums_of])))
        middle = middle.sort_by("rank")
        vectors = np.array([bases[s].combine_chunks().flatten().to_numpy().reshape(-1, replicates) for s in sums_of])
        before_of = {b: vectors[:, i] for i, b in enumerate(bases["_block"].to_pylist())}
        near_of = {int(b): part.sort_values("rank") for b, part in rows_of.to_pandas().groupby("_block")}
        windows = middle["rank"].to_numpy() + half  # by the ranks they end at
        ends_in, found, drawn = windows * share // unit, np.empty((2 * len(ys), len(windows))), {}
        for block in np.unique(ends_in).tolist():
            drawn = {b: drawn[b] if b in drawn else _drawn(near_of[b], values, replicates, seed) for b in (block - share, block) if b in near_of}
            mine = np.flatnonzero(ends_in == block)
            first = -(-block * unit // share)  # the block's first rank
            start = _window_before(before_of.get(block, whole), first - wide, before_of.get(block - share), drawn.get(block - share))
            for some, sums in _moved(first, windows[mine], wide, start, list(drawn.values())):
                for i, means in enumerate(_means(sums)):
                    found[2 * i:2 * i + 2, mine[some]] = _quantiles(means, levels)
        for name, values_of in zip(ends_of, found):
            middle = middle.append_column(name, pa.array(values_of, from_pandas=True))
        return middle

    ends_of = [f"_{end}{i}" for i in range(len(ys)) for end in ("lo", "hi")]
    told = ", ".join([f"`{c}` {k}" for c, k in kinds.items()] + ["rank long"] + [f"{c} double" for c in ends_of])
    # by number, since a group costs far more than its bytes tell
    banded = spread(own.union(near).union(base), "_link").groupBy("_link").applyInArrow(band, told)
    banded = settle(banded) if len(ys) > 1 else banded  # several results read it
    return {y: banded.select(key, x, "rank", F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi")) for i, y in enumerate(ys)}


def _columns(part: pd.DataFrame, values: Sequence[str]) -> np.ndarray:
    """(columns + 1, rows): the values, and ones for the weights."""
    return np.stack((*(part[v].to_numpy(float) for v in values), np.ones(len(part))))


def _drawn(part: pd.DataFrame, values: Sequence[str], replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, columns and weights (rows, replicates) of a block's rows in order."""
    return part["rank"].to_numpy(np.int64), _columns(part, values), replicate_weights(part["_key"].tolist(), replicates, seed)


def _rows_at(block: tuple[np.ndarray, np.ndarray, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows with ranks from `low` up to `high`."""
    lo, hi = np.searchsorted(block[0], (low, high))
    return block[0][lo:hi], block[1][:, lo:hi], block[2][lo:hi]


def _window_before(total: np.ndarray, rank: int, base: np.ndarray | None, rows) -> np.ndarray:
    """Sums of the window that ends before a block: what lies before the block, less what lies before the window, which begins at `rank` in `rows`."""
    if base is None:
        return total.copy()
    _, columns, weights = _rows_at(rows, rows[0][0], rank)
    return total - base - columns @ weights.astype(float)


def _moved(first: int, ends: np.ndarray, wide: int, start: np.ndarray, blocks: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums (columns, windows, replicates) of the windows that end at the ranks `ends`, some at a time with their places; `start` are the sums of the
    window that ends before the rank `first`."""
    last = int(ends[-1]) + 1
    for low in range(first, last, MOVES_AT_ONCE):
        high = min(low + MOVES_AT_ONCE, last)
        sums = np.zeros((len(start), high - low, start.shape[1]))
        for rows in blocks:
            for back, sign in ((0, 1.0), (wide, -1.0)):
                rank, columns, weights = _rows_at(rows, low - back, high - back)
                if len(rank):
                    for total, column in zip(sums, columns):
                        total[rank[0] + back - low:rank[-1] + 1 + back - low] += (sign * column)[:, None] * weights
        sums[:, 0] += start
        np.cumsum(sums, axis=1, out=sums)
        start = sums[:, -1].copy()
        some = np.flatnonzero((ends >= low) & (ends < high))
        if some.size:
            yield some, sums[:, ends[some] - low]


def _means(sums: np.ndarray) -> Iterator[np.ndarray]:
    """Of each column the window means (windows, replicates), NaN for a replicate without rows."""
    weight = np.round(sums[-1])
    with np.errstate(invalid="ignore", divide="ignore"):
        for total in sums[:-1]:
            means = total / weight
            means[weight <= 0] = np.nan
            yield means


def _vectors(held: dict[int, np.ndarray], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({"_block": list(held)} | {name: list(v) for name, v in zip(names, zip(*held.values()))})


def _quantiles(rows: np.ndarray, levels: Sequence[float]) -> list[np.ndarray]:
    """Interpolated quantiles of each row over its known values, NaN for a row without one."""
    known = ~np.isnan(rows)
    if known.all():
        places = [level * (rows.shape[1] - 1) for level in levels]
        picked = sorted({min(math.floor(p) + k, rows.shape[1] - 1) for p in places for k in (0, 1)})
        ordered = np.partition(rows, picked, axis=1)
        ends = [(ordered[:, math.floor(p)], ordered[:, min(math.floor(p) + 1, rows.shape[1] - 1)], p - math.floor(p)) for p in places]
        return [a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t) for a, b, t in ends]
    ordered, n = np.sort(rows, axis=1), known.sum(axis=1)
    out = []
    for level in levels:
        place = level * np.maximum(n - 1, 0)
        low = np.floor(place).astype(int)
        a, b = (np.take_along_axis(ordered, np.minimum(i, np.maximum(n - 1, 0))[:, None], axis=1)[:, 0] for i in (low, low + 1))
        out.append(a + (place - low) * (b - a))
    return out


def order_breaks(df: DataFrame, column: str, by: Sequence[str], key: str) -> DataFrame:
    """Rows whose value does not rise strictly over the previous row of their group, by `key` order.

    Previous rows come from an equality join on the global position, so groups may be of any size.
    """
    ranked = ordered_rank(df.select(*by, key, column), [*by, key])
    earlier = ranked.select((F.col("rank") + 1).alias("rank"), *[F.col(b).alias(f"_{b}") for b in by],
                            F.col(column).alias("_previous"))
    joined = ranked.join(earlier, "rank")
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    keep = F.col(column) <= F.col("_previous")
    for c in same:
        keep = keep & c
    return joined.filter(keep).select(*by, key, column, F.col("_previous").alias("previous"))
