"""Helpers shared by the corpus operators: components of a link table, streams of sorted groups, bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.session import settle


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Every node that has a link, with the smallest node reachable from it: columns node, root (long).

    Large and small star steps alternate until nothing changes, about log(n) rounds. Each round writes its links as a stage table, so that no
    lineage grows and a lost executor recomputes one round. A node with very many links is a skewed join key only, never one group in a task; the
    sides of the joins are written first, since Spark splits a skewed partition only between plain shuffles.
    """
    edges = settle(links.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("u")).filter("v <> u").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = settle(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m")))
        large = both.filter("y > x").join(least, F.col("x") == F.col("k")).select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = settle(large)
        lower = settle(large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m"))
        small = large.join(lower, F.col("v") == F.col("k")).filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = settle(small.union(lower.select(F.col("k").alias("v"), F.col("m").alias("u"))).distinct())
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    star = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return star.union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return row["n"], row["x"] or 0


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of sorted batches that share the key columns: (whether a new key starts, slice). A long run arrives in several slices."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(c[lo] for c in columns)
            yield key != last, batch.slice(lo, hi - lo)
            last = key


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds `most` characters of the text column, or one row that has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
