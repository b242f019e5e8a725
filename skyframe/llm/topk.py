"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks; every pair of blocks is one row that a task scores. Round after round the scores of each query are
counted in a histogram over the interval that holds its k-th highest score; the counts of all blocks are added up and the interval shrinks to the
bin of the k-th score, until that score itself is known. A last pass keeps what reaches it and breaks ties by the smaller id. No task holds more
than a pair of blocks, and the histograms that move have at most k filled bins per query and block, since lower bins can't hold the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.session import settle

SCALE = 256
BINS = 1024
QUERY_ROWS = 1024
CANDIDATE_ROWS = 4096
LONGEST = (1 << 63) - 1


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, still as double."""
    return np.floor(SCALE * rows)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; beyond 64 bits they stop at the largest and smallest long."""
    reach = float(np.abs(queries).sum(axis=1).max(initial=0.0)) * float(np.abs(candidates).max(initial=0.0))
    if reach < 2.0**52:
        return (queries @ candidates.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], dtype=object) @ np.array([[int(x) for x in row] for row in candidates], dtype=object).T
    return np.clip(whole, -LONGEST, LONGEST).astype(np.int64)


def _packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of vectors of one length: block, dim, n, ids, data, largest component, largest sum of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, data = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            number += 1
            values = [number, dim, len(ids), ids.astype("<i8").tobytes(), data.astype("<f8").tobytes(), float(np.abs(data).max(initial=0)),
                      float(np.abs(data).sum(axis=1).max(initial=0))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES)], names=NAMES)

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                ids, data = part.column(0).to_numpy(), scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim))
                for lo in range(0, len(ids), block_rows):
                    waiting.setdefault(dim, []).append((ids[lo:lo + block_rows], data[lo:lo + block_rows]))
                    if sum(len(x) for x, _ in waiting[dim]) >= block_rows:
                        yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    return settle(rows.mapInArrow(run, "block long, dim int, n int, ids binary, data binary, widest double, longest double"))


NAMES = ["block", "dim", "n", "ids", "data", "widest", "longest"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of blocks: its row, query ids, candidate ids, scores, and which pairs count (a row is no candidate of its own id)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
            q, c = (np.frombuffer(row[k], "<f8").reshape(-1, row["dim"]) for k in ("q_data", "data"))
            yield row, q_ids, c_ids, scores(q, c), q_ids[:, None] != c_ids[None, :]


def _count(k: int, bins: int, width: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q_ids, _, found, counts in _scored(batches):
            low, above = (np.array(row[x], dtype=np.int64)[:, None] for x in ("low", "above"))
            # differences are taken as unsigned numbers, which hold the distance of any two longs
            gap = found.view(np.uint64) - low.view(np.uint64)
            inside, place = counts & (found >= low) & (gap < np.uint64(span)), gap // np.uint64(width)
            flat = (place.astype(np.int64) + bins * np.arange(len(q_ids))[:, None])[inside]
            table = np.bincount(flat, minlength=bins * len(q_ids)).reshape(len(q_ids), bins)
            before = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            q, b = np.nonzero((table > 0) & (before < k - above))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["q_block"])), pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)),
                                              pa.array(table[q, b].astype(np.int64))], names=["q_block", "q", "bin", "n"])
    return run


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q_ids, c_ids, found, counts in _scored(batches):
            q, c = np.nonzero(counts & (found >= np.array(row["low"], dtype=np.int64)[:, None]))
            score, ids = found[q, c], c_ids[c]
            order = np.lexsort((ids, -score, q))
            q, score, ids = q[order], score[order], ids[order]
            first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=bool)
            rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            q, score, ids = (x[rank < k] for x in (q, score, ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["q_block"])), pa.array(q.astype(np.int32)), pa.array(q_ids[q]), pa.array(ids),
                                              pa.array(score)], names=["q_block", "q", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS,
          query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """The k best candidates of each row of vectors that fulfils the condition `is_query`: query_id, rank (from 1), vec_id, score.

    Score: inner product of floor(256 * x) of the components. Ties go to the smaller id; fewer candidates give fewer rows. Rows with a null id, a
    null vector, or null or not finite components take no part, nor do candidates of another length than the query. Rows that repeat an id are
    candidates each, queries each, and never candidates of that id. Empty tables give an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.lit(is_query).alias("asked"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(~bad)
    total, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    candidates = _packed(rows.select("id", "vector").repartition(max(1, -(-total // candidate_rows))), candidate_rows)
    queries = _packed(rows.filter("asked").select("id", "vector").repartition(max(1, -(-asked // query_rows))), query_rows)
    widest = candidates.agg(F.max("widest")).first()[0] or 0.0
    q_blocks = [(r["block"], r["n"], r["longest"]) for r in queries.select("block", "n", "longest").collect()]  # one short row per block
    c_blocks = [r["block"] for r in candidates.select("block").collect()]
    if not q_blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spark = vectors.sparkSession
    left = candidates.select("block", "dim", "ids", "data", F.explode(F.lit([b for b, _, _ in q_blocks])).alias("q_block"))
    right = queries.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    right = right.withColumn("block", F.explode(F.lit(c_blocks)))
    pairs = left.join(right.hint("shuffle_merge"), ["q_block", "block"]).filter("dim = q_dim")
    start, reach = [], 1
    for block, n, longest in q_blocks:
        low = -min(LONGEST, int(longest * widest) + 1)
        reach = max(reach, -2 * low + 1)
        start.append((block, n, low))
    span, width = reach, -(-reach // bins)
    state = spark.createDataFrame(start, "q_block long, n int, low long").select(
        "q_block", F.posexplode(F.array_repeat("low", F.col("n"))).alias("q", "low"), F.lit(0).cast("long").alias("above"))
    while True:
        counted = _with_state(pairs, state).mapInArrow(_count(k, bins, width, span), "q_block long, q int, bin int, n long")
        counts = counted.groupBy("q_block", "q", "bin").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("q_block", "q").orderBy(F.col("bin").desc())
        higher = counts.withColumn("before", F.sum("n").over(order) - F.col("n")).join(state, ["q_block", "q"])
        hit = higher.filter((F.col("above") + F.col("before") < k) & (F.col("above") + F.col("before") + F.col("n") >= k)).select(
            "q_block", "q", F.col("bin").alias("at"), "before")
        # queries without a k-th score keep their interval's low end, so that all their candidates are returned
        state = settle(state.join(hit, ["q_block", "q"], "left").select(
            "q_block", "q", F.expr(f"CAST(low + CAST(coalesce(at, 0) AS DECIMAL(10)) * CAST({width} AS DECIMAL(20)) AS LONG)").alias("low"),
            (F.col("above") + F.coalesce("before", F.lit(0))).alias("above")))
        if width == 1:
            break
        span, width = width, -(-width // bins)
    kept = _with_state(pairs, state).mapInArrow(_keep(k), "q_block long, q int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q").orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_state(pairs: DataFrame, state: DataFrame) -> DataFrame:
    packed = state.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("q", "low", "above"))).alias("s"))
    return pairs.join(packed, "q_block").select("q_block", "dim", "ids", "data", "q_ids", "q_data", F.col("s.low").alias("low"),
                                                F.col("s.above").alias("above"))
