"""Hard-negative mining with the threshold algorithm over per-dimension sorted lists.

Candidates are dealt into shards of bounded size; a shard keeps, for every dimension, its candidates sorted by that component. An anchor reads each
list from the end that its own component's sign favours, all lists to the same depth, scores every candidate it meets as a whole number, and stops
once the threshold, the score that a candidate standing at the depth reached in every list would have, is strictly below the k-th score of each of its
windows (or below the window itself): what it has not met can't be among the first k, not even by a tie.

Each anchor asks every shard; shards come in rounds, first as many as tasks, then 16 times as many at a time, and what a round finds raises the
low ends of the windows in the next, so that later shards stop sooner and send little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm.common import runs
from skyframe.llm.topk import LONGEST, SCALE, scaled, scores
from skyframe.session import settle

POSITIVES = 5
NEGATIVES = 10
LOWEST, HIGHEST = 30, 90
SHARD_BYTES = 16 << 20
ROUND_GROWTH = 16
FIRST_DEPTH = 16
EXACT = 2.0**52


class Lists:
    """Candidates of one length: ids, labels, whole components, and for every dimension their order and values, ascending."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.data = ids, data
        names, self.codes = np.unique(labels, return_inverse=True)
        self.code_of = {name: i for i, name in enumerate(names.tolist())}
        self.order = np.ascontiguousarray(np.argsort(data, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.sort(data, axis=0).T)
        self.widest = float(np.abs(data).max(initial=0.0))

    def eligible(self, anchor_id: int, label: str, same: bool) -> np.ndarray:
        alike = self.codes == self.code_of.get(label, -1)
        return (alike if same else ~alike) & (self.ids != anchor_id)


def threshold_search(lists: Lists, query: np.ndarray, eligible: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates met; the first k of every window of scores [low, high] are among them."""
    n, up, down = len(lists.ids), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    # beyond this size doubles don't hold every whole number, so that the threshold proves nothing and the lists are read to the end
    exact = float(np.abs(query).sum()) * lists.widest < EXACT
    seen, places, found = np.zeros(n, dtype=bool), [], []
    open_windows, depth, step = list(windows), 0, FIRST_DEPTH
    if not exact or not len(up) + len(down):
        depth, open_windows = n, []
        places.append(np.flatnonzero(eligible))
        found.append(scores(query[None, :], lists.data[eligible])[0])
    while open_windows and depth < n:
        to = min(n, depth + step)
        met = np.concatenate((lists.order[up, n - to:n - depth].ravel(), lists.order[down, depth:to].ravel()))
        fresh = np.zeros(n, dtype=bool)
        fresh[met] = True
        fresh &= ~seen
        seen |= fresh
        chosen = np.flatnonzero(fresh & eligible)
        places.append(chosen)
        found.append(scores(query[None, :], lists.data[chosen])[0])
        depth, step = to, 2 * step
        threshold = query[up] @ lists.values[up, n - depth] + query[down] @ lists.values[down, depth - 1]
        known = np.concatenate(found)
        open_windows = [w for w in open_windows if not _closed(known, threshold, w, k)]
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _closed(known: np.ndarray, threshold: float, window: tuple[int, int], k: int) -> bool:
    low, high = window
    if threshold < low:
        return True
    inside = known[(known >= low) & (known <= high)]
    return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


def _search(k: int, same: bool):
    """Rows by shard, candidates (kind 0) before anchors (kind 1): each anchor's first k of each of its windows in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, lists = None, [], None
        for _, part in runs(batches, "shard", "kind"):
            if part.column(0)[0].as_py() != shard:
                shard, waiting, lists = part.column(0)[0].as_py(), [], None
            if part.column(1)[0].as_py() == 0:
                waiting.append(part)
                continue
            if lists is None:
                lists, waiting = _lists(waiting), []
            out: list[tuple[np.ndarray, ...]] = []
            for row in part.to_pylist():
                own = lists.get(len(row["vector"]))
                if own is None:
                    continue
                eligible = own.eligible(row["id"], row["label"], same)
                windows = list(zip(row["low"], row["high"]))
                places, found = threshold_search(own, scaled(np.array(row["vector"], dtype=float)), eligible, windows, k)
                for w, (low, high) in zip(row["w"], windows):
                    inside = np.flatnonzero((found >= low) & (found <= high))
                    ids = own.ids[places[inside]]
                    first = np.lexsort((ids, -found[inside]))[:k]
                    out.append((np.full(len(first), row["a"]), np.full(len(first), w), ids[first], found[inside][first]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)], names=["a", "w", "id", "score"])

    return run


def _lists(parts: list[pa.RecordBatch]) -> dict[int, Lists]:
    if not parts:
        return {}
    table = pa.Table.from_batches(parts).combine_chunks()
    sizes = pa.compute.list_value_length(table["vector"]).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        own = table.filter(pa.array(sizes == dim))
        flat = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out[dim] = Lists(own["id"].to_numpy(), own["label"].to_numpy().astype(str), scaled(flat))
    return out


def _first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(candidates: DataFrame, anchors: DataFrame, windows: DataFrame, shards: int, first_round: int, k: int, same: bool) -> DataFrame:
    """a, w, rank, id, score: the first k candidates of each window (windows: a, w, low, high) of each anchor (a, id, label, vector)."""
    done, size, best = 0, first_round, None
    while True:
        to = min(shards, done + size)
        asked = anchors.join(windows.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("ws")), "a")  # a few windows each
        asked = asked.select(F.explode(F.sequence(F.lit(done), F.lit(to - 1))).alias("shard"), F.lit(1).alias("kind"), "a", "id", "label", "vector",
                             F.col("ws.w").alias("w"), F.col("ws.low").alias("low"), F.col("ws.high").alias("high"))
        none = [F.lit(None).cast(t).alias(n) for n, t in (("w", "array<int>"), ("low", "array<long>"), ("high", "array<long>"))]
        held = candidates.filter((F.col("shard") >= done) & (F.col("shard") < to)).select(
            "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), "id", "label", "vector", *none)
        partitions = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), (to - done) // 4)
        met = held.union(asked).repartition(partitions, "shard").sortWithinPartitions("shard", "kind")
        found = met.mapInArrow(_search(k, same), "a long, w int, id long, score long")
        best = settle(_first_k(found if best is None else found.union(best.drop("rank")), k))
        if to == shards:
            return best
        full = best.filter(F.col("rank") == k).select("a", "w", F.col("score").alias("floor"))
        windows = windows.join(full, ["a", "w"], "left").select("a", "w", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high")
        done, size = to, ROUND_GROWTH * size


def _share(score: str, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded up or down, without leaving the range of a long."""
    rest = F.pmod(F.col(score), F.lit(100))
    whole = F.expr(f"({score} - pmod({score}, 100L)) DIV 100L") * percent
    return (whole + F.floor((rest * percent + (99 if up else 0)) / 100)).cast("long")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                        positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
                        shard_bytes: int = SHARD_BYTES, first_round: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for the rows of vectors that fulfil `is_anchor`.

    Score: inner product of floor(256 * x) of the components, a whole number; beyond 64 bits it stops at the largest and smallest long. An anchor's
    positives are its first `positives` other rows of the same label; to each belong the first `negatives` rows of another label whose score is from
    `lowest` to `highest` percent of the positive's. Higher scores come first, ties by smaller id; fewer rows give fewer results.

    Rows with a null id, label or vector, an empty vector, or components that are null or not finite (also times 256) take no part. Vectors of different
    lengths never meet. Rows that repeat an id are anchors, positives and negatives each, but never of an anchor of their own id. Other columns are
    not read; empty tables give an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(F.lit(is_anchor), F.lit(False)).alias("asked"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)).filter(~bad)
    rows = settle(rows.withColumn("a", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-n * (width or 0) * 8 // shard_bytes))
    first_round = min(shards, first_round or tasks)
    candidates = rows.select(F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int").alias("shard"), "id", "label", "vector")
    anchors = rows.filter("asked").select("a", "id", "label", "vector")
    whole = anchors.select("a", F.lit(1).alias("w"), F.lit(-LONGEST).alias("low"), F.lit(LONGEST).alias("high"))
    near = _best(candidates, anchors, whole, shards, first_round, positives, True)
    near = near.select("a", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = near.select("a", "w", _share("positive_score", lowest, True).alias("low"), _share("positive_score", highest, False).alias("high")).filter("low <= high")
    hard = _best(candidates, anchors, windows, shards, first_round, negatives, False)
    told = hard.join(near, ["a", "w"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return told.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
