"""SimHash near-duplicates: fingerprints of word shingles, searched with BK-trees.

`fingerprints` reads whole texts. `near_links` cuts the distinct fingerprints into shards such that any two within the radius meet in one shard
(they agree on enough parts of their bits), builds one BK-tree per shard with children keyed by their Hamming distance to the parent, and follows
only edges within the radius. A tree holds at most `shard_rows` fingerprints; a larger shard becomes several trees, and each of its fingerprints
asks every one of them. The number of trees grows with the corpus, so rows travel to the trees of their shard rather than all trees to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import components, runs
from skyframe.session import settle

SEED = 42
WORDS = 3
RADIUS = 2
PARTS = 4
SHARD_ROWS = 4096
CHUNK = 1 << 16
BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)
OFFSETS = (256 * np.arange(8, dtype=np.int64))[None, :]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, signed. Null and blank texts have 0; a text of fewer words than a shingle has one shingle, all its words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    size = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, digest, n = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest, len(found) - size + 1
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + OFFSETS).ravel(), minlength=2048).reshape(8, 256)
        total += (seen @ BITS).ravel()
    value = int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long). Other columns are not read; repeated rows and null ids stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes in arrays; `children[i]` maps a Hamming distance to the child at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """The node of the value, a new one if it is not in the tree."""
        if self.values:
            node = 0
            while True:
                gap = (value ^ self.values[node]).bit_count()
                if not gap:
                    return node
                nearer = self.children[node].get(gap)
                if nearer is None:
                    self.children[node][gap] = len(self.values)
                    break
                node = nearer
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def search(self, value: int, radius: int) -> list[int]:
        """Nodes within the radius: only edges labelled between distance - radius and distance + radius are followed."""
        found, open_nodes, values, children = [], [0] if self.values else [], self.values, self.children
        while open_nodes:
            node = open_nodes.pop()
            gap = (value ^ values[node]).bit_count()
            if gap <= radius:
                found.append(node)
            below = children[node]
            if below:
                if len(below) <= 2 * radius + 1:
                    open_nodes += [c for e, c in below.items() if gap - radius <= e <= gap + radius]
                else:
                    open_nodes += [below[e] for e in range(gap - radius, gap + radius + 1) if e in below]
        return found


def _root(parents: list[int], node: int) -> int:
    while parents[node] != node:
        parents[node] = node = parents[parents[node]]
    return node


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, piece, those of the tree first): links that join the same fingerprints as all links within the radius do."""
    tree, parents, left, right = BKTree(), [], [], []
    for fresh, part in runs(batches, "shard", "piece"):
        if fresh:
            tree, parents = BKTree(), []
        values = (part.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).tolist()
        own = part.column(3).to_numpy(zero_copy_only=False).tolist()
        for value, mine in zip(values, own):
            found = tree.search(value, radius)
            if mine:
                node = tree.insert(value)
                if node == len(parents):
                    parents.append(node)
                for other in found:
                    a, b = _root(parents, node), _root(parents, other)
                    if a != b:
                        parents[a] = b
                        left.append(value)
                        right.append(tree.values[other])
            elif found:
                left.append(value)
                right.append(tree.values[found[0]])
                for other in found[1:]:
                    a, b = _root(parents, found[0]), _root(parents, other)
                    if a != b:
                        parents[a] = b
                        left.append(value)
                        right.append(tree.values[other])
        if len(left) > CHUNK:
            yield _links(left, right)
            left, right = [], []
    yield _links(left, right)


def _links(left: list[int], right: list[int]) -> pa.RecordBatch:
    columns = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (left, right)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def near_links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect what all pairs within the radius connect.

    The bits are cut into `parts` equal parts; two fingerprints within the radius agree on at least parts - radius of them, so each choice of that
    many parts with their values is a shard. Nearly all shards hold one fingerprint and go before any tree is built.
    """
    if 64 % parts or parts <= radius:
        raise ValueError("parts must divide 64 and exceed the radius")
    width, agree = 64 // parts, parts - radius
    bits = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(parts)]
    shards = F.array(*[F.xxhash64(F.lit(k), *[bits[i] for i in chosen]) for k, chosen in enumerate(combinations(range(parts), agree))])
    keyed = settle(fps.select("fp").distinct().select("fp", F.explode(shards).alias("shard")))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    cut = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    met = keyed.join(sizes, "shard").select("shard", "fp", cut.alias("trees"), F.pmod(F.xxhash64("fp"), cut).cast("int").alias("home"))
    asked = met.select("shard", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("piece"), "fp", "home")
    ready = asked.select("shard", "piece", "fp", (F.col("piece") == F.col("home")).alias("own"))
    spread = ready.repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("own").desc(), "fp")
    return spread.mapInArrow(lambda batches: _search(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS,
                    seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over fingerprints within the radius, itself included).

    Null texts count as empty and all blank texts share fingerprint zero. Rows without an id have a fingerprint and join components but never name
    one: their component_id is null only if no row of the component has an id. Repeated rows give repeated rows, an empty table an empty result.
    """
    marked = settle(fingerprints(docs, id_col, text_col, words, seed))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(near_links(fps, radius), "a", "b")
    named = joined.join(fps, F.col("node") == F.col("fp")).select("node", "root", "first_id")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("least_id")).select(F.col("root").alias("k"), "least_id")
    linked = named.join(smallest, F.col("root") == F.col("k")).select(F.col("node").alias("fp"), "least_id")
    # written, so that the join below is between plain shuffles, whose skewed partitions (a fingerprint of many copies) Spark splits
    ids = settle(fps.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")

