"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

The codes are fitted on a bounded sample (a parameter); every vector gets its codes. A code is cut into equal substrings, one table for each; a
vector is filed under its substrings and asks for each of them and for those one bit away. So pairs whose codes differ in up to 2 * tables - 1 bits
always meet, others with a probability that depends on how the vectors lie: where all point the same way, near ones differ in many bits. It is
measured on the sample, with neighbours made at exactly the threshold, and further codes (other rotations) and then shorter substrings are taken
until the measured recall reaches the target; the shortest make nearly all pairs of a label meet. Candidates of the same label are reranked by the
cosine of the original vectors in double precision, so no link below the threshold is returned. Equal vectors of a label are one class with a count:
copies are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import components
from skyframe.session import settle

THRESHOLD = 0.98
BITS = 64
TABLES = 4
SAMPLE_ROWS = 20_000
ROUNDS = 30
TARGET = 0.985
MOST_CODES = 8
NEIGHBOURS = 4000


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """vec_id, label, vector (double array) of the rows that can link: finite and not zero components, the label not null."""
    label = F.lit(0).cast("string") if label_col is None else F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(
        ~bad & F.exists("vector", lambda x: x != 0.0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of unit rows; each row is scaled by its largest component first, so that nothing overflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if rows.size else rows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) if rows.size else rows


def fit_codes(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) with signs of (x - mean) @ projection as code: principal axes and the rotation of least quantisation error.

    Vectors of fewer components than bits are first carried to more by a fixed random frame, so that a code has all its bits.
    """
    mean = sample.mean(axis=0)
    centred, rng, width = sample - mean, np.random.default_rng(seed), sample.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    if width < bits:
        axes = axes @ np.linalg.qr(rng.standard_normal((bits, bits)))[0][:width]
    projected, rotation = centred @ axes, np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation >= 0, 1.0, -1.0))
        rotation = left @ right
    return mean, axes @ rotation


def codes_of(rows: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of up to 64 bits as signed longs."""
    signs = np.zeros((len(rows), 64), dtype=bool)
    signs[:, : projection.shape[1]] = (rows - mean) @ projection >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<i8").ravel()


@dataclass(frozen=True)
class Model:
    """Codes for vectors of one length: their mean, one projection per code, tables per code, and the code distance up to which pairs are reranked."""

    mean: np.ndarray
    projections: tuple[np.ndarray, ...]
    tables: int
    farthest: int
    recall: float


def neighbours(sample: np.ndarray, threshold: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors with exactly this cosine: rows of the sample, turned towards other rows (even places) or at random (odd places)."""
    x = sample[rng.integers(len(sample), size=n)]
    away = np.where((np.arange(n) % 2 == 0)[:, None], sample[rng.integers(len(sample), size=n)], rng.standard_normal((n, sample.shape[1])))
    away = away - (away * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0.0)
    return x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * away


def meets(gap: np.ndarray, tables: int) -> np.ndarray:
    """Whether codes that differ in these bits share a bucket: some substring differs in one bit at most."""
    width = 64 // tables
    parts = gap.view(np.uint64)[:, None] >> (np.uint64(width) * np.arange(tables, dtype=np.uint64))
    return (np.bitwise_count(parts & np.uint64((1 << width) - 1 if width < 64 else (1 << 64) - 1)) <= 1).any(axis=1)


def fit_model(sample: np.ndarray, threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, target: float = TARGET,
              most_codes: int = MOST_CODES, seed: int = 7) -> Model:
    """The cheapest of the schemes whose recall at the threshold, measured on neighbours of the sample's rows, reaches the target."""
    if 64 % tables:
        raise ValueError("tables must divide 64")
    x, y = neighbours(sample, threshold, NEIGHBOURS, np.random.default_rng(seed))
    even = np.arange(NEIGHBOURS) % 2 == 0
    projections, gaps, best = [], [], None
    while tables <= 16:
        met, far = np.zeros(NEIGHBOURS, dtype=bool), 0
        for k in range(most_codes):
            if k == len(projections):
                mean, projection = fit_codes(sample, bits, seed=seed + k)
                projections.append(projection)
                gaps.append(codes_of(x, mean, projection) ^ codes_of(y, mean, projection))
            distance = np.bitwise_count(gaps[k].view(np.uint64))
            far = max(far, int(np.quantile(distance, 0.9999)) + 2)
            met |= meets(gaps[k], tables)
            # the worse of the two kinds of neighbours counts
            recall = min(float(met[even].mean()), float(met[~even].mean()))
            best = Model(mean, tuple(projections[:k + 1]), tables, far, recall)
            if recall >= target:
                return best
        tables *= 2
    return best


def near_pairs(classes: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, sample_rows: int = SAMPLE_ROWS,
               target: float = TARGET) -> DataFrame:
    """Pairs a < b of class_id (classes: class_id, label, dim, vector) of one label with cosine >= threshold, and their cosine.

    `sample_rows` bounds the rows that fit the codes, taken in the order of a hash of their ids. `target` is the recall at the threshold that the
    scheme of tables must reach on neighbours of these rows; pairs above the threshold are nearer and meet more often.
    """
    kinds = [r["dim"] for r in classes.select("dim").distinct().collect()]
    models: dict[int, Model] = {}
    for dim in kinds:
        picked = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("class_id"), "class_id").limit(sample_rows).select("vector").toArrow()
        models[dim] = fit_model(matrix(picked.column(0).combine_chunks()), threshold, bits, tables, target)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part, model = batch.filter(pa.array(sizes == dim)), models[dim]
                rows = matrix(part.column(3))
                for k, projection in enumerate(model.projections):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.array(np.full(n, k, dtype=np.int32)), pa.array(np.full(n, model.tables, dtype=np.int32)),
                         pa.array(np.full(n, model.farthest, dtype=np.int32)), pa.array(codes_of(rows, model.mean, projection))],
                        names=["class_id", "label", "dim", "nth", "tables", "farthest", "code"])

    coded = settle(classes.select("class_id", "label", "dim", "vector").mapInArrow(
        encode, "class_id long, label string, dim int, nth int, tables int, farthest int, code long"))
    filed = coded.select("class_id", "label", "dim", "farthest", "code", "nth", F.expr("64 DIV tables").cast("int").alias("width"),
                         F.explode(F.sequence(F.lit(0), F.col("tables") - 1)).alias("table"))
    part = F.expr("shiftrightunsigned(code, width * table) & (shiftleft(1L, width) - 1L)")  # a width of 64 gives -1, all bits
    filed = filed.select("class_id", "label", "dim", "farthest", "code", "width", (F.col("nth") * 64 + F.col("table")).alias("slot"),
                         F.when(F.col("width") == 64, F.col("code")).otherwise(part).alias("part"))
    flips = F.transform(F.sequence(F.lit(-1), F.col("width") - 1), lambda i: F.when(i < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    asks = filed.select(F.col("class_id").alias("b"), "label", "dim", F.col("code").alias("code_b"), "slot", "part", F.explode(flips).alias("flip"))
    asks = asks.select("b", "label", "dim", "code_b", "slot", F.col("part").bitwiseXOR(F.col("flip")).alias("part"))
    # Spark guesses the size of asks from the file of codes, without what explode makes of a row, and would send them all through the driver
    near = filed.withColumnRenamed("class_id", "a").join(asks.hint("merge"), ["label", "dim", "slot", "part"]).filter("a < b")
    near = near.filter(F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))) <= F.col("farthest")).select("a", "b").distinct()
    vectors = classes.select("class_id", "vector").hint("merge")  # an array counts as one element in the guess
    both = near.join(vectors.withColumnRenamed("class_id", "a").withColumnRenamed("vector", "va"), "a")
    both = both.join(vectors.withColumnRenamed("class_id", "b").withColumnRenamed("vector", "vb"), "b").select("a", "b", "va", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                cosine = np.einsum("ij,ij->i", matrix(part.column(2)), matrix(part.column(3)))
                good = pa.array(cosine >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good), pa.array(cosine).filter(good)],
                                                 names=["a", "b", "cosine"])

    return both.mapInArrow(rerank, "a long, b long, cosine double")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                    threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows with a null, zero or not finite vector, a null id or a null label link with nothing: n_links 0, component_id their own id. Vectors of
    different lengths never link. Repeated rows with one id count as links of each other, as other equal vectors do. Empty tables give none.
    """
    good = usable(vectors, id_col, vector_col, label_col)
    # -0.0 and 0.0 are one value
    marked = settle(good.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("dim", F.size("vector")).withColumn(
        "digest", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    classes = marked.groupBy("label", "digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("dim").alias("dim"),
                                                    F.first("vector").alias("vector"))
    # an id that repeats may head two classes, so that classes have numbers of their own
    numbered = settle(classes.withColumn("class_id", F.monotonically_increasing_id()))
    pairs = settle(near_pairs(numbered, threshold, **options).select("a", "b"))
    sizes = numbered.select(F.col("class_id").alias("other"), F.col("n").alias("m"))
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    degrees = both.join(sizes.hint("merge"), "other").groupBy("class_id").agg(F.sum("m").alias("linked"))
    stars = components(pairs, "a", "b").join(numbered.select(F.col("class_id").alias("node"), "first_id"), "node")
    least = stars.groupBy("root").agg(F.min("first_id").alias("least_id"))
    roots = stars.join(least, "root").select(F.col("node").alias("class_id"), "least_id")
    told = numbered.select("class_id", "label", "digest", "n", "first_id").join(degrees, "class_id", "left").join(roots, "class_id", "left")
    told = told.select("label", "digest", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                       F.coalesce("least_id", "first_id").alias("component_id"))
    linked = marked.select("vec_id", "label", "digest").join(settle(told).hint("merge"), ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), *([F.col(label_col).alias("l")] if label_col else []))
    bare = alone.filter(~_links_at_all(alone, label_col)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(bare).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links_at_all(rows: DataFrame, label_col: str | None):
    vector = F.col("v").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0.0), F.lit(False))
    return F.col("vec_id").isNotNull() & good & (F.col("l").isNotNull() if label_col else F.lit(True))
