"""Toxicity by a classifier chain: categories one after the other, each a linear model that also sees the earlier categories' probabilities.

While training, a row's earlier probabilities come from models that were fitted without its fold (out-of-fold), so that later models see such values
as they will meet. Features are words and word beginnings, so that unseen forms of toxic words count. They are chosen from all rows of a bounded
sample of labelled documents (a parameter) by how far their document frequencies differ; each category's threshold is chosen from the probabilities
of rows that the model was fitted without; the fits of the folds run side by side, each in a task that holds the sample's features. The model has a fixed
size. Whole texts of all documents are scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.session import settle

SAMPLE_ROWS = 20_000
FOLDS = 5
WORDS = 192
RIDGE = 1.0
ROUNDS = 25
THRESHOLD = 0.5
THRESHOLDS = tuple(round(0.5 - 0.05 * k, 2) for k in range(10))
MISS_WEIGHT = 1  # a missed document counts as much as so many wrongly found ones
BEGINNINGS = (5, 6)
BLOCK = 1024
WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}


@dataclass(frozen=True)
class Chain:
    """Categories in order, the words ("begin*" is a word beginning), and per category the weights of: constant, shape of the text, words, earlier
    categories; and per category the probability above which a document has it."""

    categories: tuple[str, ...]
    words: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...] = ()

    def threshold(self, category: str) -> float:
        return self.thresholds[self.categories.index(category)] if self.thresholds else THRESHOLD

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        """One column per category for rows of `features_of`."""
        rows = features
        for weight in self.weights:
            rows = np.column_stack((rows, _sigmoid(rows @ weight)))
        return rows[:, features.shape[1]:]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings of the lengths it has."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def features_of(text: str | None, place: Mapping[str, int]) -> np.ndarray:
    """Constant, log length, letters and words per character, then log(1 + count) of each word or beginning. Null texts count as empty."""
    text = text or ""
    out = np.zeros(4 + len(place))
    found = WORD.findall(text.lower())
    letters = sum(map(len, found))
    out[:3] = 1.0, np.log1p(len(found)) / 10, letters / max(1, len(text))
    out[3] = len(found) / max(1, len(text))
    for word, n in Counter(found).items():
        for term in terms_of(word):
            i = place.get(term)
            if i is not None:
                out[4 + i] += n
    out[4:] = np.log1p(out[4:])
    return out


class Rows:
    """Feature rows kept as float32 beside the earlier categories' probabilities; read in doubles, a block of rows at a time."""

    def __init__(self, x: np.ndarray, earlier: np.ndarray) -> None:
        self.x, self.earlier, self.width = x, earlier, x.shape[1] + earlier.shape[1]

    def blocks(self, which: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Of the rows of these numbers: (their places in `which`, the rows)."""
        for lo in range(0, len(which), BLOCK):
            at = which[lo:lo + BLOCK]
            yield slice(lo, lo + len(at)), np.column_stack((self.x[at].astype(float), self.earlier[at]))

    def probabilities(self, which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.empty(len(which))
        for at, rows in self.blocks(which):
            out[at] = _sigmoid(rows @ weights)
        return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of float32 values held as bytes, without a list of them all."""
    out, at = np.empty((len(column), width), dtype="<f4"), 0
    for chunk in column.chunks:
        for lo in range(0, len(chunk), BLOCK):
            part = np.frombuffer(b"".join(chunk.slice(lo, BLOCK).to_pylist()), "<f4").reshape(-1, width)
            out[at:at + len(part)] = part
            at += len(part)
    return out


def _fit(rows: Rows | np.ndarray, truth: np.ndarray, which: np.ndarray | None = None, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Logistic regression by Newton steps over the rows of these numbers (by default all), whose truth is given; the constant isn't penalised.
    With one class only the constant is set."""
    rows = rows if isinstance(rows, Rows) else Rows(rows, np.empty((len(rows), 0)))
    which = np.arange(len(truth)) if which is None else which
    weights = np.zeros(rows.width)
    weights[0] = np.log((truth.sum() + 0.5) / ((1 - truth).sum() + 0.5))
    if not 0 < truth.sum() < len(truth):
        return weights
    penalty = np.full(rows.width, ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        slope, curve = -penalty * weights, np.diag(penalty)
        for at, part in rows.blocks(which):
            p = _sigmoid(part @ weights)
            slope += part.T @ (truth[at] - p)
            curve += (part * (p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _best_threshold(yes: np.ndarray, no: np.ndarray, total: int) -> float:
    """Of THRESHOLDS the one with the best F score at MISS_WEIGHT, the largest of equals; yes, no: rows of each class above each, total: of the category."""
    if not yes.any():
        return THRESHOLD
    return THRESHOLDS[int(np.argmax((1 + MISS_WEIGHT) * yes / ((1 + MISS_WEIGHT) * yes + MISS_WEIGHT * (total - yes) + no)))]


def chosen_words(labelled: DataFrame, categories: list[str], words: int) -> list[str]:
    """For each category the words and word beginnings whose document frequency differs most between its two classes (normal deviate), then in name order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], Counter] = {}
            marks = [batch.column(i + 1).to_pylist() for i in range(len(categories))]
            for r, text in enumerate(batch.column(0).to_pylist()):
                own = {t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)}
                for c in range(len(categories)):
                    if marks[c][r] is not None:
                        seen.setdefault((c, marks[c][r]), Counter()).update(own)
            for (c, mark), counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(counts), pa.int32()), pa.array([mark] * len(counts), pa.int32()), pa.array(list(counts)),
                                                  pa.array(list(counts.values()), pa.int64())], names=["category", "mark", "word", "n"])

    totals = labelled.select([F.count_if(F.col(c) == m).alias(f"{c}{m}") for c in categories for m in (0, 1)]).first()
    tally = labelled.select("text", *categories).mapInArrow(count, "category int, mark int, word string, n long").groupBy("category", "word").agg(
        F.sum(F.when(F.col("mark") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("mark") == 0, F.col("n")).otherwise(0)).alias("no"))
    tally, picked = settle(tally), set()
    for k, c in enumerate(categories):
        no, yes = totals[f"{c}0"], totals[f"{c}1"]
        if no and yes:
            both = (F.col("yes") + F.col("no")) / (no + yes)
            spread = F.sqrt(both * (1 - both) * (1 / yes + 1 / no)) + 1e-9
            far = tally.filter((F.col("category") == k) & (F.col("yes") + F.col("no") >= 3)).withColumn("far", F.abs(F.col("yes") / yes - F.col("no") / no) / spread)
            picked |= {r["word"] for r in far.orderBy(F.col("far").desc(), "word").limit(words).select("word").collect()}
    return sorted(picked)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text",
              sample_rows: int = SAMPLE_ROWS, words: int = WORDS, folds: int = FOLDS) -> Chain:
    """Fit the chain. `categories`: name to SQL expression over labels, 0, 1 or null (not labelled), in chain order.

    `sample_rows` bounds the labelled documents used, taken in the order of a hash of the id; if an id has several label rows the largest value counts.
    A category with one class, or no labelled rows, gets a constant model.
    """
    names = list(categories)
    marks = labels.select(F.col(id_col).alias("key"), *[F.expr(e).cast("int").alias(c) for c, e in categories.items()])
    marks = marks.filter(F.col("key").isNotNull()).groupBy("key").agg(*[F.max(c).alias(c) for c in names])
    sample = marks.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    labelled = settle(texts.join(F.broadcast(sample), "key"))  # the sample is bounded by its parameter
    chosen = chosen_words(labelled, names, words)
    place = {w: i for i, w in enumerate(chosen)}
    width = 4 + len(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t.as_py(), place).astype("<f4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), *(batch.column(i + 2) for i in range(len(names)))],
                                             names=["fold", "x", *names])

    fold = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(folds)).cast("int")
    rows = settle(labelled.select(fold.alias("fold"), "text", *names).mapInArrow(features, "fold int, x binary, " + ", ".join(f"`{c}` int" for c in names)))
    # fit number k < folds leaves fold k out; fit number `folds` sees all
    fits = rows.select(F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("fit"), "*")
    by_fit: list[list[np.ndarray]] = []
    thresholds: list[float] = []

    def train(category: int, earlier: list[list[np.ndarray]]):
        def run(key: tuple, part: pa.Table) -> pa.Table:
            fit, fold = key[0].as_py(), part.column("fold").to_numpy()
            rows = Rows(_matrix(part.column("x"), width), np.empty((part.num_rows, 0)))
            for models in earlier:  # of every row the probability from the model that didn't see its fold
                p = np.empty(len(fold))
                for k in range(folds):
                    mine = np.flatnonzero(fold == k)
                    p[mine] = rows.probabilities(mine, models[k])
                rows = Rows(rows.x, np.column_stack((rows.earlier, p)))
            y = part.column(names[category]).to_pylist()
            known, truth = np.array([v is not None for v in y]), np.array([v or 0 for v in y], dtype=float)
            use, out = np.flatnonzero(known & (fold != fit)), np.flatnonzero(known & (fold == fit))
            weights = _fit(rows, truth[use], use)
            above = rows.probabilities(out, weights)[:, None] > np.array(THRESHOLDS)
            yes, no = (above[truth[out] == m].sum(axis=0).tolist() for m in (1, 0))
            return pa.table({"fit": pa.array([fit], pa.int32()), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())),
                             "yes": pa.array([yes], pa.list_(pa.int64())), "no": pa.array([no], pa.list_(pa.int64())),
                             "total": pa.array([int(truth[out].sum())], pa.int64())})

        return run

    for category in range(len(names)):
        fitted = fits.groupBy("fit").applyInArrow(train(category, by_fit), "fit int, weights array<double>, yes array<long>, no array<long>, total long").collect()
        found = {r["fit"]: np.array(r["weights"]) for r in fitted}
        yes, no = (np.array([r[k] for r in fitted], dtype=float).reshape(-1, len(THRESHOLDS)).sum(axis=0) for k in ("yes", "no"))
        thresholds.append(_best_threshold(yes, no, sum(r["total"] for r in fitted)))
        flat = np.zeros(width + category)
        by_fit.append([found.get(k, flat) for k in range(folds + 1)])
    return Chain(tuple(names), tuple(chosen), tuple(models[folds] for models in by_fit), tuple(thresholds))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and p_<category> for each. Null and empty texts are scored as empty; other columns are not read."""
    outs = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(chain.words)}
        for whole in batches:
            for batch in (whole.slice(lo, BLOCK) for lo in range(0, whole.num_rows, BLOCK)):
                p = chain.probabilities(np.array([features_of(t.as_py(), place) for t in batch.column(1)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(outs)))], names=["doc_id", *outs])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` double" for c in outs))


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs whose probability of the category is at most the threshold, by default the chain's."""
    most = chain.threshold(category) if threshold is None else threshold
    at = chain.categories.index(category)
    place = {w: i for i, w in enumerate(chain.words)}

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts), dtype=bool)
        for lo in range(0, len(texts), BLOCK):
            features = np.array([features_of(t, place) for t in texts.iloc[lo:lo + BLOCK]])
            out[lo:lo + BLOCK] = chain.probabilities(features)[:, at] <= most
        return pd.Series(out)

    return docs.filter(stays(F.col(text_col)))
