"""Sample building: presence, splits, folds, label masks, standardization, input subsets."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.core import all_of, any_of, as_col, hash_uniform, is_finite
from skyframe.functions.labels import has_infrared, has_redshift, log_plug_in_rate, rate_usable
from skyframe.operators.joins import DataError, with_membership
from skyframe.operators.rank import shuffled_rank
from skyframe.params import MODALITIES, TARGETS, Head, SplitParams


def with_presence(matched: DataFrame, spectra: DataFrame, images: DataFrame) -> DataFrame:
    """Add has_spectrum, has_image, has_z and has_wise."""
    out = with_membership(matched, spectra, "targetid", "has_spectrum")
    out = with_membership(out, images, "targetid", "has_image")
    return out.withColumns({"has_z": has_redshift("z", "zwarn"), "has_wise": has_infrared()})


def sample_cuts() -> list[tuple[str, Column]]:
    return [("split_source_pairs_excluded", ~F.col("split_source")), ("has_spectrum", F.col("has_spectrum")),
            ("has_image", F.col("has_image"))]


# ---- splits and folds

def check_fractions(fractions: Sequence[float]) -> None:
    if abs(sum(fractions) - 1.0) > 1e-9 or min(fractions) <= 0:
        raise DataError(f"fractions must be positive and sum to 1, got {list(fractions)}")


def cut_points(fractions: Sequence[float], total: Column) -> list[Column]:
    """Cumulative fractions of the total, rounded half to even, without the last."""
    cumulative = []
    running = 0.0
    for f in fractions[:-1]:
        running += f
        cumulative.append(F.rint(F.lit(running) * total).cast("long"))
    return cumulative


def assign_split(sample: DataFrame, key: str = "targetid", params: SplitParams = SplitParams()) -> DataFrame:
    """Add `split`: position of the key in a seeded shuffle, cut at the rounded cumulative fractions.

    The result depends on the set of keys, the seed and the fractions alone, and sizes are exact.
    """
    check_fractions(params.fractions)
    ranked = shuffled_rank(sample, key, params.seed)
    split = F.lit(params.names[-1])
    for name, edge in reversed(list(zip(params.names, cut_points(params.fractions, F.col("total"))))):
        split = F.when(F.col("rank") < edge, name).otherwise(split)
    return ranked.withColumn("split", split).drop("rank", "total")


def assign_blocks(sample: DataFrame, key: str = "targetid", seed: int = 42, blocks: int = 10) -> DataFrame:
    """Add `block`, 0 to blocks-1, from the same shuffle that cuts the split."""
    ranked = shuffled_rank(sample, key, seed)
    edges = [F.rint(F.lit(i / blocks) * F.col("total")).cast("long") for i in range(1, blocks)]
    block = reduce(lambda a, e: a + F.when(F.col("rank") >= e, 1).otherwise(0), edges, F.lit(0))
    return ranked.withColumn("block", block).drop("rank", "total")


def fold_role(block: Column | str, fold: Column | int, folds: int = 5, blocks: int = 10) -> Column:
    """Role of a block in a fold: it tests its own pair of blocks and validates on the next one."""
    b, f = as_col(block), F.lit(fold) if isinstance(fold, int) else fold
    width = blocks // folds
    return (F.when(F.floor(b / width) == f, "test").when(b == (f * width + width) % blocks, "val").otherwise("train"))


def with_folds(blocked: DataFrame, folds: int = 5) -> DataFrame:
    """One row per (row, fold) with its role."""
    out = blocked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return out.withColumn("role", fold_role("block", F.col("fold"), folds))


def fold_view(parts: Sequence[DataFrame], fold: int, role: str) -> DataFrame:
    """Rows of one fold role from all splits; the parts carry `block`."""
    if not 0 <= fold < 5:
        raise DataError(f"there is no fold {fold}: folds are numbered from 0 to 4")
    everything = reduce(DataFrame.unionByName, parts)
    return everything.filter(fold_role("block", fold) == role)


def blocks_match_split(blocked: DataFrame) -> DataFrame:
    """Whether blocks 0-7, 8 and 9 are exactly train, val and test."""
    expected = F.when(F.col("block") < 8, "train").when(F.col("block") == 8, "val").otherwise("test")
    return blocked.agg((F.count_if(expected != F.col("split")) == 0).alias("blocks_match_existing_split"))


# ---- labels of a head

def target_ok(name: str) -> Column:
    """Whether a row carries a usable measurement of a target."""
    columns = TARGETS[name].columns
    return rate_usable(*columns) if TARGETS[name].is_rate else is_finite(columns[0])


def with_masks(labels: DataFrame) -> DataFrame:
    """Add `<target>_ok` for the targets whose columns are present."""
    known = [n for n, t in TARGETS.items() if set(t.columns) <= set(labels.columns)]
    return labels.withColumns({f"{n}_ok": target_ok(n) for n in known})


def withhold(labels: DataFrame, flag: Column, targets: Sequence[str]) -> DataFrame:
    """NULL every label of the flagged rows and keep the rows."""
    columns = [c for n in targets for c in TARGETS[n].columns]
    return labels.withColumns({c: F.when(~flag, F.col(c)) for c in columns})


def observed_any(head: Head) -> Column:
    return any_of(F.col(f"{t}_ok") for t in head.targets)


def observed_all(head: Head) -> Column:
    return all_of(F.col(f"{t}_ok") for t in head.targets)


def scorable(head: Head) -> Column:
    """Rows a head is scored on: something observed, and for a mixed head an observed scalar."""
    some = observed_any(head)
    if head.scalars() and head.rates():
        some = some & any_of(F.col(f"{t}_ok") for t in head.scalars())
    return some


def common_rows(head: Head, presence: Sequence[Column | str]) -> Column:
    """All modalities present and every target of the head observed."""
    return all_of(as_col(p) for p in presence) & observed_all(head)


def scorable_counts(masked: DataFrame, heads: Sequence[Head]) -> DataFrame:
    """(head, rows) that each head is scored on."""
    counts = masked.agg(*[F.count_if(scorable(h)).alias(h.name) for h in heads])
    return counts.unpivot([], [h.name for h in heads], "head", "rows")


def dead_heads(counts: DataFrame) -> DataFrame:
    """Counts with a mark on heads without any scorable row."""
    return counts.withColumn("dead", F.col("rows") == 0)


def require_live_heads(counts: DataFrame) -> None:
    dead = sorted(r["head"] for r in dead_heads(counts).filter("dead").collect())
    if dead:
        raise DataError(f"no row is scorable for heads {dead}: their targets' labels are missing everywhere")


# ---- standardization

def target_value(name: str) -> Column:
    """A target in natural units: the label, or the log plug-in rate of its triple; NULL where unusable."""
    columns = TARGETS[name].columns
    value = log_plug_in_rate(*columns) if TARGETS[name].is_rate else F.col(columns[0])
    return F.when(target_ok(name), value)


@dataclass(frozen=True)
class Standardizer:
    """Mean and population deviation per target, measured on the training split."""

    mean: dict[str, float]
    scale: dict[str, float]

    def encode(self, name: str, value: Column) -> Column:
        return (value - self.mean[name]) / self.scale[name]

    def decode(self, name: str, value: Column) -> Column:
        return value * self.scale[name] + self.mean[name]

    def to_json(self) -> str:
        return json.dumps({"mean": self.mean, "scale": self.scale}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Standardizer:
        d = json.loads(text)
        return cls(d["mean"], d["scale"])


def moments(train: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(target, n, mean, scale) rows over the non-NULL values; scale is the population deviation."""
    parts = []
    for name, c in values.items():
        parts.append(F.struct(F.lit(name).alias("target"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                              F.stddev_pop(c).alias("scale")))
    return train.agg(F.array(*parts).alias("_m")).select(F.explode("_m").alias("_m")).select("_m.*")


def fit_standardizer(labels: DataFrame, targets: Sequence[str]) -> Standardizer:
    """Fit on rows of the training split only; a target needs two usable rows and some spread."""
    train = labels.filter("split = 'train'")
    rows = moments(train, {t: target_value(t) for t in targets}).collect()
    for r in rows:
        if r["n"] < 2:
            raise DataError(f"target {r['target']!r} has {r['n']} usable training rows")
        if not r["scale"] > 0 or not math.isfinite(r["scale"]):
            raise DataError(f"the training values of {r['target']!r} have no finite spread")
    return Standardizer({r["target"]: r["mean"] for r in rows}, {r["target"]: r["scale"] for r in rows})


# ---- combinations of inputs

def subset_names() -> list[str]:
    """The 15 non-empty combinations of the four modalities, smallest first."""
    return ["".join(c) for size in range(1, len(MODALITIES) + 1) for c in combinations(MODALITIES, size)]


def subset_array() -> Column:
    """Literal array of (ordinal, subset), for exploding next to any table."""
    return F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("subset")) for i, n in enumerate(subset_names())])


def with_subsets(df: DataFrame) -> DataFrame:
    """One row per (row, combination)."""
    return df.withColumn("_s", F.explode(subset_array())).select(*df.columns, "_s.ordinal", "_s.subset")


def subset_ordinal(subset: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in subset_names()]), as_col(subset)).cast("int") - 1


def draw_subset(present: Sequence[Column | str], key: str, seed: int) -> Column:
    """One combination per row: its size uniform over 1 to the number present, then its members uniform.

    Modalities are ordered by a hashed uniform, absent ones last, and the first `size` are taken.
    """
    flags = [as_col(p) for p in present]
    available = reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
    size = F.floor(hash_uniform(seed, F.lit("size"), key) * available) + 1
    noise = [F.when(f, hash_uniform(seed, F.lit(m), key)).otherwise(-1.0) for m, f in zip(MODALITIES, flags)]
    taken = []
    for i, mine in enumerate(noise):
        ahead = [F.when((other > mine) | ((other == mine) & F.lit(j < i)), 1).otherwise(0)
                 for j, other in enumerate(noise) if j != i]
        taken.append(reduce(lambda a, b: a + b, ahead) < size)
    return F.concat(*[F.when(t, F.lit(m)).otherwise("") for m, t in zip(MODALITIES, taken)])
