"""Token counts: the exact histogram of encoded lengths, whose suffix sums answer totals, quantiles and truncated totals for every context limit.

Only (group, length, documents) leaves the tasks that encode, added up before the shuffle. The suffix sums run in two levels, over buckets of
lengths and inside each bucket, so that no window holds all lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.session import settle

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKET = 1024

# Fixed value: the public byte-level pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as lines:  # a vocabulary file of fixed size that every node has
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def lengths(docs: DataFrame, keys: Sequence[str] = (), text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """The keys and n_tokens of every row of docs. Null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    rows = docs.select(F.col(text_col).alias("text_to_encode"), *[F.col(f"`{k}`") for k in keys])
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n_tokens long")


def histogram(docs: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Exact: keys, n_tokens, docs (how many rows have that length). A null key is a group of its own."""
    return lengths(docs, keys, **options).groupBy(*[F.col(f"`{k}`") for k in keys], "n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """To each row of a histogram: total_docs, total_tokens, docs_longer and tokens_longer (lengths above n_tokens), share_within (documents of at
    most n_tokens) and tokens_kept (all tokens if every document is cut at n_tokens)."""
    names = [f"`{k}`" for k in keys]
    tokens = F.col("n_tokens") * F.col("docs")
    counts = settle(counts)  # read twice below; texts are encoded once
    wide = counts.withColumn("length_bucket", F.floor(F.col("n_tokens") / BUCKET))
    sums = wide.groupBy(*names, "length_bucket").agg(F.sum("docs").alias("bucket_docs"), F.sum(tokens).alias("bucket_tokens"))
    above = Window.partitionBy(*names).orderBy(F.col("length_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    sums = sums.select(*[F.col(k).alias(f"bucket_key_{i}") for i, k in enumerate(names)], F.col("length_bucket").alias("bucket_of"),
                       F.coalesce(F.sum("bucket_docs").over(above), F.lit(0)).alias("docs_above"),
                       F.coalesce(F.sum("bucket_tokens").over(above), F.lit(0)).alias("tokens_above"),
                       F.sum("bucket_docs").over(whole).alias("total_docs"), F.sum("bucket_tokens").over(whole).alias("total_tokens"))
    same = F.col("length_bucket") == F.col("bucket_of")
    for i, k in enumerate(names):
        same = same & F.col(k).eqNullSafe(F.col(f"bucket_key_{i}"))
    inside = Window.partitionBy(*names, "length_bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = wide.withColumn("docs_longer", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn(
        "tokens_longer", F.coalesce(F.sum(tokens).over(inside), F.lit(0))).join(sums, same)
    longer, more = F.col("docs_longer") + F.col("docs_above"), F.col("tokens_longer") + F.col("tokens_above")
    return joined.select(*names, "n_tokens", "docs", "total_docs", "total_tokens", longer.alias("docs_longer"), more.alias("tokens_longer"),
                         (1 - longer / F.col("total_docs")).alias("share_within"),
                         (F.col("total_tokens") - more + longer * F.col("n_tokens")).alias("tokens_kept"))


def at_limits(sums: DataFrame, limits: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """For any context limits: context_limit, docs_cut, tokens_kept. Between two lengths of the table the next longer one decides."""
    names = [f"`{k}`" for k in keys]
    asked = sums.withColumn("context_limit", F.explode(F.lit([int(x) for x in limits])))
    cut = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)
    kept = F.least("n_tokens", "context_limit") * F.col("docs")
    return asked.groupBy(*names, "context_limit").agg(F.sum(cut).alias("docs_cut"), F.sum(kept).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents doesn't exceed."""
    names = [f"`{k}`" for k in keys]
    asked = sums.withColumn("share", F.explode(F.lit([float(x) for x in shares])))
    return asked.filter(F.col("total_docs") - F.col("docs_longer") >= F.col("share") * F.col("total_docs")).groupBy(*names, "share").agg(
        F.min("n_tokens").alias("n_tokens"))
