"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents. Of a source with weight w out of W, block j (from 1) is released at slot (j - 1) W / w and due by
slot j W / w, rounded down and up; each slot takes the released block that is due first. The order of slots repeats after W of them, so one period
of W slots is laid out once, from the weights alone, and every block finds its slot by arithmetic: whole periods plus its place in the period.
The documents are numbered within their source in the order of a seeded hash, by counts of hash buckets, so that no source is ordered in one task.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42
BLOCK_ROWS = 8
SLOTS = 1000
EXPONENT = 0.7
BUCKETS = 4096
BROADCAST_SLOTS = 100_000


def period(weights: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, number of the block within the period from 0, slot from 0) of one period: earliest deadline first among released blocks.

    Ties go to the heavier source, then to the name. After any number of slots every source is less than one block from its share.
    """
    if any(w < 1 or int(w) != w for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    total, out = sum(weights.values()), []
    waiting = [(0, name, 0) for name in sorted(weights)]  # by release
    ready: list[tuple[int, int, str, int]] = []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[name]), -weights[name], name, block))
        _, _, name, block = heapq.heappop(ready)
        out.append((name, block, slot))
        if block + 1 < weights[name]:
            heapq.heappush(waiting, ((block + 1) * total // weights[name], name, block + 1))
    return out


def tempered(counts: Mapping[str, int], exponent: float = EXPONENT, slots: int = SLOTS) -> dict[str, int]:
    """Whole weights in proportion to count ** exponent that sum up to `slots` (more, if there are more sources): largest remainders, 1 at least."""
    if not counts:
        return {}
    powers = {k: n**exponent for k, n in counts.items()}
    scale = max(slots, len(counts)) / sum(powers.values())
    weights = {k: max(1, int(p * scale)) for k, p in powers.items()}
    short = max(slots, len(counts)) - sum(weights.values())
    for k in sorted(powers, key=lambda k: (-(powers[k] * scale % 1), k))[: max(0, short)]:
        weights[k] += 1
    return weights


def numbered(docs: DataFrame, source_col: str, order_col: str, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """docs with mix_number: from 0 within the source, in the order of a hash of the id; rows of one id follow their own columns' hash."""
    # casts keep the hash independent of the columns' types; a null hashes as a word of its own
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(order_col).cast("string"), F.lit("null"))))
    simple = [F.col(f"`{f.name}`").cast("string") for f in docs.schema if f.dataType.typeName() in ("string", "long", "integer", "double", "short")]
    keyed = docs.select("*", digest.alias("mix_digest"), F.xxhash64(*simple).alias("mix_row"))
    bucket = F.conv(F.substring("mix_digest", 1, 8), 16, 10).cast("long") % buckets
    keyed = keyed.withColumn("mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("mix_bucket", bucket)
    sizes = keyed.groupBy("mix_source", "mix_bucket").agg(F.count("*").alias("mix_n"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("mix_source", "mix_bucket", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start"))
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_digest", "mix_row")
    ranked = keyed.withColumn("mix_rank", F.row_number().over(inside) - 1).join(starts, ["mix_source", "mix_bucket"])
    return ranked.withColumn("mix_number", F.col("mix_start") + F.col("mix_rank")).drop("mix_digest", "mix_row", "mix_bucket", "mix_rank", "mix_start")


def layout(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """The period as a table, whose size is the sum of the weights: mix_source, mix_nth, mix_slot, mix_weight, mix_period."""
    rows = [{"mix_source": s, "mix_nth": n, "mix_slot": t, "mix_weight": weights[s], "mix_period": sum(weights.values())} for s, n, t in period(weights)]
    kind = "array<struct<mix_source:string,mix_nth:long,mix_slot:long,mix_weight:long,mix_period:long>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, source_col: str = "source", order_col: str = "doc_id", block_rows: int = BLOCK_ROWS,
        seed: int = SEED) -> DataFrame:
    """docs with mix_block (from 1, within the source), mix_slot (of the block in the mixed order) and mix_position (of the row; unique).

    `weights`: whole target weights by source, exact in every period; None takes `tempered` ones from the sources' counts, whose number the driver
    holds. A source without a weight has weight 1; a null source counts as the source "". Every row is placed: a source that ends leaves its later slots
    empty, and the order of the rest stays. Repeated rows are rows of their own. Columns of docs whose names start with "mix_" are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    found = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s")).count().collect()  # one row per source
    counts = {r["s"]: r["count"] for r in found}
    shares = tempered(counts) if weights is None else {s: int(weights.get(s, 1)) for s in counts}
    ranked = numbered(docs, source_col, order_col, seed).withColumn("mix_block", F.floor(F.col("mix_number") / block_rows).cast("long"))
    plan = layout(docs.sparkSession, shares or {"": 1})
    share = plan.select("mix_source", "mix_weight").distinct()
    if sum(shares.values()) <= BROADCAST_SLOTS:
        plan, share = F.broadcast(plan), F.broadcast(share)
    placed = ranked.join(share, "mix_source").withColumn("mix_nth", F.col("mix_block") % F.col("mix_weight")).drop("mix_weight").join(
        plan, ["mix_source", "mix_nth"])
    slot = F.floor(F.col("mix_block") / F.col("mix_weight")).cast("long") * F.col("mix_period") + F.col("mix_slot")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("mix_block") + 1).alias("mix_block"), slot.alias("mix_slot"),
                         (slot * block_rows + F.col("mix_number") % block_rows).alias("mix_position"))


def in_mixed_order(docs: DataFrame, weights: Mapping[str, int] | None = None, partitions: int | None = None, **options) -> DataFrame:
    """The rows and columns of docs, in files that follow the mixed order from the first partition to the last."""
    columns = docs.columns
    placed = mix(docs, weights, **options)
    count = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(count, "mix_position").sortWithinPartitions("mix_position").select(*[F.col(f"`{c}`") for c in columns])
