"""Near copies by SimHash and the Jaccard similarity of word shingles: the pipeline's near-dedup stage.

Texts first meet by SimHash: fingerprints of their five-word shingles, searched with BK-trees (`simhash`). Fingerprints of edited copies at a similarity
of 0.8 differ by 4 to 14 bits (all 48 pairs of different texts in sf0.1), and equal parts of bits for that radius are beyond use: 16 parts and a radius
of 12 would already be 1,820 shards a fingerprint. So texts also meet by bands of minima of rehashed shingles (20 bands of four: a pair at 0.8 is missed
with probability 3e-5, more similar ones less often; all 48 pairs meet). Every link of either kind is confirmed by the exact similarity of whole shingle
sets.

Texts in bands are first compared with one leader per band, which joins large groups of copies in linear work; then, in bands where several components
are left, all pairs of texts of different components are compared, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import components, runs
from skyframe.llm.simhash import RADIUS, fingerprint, near_links
from skyframe.session import settle

SEED = 42
WORDS = 5
SIMILARITY = 0.8
BANDS = 20
BAND_ROWS = 4
BLOCK = 256
LEADER_ROUNDS = 2
CHUNK = 1 << 12


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles. Blank texts have none; a text of fewer words than a shingle has one, all its words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, size = xxhash.xxh64_intdigest, min(words, len(found))
    return np.array(sorted({digest(b" ".join(found[i:i + size]), seed) for i in range(len(found) - size + 1)} if found else ()), dtype="<u8")


def bands_of(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = SEED) -> list[int]:
    """One signed key per band, of the band's number and `rows` minima of rehashed shingles. Texts without shingles share theirs."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[lo:lo + CHUNK, None] * factors).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * rows:(k + 1) * rows].tobytes(), seed + k) for k in range(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty ones have 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) + 1e-9 < similarity * len(b):
        return False
    if not len(a):
        return True
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both + 1e-9 >= similarity * (len(a) + len(b) - both)


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), "<u8")


def _confirm(similarity: float):
    """Of rows a, b, set of a, set of b those alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([alike(_set(x), _set(y), similarity) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _compare(similarity: float):
    """Rows sorted by block (band, kind, i, j): links between texts of different components that join what all similar pairs of the block join."""

    def links(rows: list[tuple[int, int, int, np.ndarray]], kind: int, i: int, j: int) -> list[tuple[int, int]]:
        parents: dict[int, int] = {}

        def root(x: int) -> int:
            while parents.setdefault(x, x) != x:
                parents[x] = x = parents[parents[x]]
            return x

        out = []
        inside = kind == 0 and i == j
        left = rows if inside else [r for r in rows if r[0] == 0]
        right = rows if inside else [r for r in rows if r[0] == 1]
        for n, (_, a, ra, x) in enumerate(left):
            for _, b, rb, y in right[n + 1:] if inside else right:
                if root(ra) != root(rb) and alike(x, y, similarity):
                    parents[root(ra)] = root(rb)
                    out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, np.ndarray]] = []
        at, found = (0, 0, 0), []
        for fresh, part in runs(batches, "band", "kind", "i", "j"):
            if fresh:
                found += links(rows, *at)
                rows, at = [], tuple(part.column(k)[0].as_py() for k in (1, 2, 3))
            sides, keys, roots = (part.column(k).to_pylist() for k in (4, 5, 6))
            rows += zip(sides, keys, roots, map(_set, part.column(7)))
            if len(found) > CHUNK:
                yield _pairs(found)
                found = []
        yield _pairs(found + links(rows, *at))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _blocks(met: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Rows of met (band, key, root) of bands with several roots, dealt so that any two texts of different roots share a block of two pieces.

    Of a band's largest component no two texts have to meet, so its pieces meet only those of the others.
    """
    sizes = met.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("big"), F.max("n").alias("n_big"), F.sum("n").alias("n_all"))
    sizes = sizes.filter("n_all > n_big").select("band", "big", F.ceil(F.col("n_big") / block).cast("int").alias("bigs"),
                                                 F.ceil((F.col("n_all") - F.col("n_big")) / block).cast("int").alias("smalls"))
    rows = settle(met.join(settle(sizes), "band"))
    small = rows.filter("root <> big").withColumn("p", F.pmod(F.xxhash64("key"), F.col("smalls")).cast("int"))
    among = small.select("band", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("smalls") - 1)).alias("q"), "p", "key", "root").select(
        "band", "kind", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"), "key", "root")
    beside = small.select("band", F.lit(1).alias("kind"), F.col("p").alias("i"), F.explode(F.sequence(F.lit(0), F.col("bigs") - 1)).alias("j"),
                          F.lit(0).alias("side"), "key", "root")
    large = rows.filter("root = big").withColumn("p", F.pmod(F.xxhash64("key"), F.col("bigs")).cast("int")).select(
        "band", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("smalls") - 1)).alias("i"), F.col("p").alias("j"), F.lit(1).alias("side"),
        "key", "root")
    return settle(among.union(beside).union(large)).join(sets, "key").select("band", "kind", "i", "j", "side", "key", "root", "shingles")


def _by_fingerprint(contents: DataFrame, radius: int) -> DataFrame:
    """Pairs a, b of keys that join what fingerprints (column fp) within the radius join: each text with the first of its fingerprint, those along the links."""
    homes = settle(contents.groupBy("fp").agg(F.min("key").alias("home")))
    same = contents.select("key", "fp").join(homes, "fp").filter("key <> home").select(F.col("key").alias("a"), F.col("home").alias("b"))
    links = settle(near_links(homes.select("fp"), radius))
    near = links.join(homes.select(F.col("fp").alias("a"), F.col("home").alias("one")), "a").join(homes.select(F.col("fp").alias("b"), F.col("home").alias("other")), "b")
    return settle(same.union(near.select("one", "other")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
                block: int = BLOCK, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row of docs and (key, root, least_id) of every text: its component and the smallest id in it, null if there is none.

    Texts are linked if the Jaccard similarity of their shingles is at least `similarity`. `key` is Spark's XXH64 of the text, and texts of one
    key count as one; null texts count as empty, and all blank texts are alike.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [bands_of(shingles(t.as_py(), words)) for t in batch.column(2)]
            fps = [fingerprint(t.as_py(), words, SEED) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["doc_id", "key", "fp", "bands"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "shingles"])

    marked = settle(texts.mapInArrow(mark, "doc_id long, key long, fp long, bands array<long>"))
    contents = settle(marked.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    tied = _by_fingerprint(contents, radius)
    keyed = settle(contents.select("key", F.explode("bands").alias("band")))
    met = settle(keyed.join(settle(keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")), "band"))
    meeting = met.select("key").union(tied.select("a")).union(tied.select("b"))
    wanted = settle(meeting.distinct().join(contents.select("key", "first_id"), "key").select(F.col("key").alias("k"), "first_id"))
    chosen = texts.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = settle(chosen.select("key", "text").dropDuplicates(["key"]).mapInArrow(gather, "key long, shingles binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = settle(pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a"))
        both = left.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        return settle(both.mapInArrow(_confirm(similarity), "a long, b long"))

    links = confirmed(tied)
    roots = _roots(wanted, links)
    for turn in range(LEADER_ROUNDS):
        placed = settle(met.join(roots, "key"))
        order = F.xxhash64(F.lit(turn), "band", "key")
        leaders = settle(placed.groupBy("band").agg(F.min_by(F.struct("key", "root"), F.struct(order, "key")).alias("lead")))
        asked = placed.join(leaders, "band").filter("root <> lead.root").groupBy("key").agg(F.max_by("lead.key", F.struct("n", "band")).alias("lead"))
        links = links.union(confirmed(settle(asked.select(F.col("key").alias("a"), F.col("lead").alias("b")))))
        roots = _roots(wanted, links)
    ready = _blocks(settle(met.join(roots, "key")).select("band", "key", "root"), sets, block)
    spread = ready.repartition("band", "kind", "i", "j").sortWithinPartitions("band", "kind", "i", "j", "side", "key")
    links = links.union(settle(spread.mapInArrow(_compare(similarity), "a long, b long")))
    roots = _roots(wanted, links)
    named = contents.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first_id")
    named = settle(named)
    least = settle(named.groupBy("root").agg(F.min("first_id").alias("least_id")))
    return marked.select("doc_id", "key"), settle(named.join(least, "root").select("key", "root", "least_id"))


def _roots(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """key, root of every text that met another one."""
    linked = components(links, "a", "b")
    return settle(wanted.join(linked, F.col("k") == F.col("node"), "left").select(F.col("k").alias("key"), F.coalesce("root", "k").alias("root")))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each component one row with its smallest id, of its texts that have this id the one of the smallest key.

    Rows without an id stay; they can't name a copy.
    """
    marked, ids = near_copies(docs, id_col, text_col, **options)
    first = marked.join(ids, "key").filter("doc_id = least_id").groupBy("root").agg(F.min(F.struct("key", "doc_id")).alias("least"))
    taken = [c.lower() for c in docs.columns]
    key_name, kept_key, kept_id = (next(n for n in (f"{base}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for base in ("copy_key", "kept_key", "kept_id"))
    kept = settle(first.select(F.col("least.key").alias(kept_key), F.col("least.doc_id").alias(kept_id)))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    chosen = docs.withColumn(key_name, key).join(kept, (F.col(id_col) == F.col(kept_id)) & (F.col(key_name) == F.col(kept_key)), "left_semi")
    return chosen.dropDuplicates([id_col, key_name]).drop(key_name).unionByName(docs.filter(F.col(id_col).isNull()))
