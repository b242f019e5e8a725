"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    """Register fn(spark, sf_dir) under a name."""

    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_simhash_bktree")
def simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    from skyframe.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_pii_deobfuscated")
def pii_deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans; n_added counts those that only the rewriting shows."""
    from skyframe.llm.pii import KINDS, find_pii, joined_spans

    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


@query("op4_embedding_itq")
def embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: cosine of at least 0.98 within a label."""
    from skyframe.llm.itq import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_topk_histogram")
def topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for every row whose vec_id is divisible by 50."""
    from skyframe.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op2_topk_histogram"] = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


@query("op6_pieces_ffbs")
def pieces_ffbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pieces, lossless and n_pieces of every document: one sampled segmentation, seeded by doc_id."""
    from skyframe.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents")).select("doc_id", "pieces", "lossless", F.coalesce(F.size("pieces"), F.lit(0)).alias("n_pieces"))


@query("op10_katz_scores")
def katz_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a word-pair model learned from those not held out."""
    from skyframe.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


@query("op8_pfair_mix")
def pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of all sources, to weights in proportion to count ** 0.7."""
    from skyframe.llm.mixing import mix

    placed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


@query("op3_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_poor, p_toxic, toxic of every document, by a chain fitted on the labelled ones."""
    from skyframe.llm.toxicity import fit_chain, score

    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") > chain.threshold("toxic"))


@query("op1_token_lengths")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source and every encoded length that occurs: documents, and what a context limit of that length keeps and cuts."""
    from skyframe.llm.tokens import histogram, suffix_sums

    return suffix_sums(histogram(table(spark, sf_dir, "documents"), ["source"]), ["source"])


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in the documents with its coverage and its characters."""
    from skyframe.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


SQL["op4_embedding_itq"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
  AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

# One step of the recursion fills one slot: of the sources' next blocks that are released, the one that is due first.
SQL["op8_pfair_mix"] = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s,
    md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h FROM documents),
ranked AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 4096, h) - 1 AS n FROM d),
powers AS (SELECT s, pow(count(*), 0.7e0) AS p FROM d GROUP BY s),
scaled AS (SELECT s, p * (1000 / sum(p) OVER ()) AS x FROM powers),
whole AS (SELECT s, greatest(1, CAST(floor(x) AS BIGINT)) AS w, x - floor(x) AS rest FROM scaled),
weights AS (SELECT s, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, s) <= 1000 - sum(w) OVER () THEN 1 ELSE 0 END AS w FROM whole),
total AS (SELECT CAST(sum(w) AS BIGINT) AS t FROM weights),
start AS (SELECT list({'s': s, 'w': CAST(w AS BIGINT), 'j': CAST(0 AS BIGINT)} ORDER BY s) AS state FROM weights),
run AS (SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS nth, state FROM start
  UNION ALL
  SELECT slot + 1, pick.s, pick.j, [CASE WHEN x.s = pick.s THEN {'s': x.s, 'w': x.w, 'j': x.j + 1} ELSE x END FOR x IN state]
  FROM (SELECT slot, state, t, list_min([{'due': -((-(x.j + 1) * t) // x.w), 'heavy': -x.w, 's': x.s, 'j': x.j} FOR x IN state
      IF x.j < x.w AND (x.j * t) // x.w <= slot + 1]) AS pick FROM run, total WHERE slot + 1 < t))
SELECT r.doc_id, r.source, r.n // 8 + 1 AS block, (r.n // 8) // w.w * t + run.slot AS slot,
  ((r.n // 8) // w.w * t + run.slot) * 8 + r.n % 8 AS position
FROM ranked r JOIN weights w USING (s) JOIN total ON TRUE JOIN run ON run.s = r.s AND run.nth = (r.n // 8) % w.w
"""


@query("op11_spelling_trie")
def spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents with at least 7 letters and 2 occurrences, after planted slips."""
    from skyframe.llm.spelling import SLIP, count_words, group_variants

    return group_variants(count_words(table(spark, sf_dir, "documents"), slip=SLIP))


@query("op13_quality_cascade")
def quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, whether they fail it, and whether the cascade of all rules keeps it."""
    from skyframe.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


SQL["op13_quality_cascade"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
one AS (SELECT k, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (SELECT k, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o IS NOT NULL AS whole
  FROM one WINDOW o AS (PARTITION BY k ORDER BY i)),
told AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams WHERE whole),
again AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM told WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, t, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS wc,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN again USING (k)),
c AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR 10 * len([x FOR x IN words IF NOT regexp_matches(x, '\p{L}')]) > 3 * n_words
    OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
    OR 2 * length(regexp_replace(t, '[^!?]+', '', 'g')) > n_words
    OR (n_words >= 50 AND len(list_distinct([lower(x) FOR x IN words IF lower(x) IN ('the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'with', 'on',
      'as', 'was', 'are', 'this', 'it', 'der', 'die', 'das', 'und', 'den', 'von', 'zu', 'mit', 'ein', 'eine', 'nicht', 'im', 'de', 'la', 'que', 'el', 'en',
      'y', 'los', 'por', 'con', 'una', 'para', 'las', 'le', 'les', 'des', 'et', 'un', 'une', 'est', 'dans', 'qui', 'pas')])) < 2)) AS kept
FROM c
"""


@query("op12_hard_negatives")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100; labels of ids divisible by 7 move on by one first."""
    from skyframe.llm.negatives import mine_hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE alike) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.r ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
