"""Token counts against counting every document for every limit."""

import random
from collections import Counter

from skyframe.llm.tokens import at_limits, encoder, histogram, quantiles, suffix_sums

SCHEMA = "doc_id long, text string, source string, docs string, n_tokens string"


def test_all_answers(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["token", "counts", "éß", "<|endoftext|>", "12"]) for _ in range(rng.choice([0, 1, 5, 900, 1500, 3000]))) for _ in range(80)]
    rows = [(i, t, rng.choice(["a", "a", "b", None]), "x", None) for i, t in enumerate(texts)] + [(None, None, "a", None, None), (1, "", "b", "y", "z")] * 2
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    size = {t: len(encoder().encode_ordinary(t or "")) for t in {r[1] for r in rows}}
    counts = histogram(frame, ["source"])
    assert {(r[0], r[1]): r[2] for r in counts.collect()} == Counter((r[2], size[r[1]]) for r in rows)
    sums = suffix_sums(counts, ["source"])
    for r in sums.collect():
        own = [size[x[1]] for x in rows if x[2] == r["source"]]
        limit = r["n_tokens"]
        assert (r["docs"], r["total_docs"], r["total_tokens"]) == (own.count(limit), len(own), sum(own))
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(n > limit for n in own), sum(n for n in own if n > limit))
        assert r["tokens_kept"] == sum(min(n, limit) for n in own) and abs(r["share_within"] - sum(n <= limit for n in own) / len(own)) < 1e-12
    for r in at_limits(sums, [0, 7, 1024, 10**6], ["source"]).collect():
        own = [size[x[1]] for x in rows if x[2] == r["source"]]
        assert (r["docs_cut"], r["tokens_kept"]) == (sum(n > r["context_limit"] for n in own), sum(min(n, r["context_limit"]) for n in own))
    for r in quantiles(suffix_sums(histogram(frame)), [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        own = sorted(size[x[1]] for x in rows)
        assert r["n_tokens"] == min(n for n in own if sum(m <= n for m in own) >= r["share"] * len(own))


def test_special_strings_are_text_and_empty_table(spark):
    assert len(encoder().encode_ordinary("<|endoftext|>")) > 1
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_sums(histogram(empty, ["source"]), ["source"]).count() == 0
