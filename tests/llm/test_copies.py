"""Near copies at a Jaccard similarity of 0.8 of 5-word shingles, against all pairs."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402

from skyframe.llm import copies  # noqa: E402
from skyframe.llm.copies import keep_one_copy  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Indices of the rows that stay; ids and texts are distinct."""
    sets, group = [plain_shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return set(least.values())


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(["new", "other", "edit"]) + str(rng.randrange(99))
    return " ".join(words)


def corpus(seed, most):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bdfglmnprst" for b in ["a", "eno", "irul", "otam"]]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))) for _ in range(30)]
    texts = base + [edited(rng, b, n) for b in base for n in range(1, most)]
    ids = rng.sample(range(10_000), len(texts) + 2)
    return list(zip(ids, texts + ["", " "], ["s"] * len(ids)))


def test_stage_drops_edited_copies_at_the_similarity(spark):
    rows = corpus(1, 8)
    got = corpus_pipeline.simhash(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(plain_kept(rows))


def test_small_blocks_lose_no_pair(spark):
    rows = corpus(2, 6)
    got = keep_one_copy(spark.createDataFrame(rows, SCHEMA), block=3).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(plain_kept(rows))


def test_one_id_on_different_texts(spark):
    a, b = "one two three four five six seven", "some other words stand in this one text"
    rows = [(5, a, "s"), (5, b, "s"), (5, b, "s"), (7, a, "t"), (None, a, "u"), (9, None, "v"), (8, "", "w")]
    got = keep_one_copy(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect())) == [(0, a), (5, a), (5, b), (8, "")]


def test_columns_of_the_same_names(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "a", 1, 2.0), (3, text, "b", 2, 1.0), (None, text, "c", 3, 0.0), (8, "an other text of its own words", None, None, None)]
    got = keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string, copy_key string, kept_id int, kept_key double"))
    assert got.columns == ["doc_id", "text", "copy_key", "kept_id", "kept_key"]
    assert sorted((r["doc_id"] or 0, r["copy_key"]) for r in got.collect() if r["copy_key"]) == [(0, "c"), (3, "b")]


def test_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """Without bands in common, texts whose fingerprints differ by two bits at most are still linked, if they are alike."""
    rng = random.Random(5)
    vocabulary = [a + b for a in "bdfglmnprst" for b in ["a", "eno", "irul", "otam"]]
    base = [" ".join(rng.choice(vocabulary) for _ in range(900)) for _ in range(6)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(50 + i, t + " end", "s") for i, t in enumerate(base)] + [(80 + i, t.upper(), "s") for i, t in enumerate(base)]
    bits = [(copies.fingerprint(t, 5) ^ copies.fingerprint(t + " end", 5)).bit_count() for t in base]
    assert all(b <= 2 for b in bits)
    monkeypatch.setattr(copies, "bands_of", lambda hashes: [])
    got = keep_one_copy(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6))
