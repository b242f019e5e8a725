"""SimHash near-duplicates against a brute-force version of their definition."""

import random
import re

import xxhash

from skyframe.llm.simhash import BKTree, fingerprint, fingerprints, near_duplicates, near_links

SCHEMA = "doc_id long, text string, fp string, component_id string, source string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(marks):
    """marks: [(id, fingerprint)]; the smallest id reachable over links of 2 bits or fewer."""
    group = list(range(len(marks)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
                group[root(i)] = root(j)
    best = {}
    for i, (key, _) in enumerate(marks):
        if key is not None:
            best[root(i)] = min(best.get(root(i), key), key)
    return [best.get(root(i)) for i in range(len(marks))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "one TWO", "Ä b C d", "x" * 50_000, "ÀÉ\x0bq\x0cr\rs\x85t u v w"]
    texts += [" ".join(rng.choice(["a", "bb", "Ccc", "é", "."]) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    assert [fingerprint(t) for t in texts] == [signed(plain_fingerprint(t)) for t in texts]


def test_tree_finds_all_within_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(16) for _ in range(600)]
    tree = BKTree()
    for v in values:
        tree.insert(v)
    assert len(tree.values) == len(set(values))
    for v in values[:60] + [rng.getrandbits(16) for _ in range(60)]:
        assert {tree.values[i] for i in tree.search(v, 2)} == {x for x in values if (x ^ v).bit_count() <= 2}


def test_components_match_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(30)) for _ in range(25)]
    texts = base + [b.replace("aaa", "zzz", 1) for b in base] + [b + " tail" for b in base] + base[:4] * 3 + [None, "", "  ", "q"]
    rows = [(i * 7 % 101, t, "x", None, "s") for i, t in enumerate(texts)] + [(None, base[0], "x", None, None), (3, base[1], None, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    marks = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted(((m[0], signed(m[1]), c) for m, c in zip(marks, plain_components(marks))), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_crowded_shards_lose_no_link(spark):
    rng = random.Random(4)
    seed = rng.getrandbits(64)
    values = sorted({seed} | {seed ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4]))) for _ in range(300)})
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(r["a"], r["b"]) for r in near_links(fps, shard_rows=16).collect()]
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 2 for a, b in links)
    place = {signed(v): i for i, v in enumerate(values)}
    group = list(range(len(values)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        group[root(place[a])] = root(place[b])
    want = plain_components([(i, v) for i, v in enumerate(values)])
    least = {}
    for i in range(len(values)):
        least.setdefault(root(i), i)
    assert [least[root(i)] for i in range(len(values))] == want
    assert len(links) < 6 * 300 * 20


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blank_texts_share_fingerprint_zero(spark):
    rows = spark.createDataFrame([(4, None), (6, " "), (1, "word")], "doc_id long, text string")
    assert {(r["doc_id"], r["fp"] == 0) for r in fingerprints(rows).collect()} == {(4, True), (6, True), (1, False)}
