"""Katz backoff against a plain version over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from skyframe.llm.katz import discounts, katz_scores, packed, unpacked

SCHEMA = "doc_id long, text string, block int, score string"


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Plain:
    def __init__(self, rows):
        self.single, self.pair = Counter(), Counter()
        for i, text in rows:
            if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
                tokens = tokens_of(text)
                self.single.update(tokens)
                self.pair.update(zip(["<s>"] + tokens, tokens))
        self.starts = sum(n for (c, _), n in self.pair.items() if c == "<s>")
        self.total, self.distinct = sum(self.single.values()), len(self.single)
        n = [0] + [sum(x == r for x in self.pair.values()) for r in range(1, 7)]
        self.d = {r: 1.0 for r in range(1, 6)}
        rest = 6 * n[6] / n[1] if n[1] else 1
        for r in range(1, 6):
            if n[r] and rest < 1:
                share = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                self.d[r] = share if 0 < share <= 1 else 1.0

    def p(self, word):
        return (self.single[word] + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def katz(self, word, context):
        n = self.starts if context == "<s>" else self.single[context]
        if not n:
            return self.p(word)
        if self.pair[context, word]:
            r = self.pair[context, word]
            return self.d.get(r, 1.0) * r / (n + 1)
        after = [(w, r) for (c, w), r in self.pair.items() if c == context]
        left = 1 - sum(self.d.get(r, 1.0) * r for _, r in after) / (n + 1)
        return left / (1 - sum(self.p(w) for w, _ in after)) * self.p(word)


def compare(spark, rows, **options):
    model = Plain([(r[0], r[1]) for r in rows])
    got = katz_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = []
    for i, text, *_ in rows:
        tokens = tokens_of(text)
        want.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(model.single[t] > 0 for t in tokens), model.total,
                     sum(math.log10(model.p(t)) for t in tokens), sum(math.log10(model.katz(t, c)) for c, t in zip(["<s>"] + tokens, tokens))))
    found = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect())
    assert [f[:5] for f in found] == [w[:5] for w in sorted(want)]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in sorted(want)], rtol=1e-9, atol=1e-9)
    return model


def made(seed, n, letters="abcdefg"):
    rng = random.Random(seed)
    return [" ".join(rng.choice(letters) * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_scores_and_exact_sums(spark):
    texts = made(1, 120) + ["The the THE b", None, "", " \t\n", "ä Ä é", "new words only here", "a " * 20_000]
    rows = [(i, t, 1, None) for i, t in enumerate(texts)] + [(None, "a b", None, None), (3, texts[3], None, "s"), (3, texts[3], None, "s")]
    model = compare(spark, rows, block_tokens=300)
    for context in ["a", "bb", "<s>", "ä"]:
        assert abs(sum(model.katz(w, context) for w in [*model.single, "<unknown>"]) - 1) < 1e-9


def test_split_contexts(spark):
    rng = random.Random(2)
    texts = [" ".join(x for _ in range(60) for x in ("the", f"w{rng.randrange(400)}")) for _ in range(60)]
    compare(spark, [(i, t, None, None) for i, t in enumerate(texts)], block_tokens=2_000)


def test_frequent_pairs_only(spark):
    compare(spark, [(i, "same old words", None, None) for i in range(30)] + [(i, "same new words", None, None) for i in range(30, 60) if zlib.crc32(str(i).encode()) % 5 == 1])


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    compare(spark, [(i, "a b", None, None) for i in held])
    assert katz_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_and_discounts():
    for values in ([], [0], [1, 255, 256, 2**40, 0]):
        assert unpacked(packed(np.array(values, dtype=np.int64))).tolist() == values
    assert (discounts(np.array([0, 100, 40, 20, 10, 6, 4, 0]))[1:] < 1).all() and (discounts(np.zeros(8)) == 1).all()
