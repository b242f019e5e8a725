"""Spelling variants against comparing all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np

from skyframe.llm.spelling import count_words, group_variants, near_pairs

SCHEMA = "doc_id long, text string, word string, n string, root int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, slip=31):
    seen = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_variants(words, ratio=10):
    out, forms = [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return sorted(out)


def check(spark, words, **options):
    rows = [(w, n, "x", 1) for w, n in words.items()]
    got = group_variants(spark.createDataFrame(rows, "word string, n long, form string, near int").repartition(3), **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants(words, **options)


def test_random_words_of_few_letters(spark):
    rng = np.random.default_rng(3)
    words = {}
    for _ in range(700):
        size = int(rng.integers(1, 9))
        words["".join(rng.choice(list("abé"), size))] = int(10 ** rng.uniform(0, 4))
    check(spark, words)
    check(spark, words, ratio=2)


def test_chains_ties_and_long_words(spark):
    long = "abcdefghij" * 300
    words = {"strasse": 1000, "strase": 90, "strassen": 90, "straase": 8, "kkkkkkk": 5, "kkkkkkkk": 60, "kkkkkkkkk": 60, long: 2, long[:1500] + long[1501:]: 40,
             long[1:]: 40, long[:-1]: 3, long + "z": 2, "x" * 900: 3, "x" * 901: 50, "solitary": 7}
    check(spark, words)


def test_words_of_one_beginning(spark):
    words = {"internationa" + a + b: 1 + (i * j) % 50 for i, a in enumerate("abcdefghijklm") for j, b in enumerate(["", *"nopqrstuvw"])}
    check(spark, words)


def test_counting_and_slips(spark):
    rng = np.random.default_rng(5)
    stock = ["".join(rng.choice(list("aeiourstßé×"), int(rng.integers(3, 12)))) for _ in range(60)]
    rows = [(int(i), " ".join(rng.choice(stock, 80)) + "\n" + stock[i % 60].upper() + "-" + stock[(i * 7) % 60] + "1", "w", None, 3) for i in range(60)]
    rows += [rows[5], rows[5], (None, "Straßenbahn Straßenbahn STRAßENBAHN", None, None, None), (90, None, None, None, None), (91, "", None, None, None),
             (92, "abcdefg" * 4000 + " " + "abcdefg" * 4000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for slip in (31, None):
        got = {r["word"]: r["n"] for r in count_words(docs, slip=slip).collect()}
        assert got == plain_words(rows, slip)
    words = plain_words(rows)
    got = group_variants(count_words(docs, slip=31))
    assert sorted(map(tuple, got.collect())) == plain_variants(words)


def test_query_over_the_whole_table(spark, tmp_path):
    from skyframe.llm.queries import QUERIES
    rng = np.random.default_rng(9)
    stock = ["".join(rng.choice(list("aeiour"), int(rng.integers(6, 9)))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(stock, 60, p=np.arange(1, 151) ** 2.0 / np.sum(np.arange(1, 151) ** 2.0))), None, None, None) for i in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_spelling_trie"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert sorted(map(tuple, got.collect())) == plain_variants(plain_words(rows))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert count_words(docs, slip=31).count() == 0
    assert group_variants(count_words(docs)).count() == 0
    assert near_pairs(spark.createDataFrame([(None, 3)], "word string, n long").filter("word is not null")).count() == 0
