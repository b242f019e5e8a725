"""Quality cascade against counting in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm.quality import STOP_WORDS, base_rules, cascade_order, draw, judge, measured, order_by_rate, rejected_by, standard_rules

SCHEMA = "doc_id long, text string, kept string, n_words string"


def plain(doc_id, text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    places = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)}
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    same = len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(places) > 20 * n
    letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    bad = (chars < 2 * n or chars > 20 * n or 5 * symbols > n or 2 * same > len(lines) or 10 * sum(not any(c.isalpha() for c in w) for w in words) > 3 * n
           or 2 * capitals > letters or 2 * sum(c in "!?" for c in text) > n or n >= 50 and len({w.lower() for w in words} & set(STOP_WORDS)) < 2)
    return doc_id, n, chars, symbols, same, len(places), failed, not failed and not bad


def rows():
    rng = np.random.default_rng(2)
    stock = ["the", "und", "que", "Émile", "naïve", "a", "tree", "🙂", "x|y", "##", "STOP", "12", "really!", "longer-than-most"]
    out = [(i, " ".join(rng.choice(stock[:int(rng.integers(2, 15))], int(rng.integers(0, 60)))) + str(rng.choice(["", "\n", " \n\n", "\r\n"])), "k", None)
           for i in range(250)]
    for i in range(60):
        line = " ".join(f"word{j}" for j in range(i % 13))
        out.append((300 + i, "\n".join(["the start of it"] + [line] * (i % 4) + [f"and line {k} of text" for k in range(i % 7)]), None, "x"))
    clean = " ".join(f"{w} the sentence{i}" for i, w in enumerate(["of", "and", "to"] * 20))
    out += [(500, clean, None, None), (501, clean.upper(), None, None), (502, None, None, None), (503, "", None, None), (None, clean, None, None), (500, clean, None, None),
            (504, " \t\n\x0b\x0c\r ", None, None), (505, "a b c d e a b c d e", None, None), (506, "w " * 3000, None, None),
            (507, " ".join(f"t{i}" for i in range(30_000)) + " of the", None, None), (508, "one two three four " * 3, None, None)]
    return out


def test_against_plain_counts(spark):
    data = rows()
    got = judge(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain(i, t) for i, t, *_ in data), key=key)
    assert {r["kept"] for r in got.collect()} == {True, False}


def test_no_python_in_the_plan(spark):
    plan = judge(spark.createDataFrame(rows()[:20], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


def test_order_never_changes_what_is_kept(spark):
    data, rules = measured(spark.createDataFrame(rows(), SCHEMA)).cache(), standard_rules() | base_rules()
    steps = cascade_order(draw(data, 100), rules)
    assert 50 < draw(data, 100).count() <= 200 and draw(data, 1000).count() == data.count()
    assert sorted(s.name for s in steps) == sorted(rules) and all(s.seconds > 0 and 0 <= s.rejected <= 1 for s in steps)
    orders = [[s.name for s in steps], sorted(rules), sorted(rules, reverse=True)]
    counts = {data.filter(rejected_by(rules, o).isNull()).agg(F.count("*"), F.sum(F.xxhash64("text") % 1000)).first() for o in orders}
    assert len(counts) == 1
    with pytest.raises(ValueError):
        rejected_by(rules, ["symbols"])


def test_later_rules_are_not_asked(spark):
    rules = {"early": F.col("id") % 2 == 0, "late": F.raise_error(F.lit("asked")).isNotNull()}
    assert spark.range(0, 20, 2).filter(rejected_by(rules, ["early", "late"]) == "early").count() == 10


def test_order_is_by_rejections_left_per_cost():
    # b is cheap and rejects half; c overlaps with b, so that a comes before it
    outcomes = [({"b", "c"}, 50), ({"a"}, 10), (set(), 40)]
    assert [s.name for s in order_by_rate({"a": 1.0, "b": 0.5, "c": 0.6, "d": 0.1}, outcomes)] == ["b", "a", "d", "c"]
    assert [s.name for s in order_by_rate({"z": 1.0, "y": 1.0}, [])] == ["y", "z"]
    assert order_by_rate({"a": 2.0}, outcomes)[0].rejected == 0.1


def test_empty(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0
