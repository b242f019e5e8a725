"""Pfair mixing against the definition of its schedule."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from skyframe.llm.mixing import in_mixed_order, mix, period, tempered

SCHEMA = "doc_id long, text string, source string, mix_slot string"


@pytest.mark.parametrize("seed", range(25))
def test_every_prefix_is_within_one_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.choice([1, 1, 2, 3, rng.randrange(1, 200)]) for i in range(rng.randrange(1, 30))}
    total, got = sum(weights.values()), Counter()
    rows = period(weights)
    assert [t for _, _, t in rows] == list(range(total))
    for name, block, slot in rows:
        assert block == got[name] and block * total // weights[name] <= slot < -(-(block + 1) * total // weights[name])
        got[name] += 1
        assert all(abs(got[s] - Fraction((slot + 1) * w, total)) < 1 for s, w in weights.items())
    assert got == weights


def test_weights():
    weights = tempered({"a": 900, "b": 100, "c": 1}, 0.5, 100)
    assert sum(weights.values()) == 100 and weights["a"] > weights["b"] > weights["c"] >= 1
    assert tempered({}) == {} and tempered({"a": 5}) == {"a": 1000} and set(tempered({str(i): 1 for i in range(1500)}).values()) == {1}
    with pytest.raises(ValueError):
        period({"a": 0})


def test_rows_follow_the_schedule(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["a", "a", "a", "b", "c"]), "x") for i in range(500)] + [(1, "t1", "a", "x")] * 3 + [(None, None, None, None)] * 2
    weights = {"a": 5, "b": 3, "c": 2}
    got = mix(spark.createDataFrame(rows, SCHEMA).repartition(5), weights, block_rows=4)
    assert got.columns == ["doc_id", "text", "source", "mix_block", "mix_slot", "mix_position"]
    got = got.collect()
    assert len(got) == len(rows) and len({r["mix_position"] for r in got}) == len(rows)
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], r[1], r[2]) for r in rows)
    weights[""] = 1
    slots = {(s, n): t for s, n, t in period(weights)}
    for r in got:
        s, j = r["source"] or "", r["mix_block"] - 1
        assert r["mix_slot"] == j // weights[s] * 11 + slots[s, j % weights[s]] and r["mix_position"] // 4 == r["mix_slot"]
    assert all(n == 4 for (s, b), n in Counter((r["source"], r["mix_block"]) for r in got).items() if b < max(x["mix_block"] for x in got if x["source"] == s))
    again = {(r[0], r["mix_position"]) for r in mix(spark.createDataFrame(rows, SCHEMA).repartition(2), {"a": 5, "b": 3, "c": 2}, block_rows=4).collect()}
    assert again == {(r[0], r["mix_position"]) for r in got}


def test_order_of_files_and_empty_table(spark):
    rows = [(i, "t", "ab"[i % 3 == 0], None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    ordered = in_mixed_order(docs, {"a": 1, "b": 1}, block_rows=1)
    assert ordered.columns == docs.columns
    assert [r["source"] for r in ordered.collect()][:40] == ["a", "b"] * 20
    assert mix(docs.limit(0)).count() == 0 and in_mixed_order(docs.limit(0)).count() == 0
