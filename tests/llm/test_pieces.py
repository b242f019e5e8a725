"""Sampled segmentations: exact round trips, the distribution against all segmentations, and repeatability."""

import random
from collections import Counter

import pytest

from skyframe.llm.pieces import MODEL, decode, decoded, encode, row_key, sample, vocabulary

sentencepiece = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, pieces string, lossless int"


def round_trip(texts):
    words = vocabulary()
    ids, offsets = sample(texts, [row_key(i) for i in range(len(texts))], words)
    return [decode(ids[a:b].tolist(), words) for a, b in zip(offsets, offsets[1:])]


def test_round_trips():
    rng = random.Random(1)
    alphabet = list("abc the and ing ,.\n\t  ▁é漢\U0001F600\x00ß−<0x41>") + ["the ", "tion", "   "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    texts += ["", " ", "\n", "▁", "<0x0A>", "<s>", "\x00", "x" * 20_000, " " * 5_000, "漢\U0001F600" * 3_000, "﻿a", "a\r\n"]
    assert round_trip(texts) == texts


def test_distribution_matches_all_segmentations():
    words = vocabulary()
    source = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {source.id_to_piece(i).replace("▁", " "): i for i in range(259, source.get_piece_size())}

    def ways(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                for tail, weight in ways(rest[n:]):
                    yield (ids[rest[:n]], *tail), weight / (ids[rest[:n]] + 1)

    for text in ("thinking", "a tin"):
        want = dict(ways(" " + text))
        whole, draws = sum(want.values()), 20_000
        got_ids, offsets = sample([text] * draws, [row_key(i) for i in range(draws)], words)
        got = Counter(tuple(got_ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
        assert set(got) <= set(want) and len(want) > 10
        for way, weight in want.items():
            share = weight / whole
            assert abs(got[way] / draws - share) < 5 * (share / draws) ** 0.5 + 1e-3, (way, share)


def test_same_row_same_pieces_in_any_partitioning(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["sampling", "lattice", "éclair", "a"]) for _ in range(40)), "p", 1) for i in range(60)]
    rows += [rows[0], (None, "without key", None, None), (100, None, None, None), (101, "", "x", 0), (102, "q" * 20_000, "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = {(r[0], tuple(r[1] or ())) for r in encode(docs.coalesce(1)).select("doc_id", "pieces").collect()}
    many = encode(docs.repartition(7))
    assert many.columns == ["doc_id", "pieces", "lossless"] and many.count() == len(rows) and many.filter("not lossless").count() == 0
    assert {(r[0], tuple(r[1] or ())) for r in many.select("doc_id", "pieces").collect()} == one
    other = {(r[0], tuple(r[1] or ())) for r in encode(docs, seed=7).select("doc_id", "pieces").collect()}
    assert other != one
    kept = encode(docs, keep=True)
    assert kept.columns == ["doc_id", "text", "pieces", "lossless"]
    back = decoded(kept, out_col="again").collect()
    assert all(r["text"] == r["again"] for r in back) and any(r["pieces"] is None for r in back) and any(r["pieces"] == [] for r in back)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], SCHEMA), keep=True).count() == 0


@pytest.mark.parametrize("sharpness", [0.0, 0.2, 3.0])
def test_long_units_at_any_sharpness(sharpness):
    words = vocabulary(sharpness=sharpness)
    for text in ("ab" * 3000, "xyz" * 2500 + " end", "a" * 5000):
        ids, offsets = sample([text], [row_key(1)], words)
        assert decode(ids.tolist(), words) == text and offsets.tolist() == [0, len(ids)]


def test_lattices_in_blocks_take_bounded_memory():
    """Blocks of units give the lattices of all units at once, and sorting their edges takes little beside the result."""
    import tracemalloc

    import numpy as np

    words, rng = vocabulary(), random.Random(3)
    units = list({" " + "".join(rng.choice("etaoinshrdlu漢") for _ in range(rng.randrange(1, 12))) for _ in range(40_000)})
    whole = words.lattice(units)
    tracemalloc.start()
    blocks = words.lattices(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(blocks[0], whole[0], rtol=0, atol=1e-8) and all((a == b).all() for a, b in zip(blocks[1:], whole[1:]))
    assert peak < 4 * sum(a.nbytes for a in whole)
    for a, b in zip(words.lattices(units[:50], 7), words.lattice(units[:50])):
        assert np.allclose(a, b, rtol=0, atol=1e-8)
