"""The pipeline's stages against plain versions of what each decides, on a small planted corpus."""

import os
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_copies import plain_kept  # noqa: E402

from skyframe.llm.mixing import period, tempered  # noqa: E402
from skyframe.llm.pieces import decode, vocabulary  # noqa: E402
from skyframe.llm.pii import find_spans, masked  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(1), str(tmp_path_factory.mktemp("corpus"))
    words = [a + b for a in "bdfglmnprst" for b in ["a", "eno", "irul", "otam"]]
    docs, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30, 90))) + " vile scum" * 2 * toxic
        docs.append((i, text + (f" mail a{i}@b.org" if i % 9 == 1 else ""), "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(700 + i, " ".join(["edited" if k == 9 else w for k, w in enumerate(docs[i][1].split())]), "en", "s0", 0) for i in range(2, 60, 3)]
    docs += [(500 + i, docs[i][1], "en", "s1", 0) for i in range(1, 40, 2)] + [(900, None, None, None, None), (901, "", "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, docs


def test_stages_take_effect(spark, folder):
    root, docs = folder
    toxic = {d[0] for d in docs if d[1] and "vile scum" in d[1]}
    left = [d for d in docs if d[0] not in toxic]
    kept = plain_kept(left)
    assert {d[0] for d in left if 700 <= d[0] < 900} - kept and len(left) - len(kept) > 25
    want = {d[0]: masked(d[1], find_spans(d[1])) for d in left if d[0] in kept}
    got = corpus_pipeline.run(spark, root)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_position", "pieces", "lossless"]
    rows = got.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["lossless"] for r in rows)
    assert all(decode(r["pieces"], vocabulary()) == r["text"] for r in rows if r["text"])
    # the result carries the mix: the blocks of 8 positions follow the period of the sources that are left
    counts = Counter(r["source"] or "" for r in rows)
    slots = [s for s, _, _ in period(tempered(counts))]
    placed = {r["mix_position"]: r["source"] or "" for r in rows}
    assert len(placed) == len(rows) and all(source == slots[at // 8 % len(slots)] for at, source in placed.items())


def test_columns_and_order_between_stages(spark, folder):
    root, docs = folder
    frame = spark.read.parquet(f"{root}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "personal data", "mixing", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, root).columns == frame.columns
        assert stage(spark, frame.limit(0), root).count() == 0
    order = [r["source"] or "" for r in corpus_pipeline.mixing(spark, frame, root).collect()]
    counts = {s: order.count(s) for s in set(order)}
    slots = [s for s, _, _ in period(tempered(counts))]
    blocks = [order[i] for i in range(0, 64, 8)]
    assert len(order) == len(docs) and blocks == slots[: len(blocks)]


def test_given_tables(spark):
    path = "/root/testdata/sf0.001"
    if os.path.isdir(path):
        got = corpus_pipeline.run(spark, path)
        assert 0 < got.count() < 200 and got.filter("not lossless").count() == 0
