"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from skyframe.llm.itq import codes_of, fit_codes, fit_model, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, code string"


def plain(rows):
    """(vec_id, n_links, component_id, kept) by comparing all rows."""
    good = [i for i, (k, v, l, *_) in enumerate(rows) if k is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    unit = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in good}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    for x, i in enumerate(good):
        for j in good[:x]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    least = {}
    for i in good:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return [(r[0], links[i], least[root(i)] if i in unit else r[0], None if r[0] is None else (least[root(i)] if i in unit else r[0]) == r[0])
            for i, r in enumerate(rows)]


def made(rng, n, dim, noise):
    centres = rng.standard_normal((n, dim))
    return [(centres[i % n] + noise * rng.standard_normal(dim)).astype(np.float32).tolist() for i in range(3 * n)]


def test_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = made(rng, 60, 24, 0.09) + made(rng, 20, 7, 0.05)
    rows = [(i * 13 % 1009, v, i % 3, None, "c") for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[0], 0, None, "c") for i in range(30)] + [(2000, vectors[0], 0, "x", None), (2001, vectors[1], 1, None, None)]
    rows += [(3000, None, 1, None, "c"), (3001, [], 1, None, "c"), (3002, [0.0] * 24, 1, None, "c"), (3003, [None] + [1.0] * 23, 1, None, "c"),
             (3004, [float("nan")] * 24, 1, None, "c"), (3005, [float("inf")] * 24, 0, None, "c"), (3006, vectors[0], None, None, "c"), (None, vectors[0], 0, None, "c"),
             (3007, [-x if x == 0 else x for x in vectors[0]], 0, None, "c")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_recall_on_borderline_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((700, 64))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    partner = 0.981 * base + np.sqrt(1 - 0.981**2) * other
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, partner]))]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    found = got.filter("n_links > 0").count() / 1400
    assert found >= 0.97, found


@pytest.mark.parametrize("common", [0.0, 0.7, 0.9])
def test_recall_where_vectors_point_the_same_way(spark, common):
    """Vectors of mean cosine `common`, each with a partner at 0.981: links found over all links."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 64)) / 8 * np.sqrt(1 - common)
    base[:, 0] += np.sqrt(common)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((900, 64))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    rows = np.concatenate([base, 0.981 * base + np.sqrt(1 - 0.981**2) * away]).astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum() - len(rows)
    got = near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int"))
    found = sum(r["n_links"] for r in got.collect())
    assert links >= 1800 and 0.95 * links <= found <= links, (found, links)


def test_the_scheme_follows_from_measured_recall():
    rng = np.random.default_rng(5)
    schemes = []
    for common in (0.0, 0.8, 0.95):
        x = rng.standard_normal((3000, 32)) / np.sqrt(32) * np.sqrt(1 - common)
        x[:, 0] += np.sqrt(common)
        model = fit_model(x / np.linalg.norm(x, axis=1, keepdims=True))
        assert model.recall >= 0.985
        schemes.append((model.tables, len(model.projections)))
    assert schemes == sorted(schemes) and schemes[0] == (4, 1)
    same = fit_model(np.ones((5, 8)) / np.sqrt(8))
    assert 0 <= same.recall <= 1


def test_codes_are_balanced_and_close():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((2000, 48)) @ np.diag(np.linspace(3, 0.5, 48))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    mean, projection = fit_codes(rows)
    bits = np.unpackbits(codes_of(rows, mean, projection).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    assert projection.shape == (48, 64) and (abs(bits.mean(axis=0) - 0.5) < 0.15).all()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).collect()[0][:] == (1, 0, 1, True)


def test_what_is_asked_and_vectors_are_not_broadcast(spark, tmp_path):
    """Spark takes them for as small as the file of codes; the driver would hold every substring that is asked for."""
    from skyframe.llm.itq import near_pairs

    rng = np.random.default_rng(6)
    rows = [(i, "x", 16, v) for i, v in enumerate(made(rng, 40, 16, 0.05))]
    spark.createDataFrame(rows, "class_id long, label string, dim int, vector array<double>").write.parquet(f"{tmp_path}/classes")
    pairs = near_pairs(spark.read.parquet(f"{tmp_path}/classes"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan
    unit = np.array([r[3] for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if unit[i] @ unit[j] >= 0.98}
    assert near and {(r["a"], r["b"]) for r in pairs.collect()} == near
