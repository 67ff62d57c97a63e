"""Whitening and hard negatives against brute force."""

import numpy as np
import pytest

from laudospark.llm import hard_negatives, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, n int, deviation string, key int"


def frame(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 5, "x", 7) for r in rows], VECTORS)


def exact(vectors):
    """Sums, deviations and covariance by Python's integers."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(d)] for i in range(d)])
    return x, sums, [sum(c * c for c in r) for r in off], cov


@pytest.mark.parametrize("case", ["random", "identity", "pairs", "split", "low_rank", "graded", "one", "two"])
def test_leading_components(case):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    a = {
        "random": (lambda y: y @ y.T)(rng.standard_normal((24, 40))),
        "identity": np.eye(24),
        "pairs": q @ np.diag(np.repeat(np.arange(12, 0, -1.0), 2)) @ q.T,
        "split": np.kron(np.eye(6), np.array([[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 1], [0, 0, 1, 3.0]])),
        "low_rank": q[:, :5] @ np.diag([5, 4, 3, 3, 1.0]) @ q[:, :5].T,
        "graded": q @ np.diag(10.0 ** -np.arange(24)) @ q.T,
        "one": np.array([[3.0]]),
        "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    }[case]
    a = (a + a.T) / 2
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    values, vectors = whitening.leading_components(a, 16)
    assert len(values) == {"low_rank": 5, "one": 1, "two": 2}.get(case, len(values)) and len(values) <= 16
    assert len(values) >= {"graded": 12}.get(case, min(16, len(values)))
    assert np.abs(values - want[: len(values)]).max() < 1e-13 * want[0] * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * want[0] * len(a)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((150, 6)) * [3, 2, 2, 1, 0.5, 0.0] + 0.3).astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(good)]
    rows += [rows[5], rows[5], (None, rows[7][1], None)]  # repeated rows and a null identifier count
    bad = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [1.0, float("-inf"), 0.0, 0.0, 0.0, 0.0], 1), (904, [1.0], 1), (905, [], 1)]
    _, sums, deviations, cov = exact([r[1] for r in rows])
    out, model, error = whitening.whiten(frame(spark, rows + bad).repartition(7))
    got = out.collect()
    assert model.n == len(rows) and model.sums.tolist() == sums
    assert sorted(int(r.deviation) for r in got) == sorted(deviations)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert len(model.values) == 5  # the sixth dimension does not vary
    assert np.allclose(model.values, values[:5], rtol=1e-12)
    assert np.abs(cov @ model.vectors - model.vectors * model.values).max() < 1e-10
    w = np.array([r.whitened for r in got])
    assert np.abs(w.T @ w / len(w) - np.eye(5)).max() < 1e-10 and error < 1e-10
    again, other, _ = whitening.whiten(frame(spark, bad + rows[::-1]).repartition(2))
    assert np.array_equal(other.vectors, model.vectors)
    assert np.allclose(sorted(tuple(r.whitened) for r in again.collect()), sorted(tuple(r.whitened) for r in got), atol=1e-9)


def test_whitening_of_next_to_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        out, model, error = whitening.whiten(frame(spark, rows))
        assert len(model.values) == 0 and error == 0.0 and all(r.whitened == [] and r.deviation == 0 for r in out.collect())
    out, model, _ = whitening.whiten(frame(spark, [(1, [0.5, 1.0], 1)] * 3))
    assert model.n == 3 and [(r.key, int(r.deviation), r.whitened) for r in out.collect()] == [(1, 0, [])] * 3


def test_whitening_is_exact_where_longs_are_too_small():
    model = whitening.Whitening(64.0, 0, 10**10, np.array([3, -4]), np.array([0, 0]), 1.0, np.ones(0), np.zeros((2, 0)))
    v = np.array([[100.0, -7.5], [0.0, 0.25]])
    want = [sum((10**10 * int(64 * c) - s) ** 2 for c, s in zip(r, (3, -4))) for r in v]
    assert [int(x) for x in model.deviation(v).to_pylist()] == want
    with pytest.raises(OverflowError):
        model.centred(np.array([[1e300, 0.0]]))


def test_whitening_query(spark):
    rows = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = rows.toPandas()
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    _, _, deviations, cov = exact(source["embedding"].tolist())
    assert len(got) == 32 * len(source) and got["n"].eq(len(source)).all()
    first = got[got["component"] == 1].set_index("vec_id")
    assert first.loc[source["vec_id"], "deviation"].tolist() == deviations
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    shares = got.groupby("component")["explained"].first().sort_index().to_numpy()
    assert np.allclose(shares, values[:32] / values.sum(), rtol=1e-10)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9 and got["identity_error"].max() < 1e-9


def hard_by_force(rows, every=50, k=5, m=3):
    """Integers and sorted lists; rows are (id, vector, label)."""
    taken = sorted({(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v), l) for i, v, l in rows})
    out = []
    for i, a, l in taken:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, h) for j, b, h in taken if j != i)
        for p, j, _ in [s for s in scored if s[2] == l][:k]:
            inside = [(n, o) for n, o, h in scored if h != l and 50 * -p <= 100 * -n <= 95 * -p][:m]
            out += [(i, j, r, o, -p, -n) for r, (n, o) in enumerate(inside, 1)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hilbert_positions_are_a_path():
    for n, bits in ((1, 4), (2, 4), (3, 3), (5, 2), (6, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        at = hard_negatives.hilbert_positions(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_all_scores():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-50, 50, (20, 7)).astype(float), rng.integers(-50, 50, (30, 7)).astype(float)
    least, most = hard_negatives.bounds(a, x.min(axis=0)[None, :], x.max(axis=0)[None, :])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()


@pytest.mark.parametrize("block_bytes,group", [(64, 4), (1 << 16, 256)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block_bytes, group):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "SLICE", 6)
    monkeypatch.setattr(hard_negatives, "COLUMN", 2)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 5))
    rows = [(i, (centres[i % 4] + 0.4 * rng.standard_normal(5)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    same = rows[50][1]
    rows += [(1000 + i, same, i % 3) for i in range(120)]  # one vector holds many rows, of several labels
    rows += [rows[3], rows[100], rows[100]]  # repeated rows, one of them an anchor
    rows += [(2000, [0.0] * 5, 1), (2050, [1.0] * 5, 77)]  # an anchor without direction, an anchor alone with its label
    bad = [(None, same, 1), (3000, same, None), (3050, None, 1), (3100, [None] * 5, 1), (3150, [float("nan")] * 5, 1), (3200, [1.0, 2.0], 1), (3250, [float("inf")] * 5, 1)]
    want = hard_by_force(rows)
    got = mined(hard_negatives.hard_negatives(frame(spark, rows + bad).repartition(5), lambda i: i % 50 == 0))
    assert len(want) > 60 and got == want


def test_hard_negatives_of_next_to_nothing(spark):
    for rows in ([], [(0, None, 1)], [(0, [], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert mined(hard_negatives.hard_negatives(frame(spark, rows), lambda i: i % 50 == 0)) == []
    with pytest.raises(OverflowError):
        hard_negatives.hard_negatives(frame(spark, [(0, [1e30], 1)]), lambda i: i % 50 == 0)


def test_hard_negatives_query(spark):
    got = queries.QUERIES["op12_hard_negatives"](spark, SF)
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in got.dtypes) == hard_negatives.RESULT
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = hard_by_force([(r.vec_id, r.embedding, r.label if r.vec_id % 7 else (r.label + 1) % 10) for r in source])
    assert len(want) == 10 * 5 * 3 and mined(got) == want
