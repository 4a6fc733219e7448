"""Whitening against plain numpy and exact integers."""

import math

import numpy as np
import pytest

from ragloom.llm import whitening
from ragloom.llm.queries import op13_whitening


def integers_by_force(rows):
    """Ids and integer vectors of the rows that remain."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in kept]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    return [(i, x) for i, x in kept if len(x) == usual]


def holds(found, rows, k=16):
    """Every column against the contract; components up to sign."""
    kept = integers_by_force(rows)
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, len(sums))
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert sum(map(len, by_id.values())) == k * len(kept)
    z = {}
    for i, x in kept:
        own = sorted((r for r in by_id[i]), key=lambda r: r["component"])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert all(r["n"] == n and r["deviation"] == deviation for r in own if len(own) == k)
        z[tuple(x)] = [r["whitened"] for r in own[:: len(own) // k]] if len(own) > k else [r["whitened"] for r in own]
    one = [r for r in next(iter(by_id.values()))][:k]
    explained = {r["component"]: r["explained"] for r in found}
    assert [explained[c + 1] for c in range(k)] == pytest.approx((e[:k] / np.trace(cov)).tolist(), rel=1e-9)
    assert one[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in found}) == 1
    values = np.array([z[x] for x in fit])
    own = values - values.mean(0)
    assert np.abs(own.T @ own / n - np.eye(k)).max() < 1e-9
    expected = y @ v[:, :k] / np.sqrt(e[:k])
    signs = np.sign((values * expected).sum(0))
    assert np.abs(values - expected * signs).max() < 1e-6


def made(seed=1, n=300, d=20):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + rng.normal(size=d)
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]


SCHEMA = "vec_id long, embedding array<double>, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def test_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 17)
    monkeypatch.setattr(whitening, "FOLD", 2)
    rows = made()
    odd = [(1000, None), (1001, [1.0] * 19 + [None]), (1002, [float("nan")] + [0.0] * 19), (1003, [float("inf")] * 20), (1004, [1.0, 2.0]), (1005, [])]
    copies = [(2000 + i, rows[0][1]) for i in range(150)] + [(3000, [c + 1e-9 for c in rows[1][1]])]
    found = whitening.whiten(frame(spark, rows + odd + copies).repartition(9))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert not {r["vec_id"] for r in found} & {i for i, _ in odd}
    holds(found, rows + copies)


def test_repeated_rows_and_null_ids(spark):
    rows = made(2, 80, 5)
    found = whitening.whiten(frame(spark, [*rows, rows[3], rows[3], (None, rows[4][1])])).collect()
    assert sum(r["vec_id"] == 3 for r in found) == 15 and sum(r["vec_id"] is None for r in found) == 5
    assert {r["n"] for r in found} == {len({tuple(x) for _, x in integers_by_force(rows)})}
    value = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert all(value[None, c] == value[4, c] for c in range(1, 6))


def test_fewer_vectors_than_dimensions(spark):
    rows = made(3, 4, 12)
    found = whitening.whiten(frame(spark, rows)).collect()
    assert sorted({r["component"] for r in found}) == [1, 2, 3]
    assert max(r["identity_error"] for r in found) < 1e-9


def test_tables_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_wild_entries_stay_exact(spark):
    rows = [(0, [1e9, 0.5]), (1, [-1e9, 0.25]), (2, [3.0, 1e300]), (3, [5.0, 7.0])]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    kept = [[math.floor(max(-(2.0**52), min(2.0**52, 64 * c))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*kept)]
    for i, x in enumerate(kept):
        exact = sum((4 * a - s) ** 2 for a, s in zip(x, sums))
        assert found[i] == (exact if exact < 1 << 63 else None)


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(5)
    good = rng.normal(size=(8, 8)) + 8 * np.eye(8)
    scales = 10.0 ** -np.arange(8) ** 1.5
    vectors, values = whitening.jacobi(np.linalg.qr(good * scales, mode="r"))
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    smallest = 1 / np.linalg.norm(np.linalg.inv(good) / scales[:, None], 2)
    assert values[-1] == pytest.approx(smallest, rel=1e-10)
    assert np.all(np.diff(values) <= 0)


def test_rounds_meet_every_pair_once():
    for m in (1, 2, 5, 8):
        pairs = [tuple(sorted(p)) for a, b in whitening.rounds(m) for p in zip(a.tolist(), b.tolist())]
        assert sorted(pairs) == [(i, k) for i in range(m) for k in range(i + 1, m)]


def test_query_holds_on_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    holds(op13_whitening(spark, folder).collect(), rows)
