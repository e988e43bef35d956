"""Whitening: against a full eigendecomposition of the covariance, and odd rows."""

import numpy as np
import pytest

from tablewright.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, key int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


def run(spark, table, components=4, block=8):
    x = whitening.whole(table)
    model = whitening.fit(x, components, block)
    return model, whitening.whiten(x, model)


def brute(vectors, components=4):
    x = np.unique(np.floor(256 * np.array(vectors, np.float32).astype(float)), axis=0)
    n, mean = len(x), x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / n
    e, v = np.linalg.eigh(cov)
    return n, x.sum(axis=0), mean, e[::-1][:components], v[:, ::-1][:, :components], np.trace(cov)


def agree(spark, rows, components=4, block=8):
    model, out = run(spark, frame(spark, rows), components, block)
    n, sums, mean, e, v, trace = brute([r[1] for r in rows], components)
    assert model.n == n and model.sums == [int(s) for s in sums] and model.identity_error < 1e-9
    assert np.allclose(model.variances, e[:len(model.variances)], rtol=1e-11) and np.isclose(model.trace, trace, rtol=1e-12)
    assert np.abs(np.abs(np.sum(model.components * v, axis=0)) - 1).max() < 1e-12
    got = {}
    for r in out.collect():
        got.setdefault(r["key"], {})[r["component"]] = r
    sign = np.sign(np.sum(model.components * v, axis=0))
    for i, vec in rows:
        x = np.floor(256 * np.array(vec, np.float32).astype(float))
        assert [int(got[i][c]["deviation"]) for c in got[i]] == [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)))] * components
        assert np.allclose([got[i][c + 1]["whitened"] for c in range(components)], (x - mean) @ v / np.sqrt(e) * sign, atol=1e-9)
        assert np.allclose([got[i][c + 1]["explained"] for c in range(components)], e / trace)
    return model


@pytest.mark.parametrize("block", [1, 4, 8])
def test_against_eigenvectors(spark, block):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 5
    agree(spark, [(i, [float(c) for c in r]) for i, r in enumerate(data)], block=max(block, 1))


def test_close_and_repeated_eigenvalues(spark):
    rows = [(2 * k + s, [float((1 if s else -1) * 8 * (j == k)) for j in range(6)]) for k in range(6) for s in (0, 1)]
    model, out = run(spark, frame(spark, rows))
    assert np.allclose(model.variances, model.variances[0]) and len(model.variances) == 4 and model.identity_error < 1e-9
    assert out.count() == 48


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    agree(spark, [(r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] is not None])


def test_rank_below_the_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0, 0.0, 0.0]) for i in range(20)] + [(99, [0.0] * 5)]
    model, out = run(spark, frame(spark, rows))
    assert len(model.variances) == 2 and model.identity_error < 1e-9 and out.count() == 42


def test_odd_rows(spark):
    ok = [(i, [float(i % 7), float(i * i % 11), 1.5 * (i % 3)]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]),
           (None, [1.0, 2.0, 3.0]), (0, [0.0, 0.0, 0.0]), (106, [-0.0, -0.001, 0.001])]
    model, out = run(spark, frame(spark, ok + odd))
    used = [v for _, v in ok] + [v for i, v in odd if i in (None, 0, 106)]
    assert model.n == brute(used)[0] and len(model.variances) == 3
    assert out.count() == 3 * len(used) and {r["key"] for r in out.collect()} == {*range(40), 106, None}


def test_no_rows_and_no_spread(spark):
    assert run(spark, frame(spark, [(1, [1.0])]).limit(0))[1].collect() == []
    model, out = run(spark, frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert model.n == 1 and out.collect() == []


def test_huge_entries_stay_exact(spark):
    rows = [(1, [3e30, 1.0]), (2, [-3e30, 2.0]), (3, [0.0, 1e15])]
    model, out = run(spark, frame(spark, rows))
    top = (1 << 63) - 1
    x = [[top, 256], [-(1 << 63), 512], [0, int(np.floor(256 * float(np.float32(1e15))))]]
    assert model.sums == [sum(c) for c in zip(*x)]
    want = [sum((3 * v - s) ** 2 for v, s in zip(r, model.sums)) for r in x]
    got = {r["key"]: r["deviation"] for r in out.collect()}
    assert [None if w >= 10 ** 38 else w for w in want] == [None if got[k] is None else int(got[k]) for k in (1, 2, 3)]
