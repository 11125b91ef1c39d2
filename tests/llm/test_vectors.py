"""Whitening and hard negatives against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from casebook.llm import hard_negatives, whitening
from casebook.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x int, v string").repartition(3).write.parquet(
        f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "singular", "zero", "one"])
def test_eigenvectors_to_double_precision(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {"spread": np.geomspace(1e3, 1e-3, 40),
              "clustered": np.concatenate([5 + np.arange(15) * 1e-9, [2, 2 + 1e-12, 2 + 1e-5], np.linspace(1, 1.5, 22)]),
              "equal": np.repeat([3.0, 1.0], 20), "singular": np.concatenate([np.linspace(1, 2, 10), np.zeros(30)]),
              "zero": np.zeros(40), "one": np.ones(40)}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1]).max() <= 1e-13 * max(1, values.max())
    assert np.abs(a @ x - x * found).max() <= 2e-14 * max(1, values.max())


def test_refinement_mends_float32():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 64))
    a = np.cov(x.T)
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    off = np.abs(single.T @ a @ single - np.diag(np.diag(single.T @ a @ single))).max()
    _, fine = whitening.eigen(a)
    assert off > 1e-8 > 1e-14 > np.abs(fine.T @ a @ fine - np.diag(np.diag(fine.T @ a @ fine))).max()


def test_whitening_equals_numpy(spark, folder, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(6)], 1, i, "a") for i in range(300)]
    rows += [(7, rows[7][1], 2, 0, None)] * 3 + [(400, None, 1, 1, ""), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, ""),
             (402, [NAN] * 6, 1, 1, ""), (403, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], 1, 1, ""), (None, [0.0] * 6, None, 1, ""),
             (404, [1.5, -2.0], 1, 1, ""), (405, [], 1, 1, "")]
    found = QUERIES["op11_whitening"](spark, _write(spark, tmp_path, rows)).toPandas()
    good = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    padded = np.array([np.float32(r[1] + [0.0] * (6 - len(r[1]))) for r in good], dtype=np.float64)
    x = np.floor(64 * padded) + 1_000_000
    n = len(x)
    covariance = np.cov((x - 1_000_000).T, bias=True)
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(covariance))
    white = (x - x.mean(0)) @ vectors / np.sqrt(values)
    assert len(found) == 6 * n and set(found["n"]) == {n}
    exact = {}
    total = [int(s) for s in x.sum(0)]
    for r, line, w in zip(good, x, white):
        exact.setdefault(r[0], (sum((n * int(v) - s) ** 2 for v, s in zip(line, total)), w))
    for r in found.itertuples():
        deviation, w = exact[None if np.isnan(r.vec_id) else int(r.vec_id)]
        assert r.deviation == deviation and abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    assert found["identity_error"].max() < 1e-10
    signs = {(r.component, np.sign(r.whitened) == np.sign(exact[int(r.vec_id)][1][r.component - 1]))
             for r in found.itertuples() if not np.isnan(r.vec_id) and abs(r.whitened) > 1e-6}
    assert len(signs) == 6  # one sign for all rows of a component


@pytest.mark.parametrize("rows, expected", [([], 0), ([(1, None, 1, 1, "")], 0), ([(1, [1.0, 2.0], 1, 1, "")], 2),
                                            ([(i, [1.0, 2.0, 1e30], 1, 1, "") for i in range(5)], 15)])
def test_whitening_of_tables_without_variance(spark, tmp_path, rows, expected):
    found = QUERIES["op11_whitening"](spark, _write(spark, tmp_path, rows)).collect()
    assert len(found) == expected
    assert all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None for r in found)


def test_whiten_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], i, "t") for i in range(30)],
                               "row int, v array<double>, whitened int, w string")
    out = whitening.whiten(df, whitening.fit(df, "v"), "v")
    assert out.columns == ["row", "v", "w", "whitened"] and out.count() == 30
    x = np.array([r["whitened"] for r in out.collect()])
    assert np.abs(np.cov(x.T, bias=True) - np.eye(2)).max() < 1e-12


def _brute(rows, anchors, k=5):
    out = []
    for a, al, ax in anchors:
        score = [(sum(int(p) * int(q) for p, q in zip(ax, x)), i, lab) for i, lab, x in rows if i != a]
        best = sorted(((s, i) for s, i, lab in score if lab == al), key=lambda t: (-t[0], t[1]))[:k]
        for ps, p in best:
            fit = sorted(((s, i) for s, i, lab in score if lab != al and 80 * ps <= 100 * s <= 100 * ps),
                         key=lambda t: (-t[0], t[1]))[:k]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("piece, block", [(8192, 16 << 20), (13, 3 * 64)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, piece, block):
    monkeypatch.setattr(hard_negatives, "PIECE", piece)
    monkeypatch.setattr(hard_negatives, "SMALLEST", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rng = random.Random(8)
    centres = [[rng.gauss(0, 40) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        size = rng.choice([1, 1, 0.3, 4])
        rows.append((i, rng.choice("abc"), [int(size * (v + rng.gauss(0, rng.choice([2, 12])))) for v in c]))
    rows += [(1000 + i, "abcd"[i % 4], rows[0][2]) for i in range(60)]  # copies of one vector
    rows += [(2000, "a", [0] * 8), (2001, "b", [0] * 8), (2002, "b", [3] * 3), (2003, "z", [5] * 8)]
    rows += [rows[5], rows[5]]
    anchors = [r for r in rows if r[0] % 20 == 0 or r[0] > 1995]
    shape = "vec_id long, label string, embedding array<long>"
    df = spark.createDataFrame([*rows, (None, "a", [1] * 8), (3000, None, [1] * 8), (3001, "a", None), (3002, "a", [None] * 8)],
                               shape).repartition(5)
    asked = spark.createDataFrame([*anchors, (3003, "a", None)], shape)
    found = sorted(tuple(r) for r in hard_negatives.mine(df, asked).collect())
    assert found == _brute(rows, anchors)


def test_hard_negatives_with_large_numbers_and_none(spark):
    shape = "vec_id long, label int, embedding array<double>"
    big = float(2 ** 40)
    rows = [(0, 1, [big, 3.0]), (1, 1, [big, 5.0]), (2, 2, [big, 4.0]), (3, 2, [big, 6.0]), (4, 3, [NAN, 0.0]), (5, 2, [1.0, INF])]
    df = spark.createDataFrame(rows, shape)
    found = [tuple(r) for r in hard_negatives.mine(df, df.where("vec_id = 0")).collect()]
    top = 2 ** 63 - 1
    assert found == [(0, 1, 1, 2, top, top), (0, 1, 2, 3, top, top)]
    small = spark.createDataFrame([(0, 1, [2.0 ** 29, 1.0]), (1, 1, [2.0 ** 29, 5.0]), (2, 2, [2.0 ** 29, 4.0])], shape)
    assert [tuple(r) for r in hard_negatives.mine(small, small.where("vec_id = 0")).collect()] == [
        (0, 1, 1, 2, 2 ** 58 + 5, 2 ** 58 + 4)]
    assert hard_negatives.mine(df, df.limit(0)).count() == hard_negatives.mine(df.limit(0), df).count() == 0


def test_pruning_leaves_out_rows_and_no_result():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 6)) * 50 * rng.choice([0.2, 1, 3], size=(3000, 1)))
    index, full, seen = hard_negatives.Index(x), 0, 0
    for q in x[:40]:
        scores = (x @ q).astype(np.int64)
        bound = int(np.sort(scores)[-20])
        found = {}
        for at, s in index.above(q, lambda: bound):
            found |= dict(zip(at.tolist(), s.tolist(), strict=True))
        full, seen = full + len(x), seen + len(found)
        assert {i for i in range(len(x)) if scores[i] >= bound} <= set(found)
        assert all(scores[i] == s for i, s in found.items())
    assert seen < 0.35 * full
