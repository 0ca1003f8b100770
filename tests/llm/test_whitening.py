import math
from fractions import Fraction

import numpy as np
import pytest

from tracewell.llm import whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def plain_version(rows):
    """{(vec_id, component): ...} of (vec_id, vector), with exact fractions up to the covariance."""
    left = [(i, [math.floor(64 * c) + 1000000 for c in map(float, v)]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in left})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    y = [[Fraction(n * x[j] - sums[j], n) for j in range(dim)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:16]
    values, vectors = values[order], vectors[:, order]
    out = []
    for i, x in left:
        c = np.array([float(Fraction(n * x[j] - sums[j], n)) for j in range(dim)])
        out.append((i, sum((n * x[j] - sums[j]) ** 2 for j in range(dim)), (c @ vectors) / np.sqrt(values)))
    return n, values / np.trace(v), out


def same(got, want):
    n, explained, rows = want
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert sum(len(x) for c in by.values() for x in c.values()) == len(rows) * len(explained)
    sign = None
    for i, deviation, w in rows:
        mine = np.array([by[i][k + 1][0].whitened for k in range(len(w))])
        sign = np.sign(mine * w) if sign is None else sign
        assert np.allclose(mine * sign, w, rtol=1e-8, atol=1e-9), i
        for k in range(len(w)):
            for r in by[i][k + 1]:
                assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained[k]) < 1e-10 and r.identity_error < 1e-8


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(whitening.op13(spark, SF).collect(), plain_version(rows))


def test_odd_vectors_are_dropped_and_repeated_ones_count_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = [(i, [float(c) for c in np.float32(rng.normal(0, 1 + i % 3, 5))], i) for i in range(40)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 5, 1), (103, [1.0, float("inf"), 0.0, 0.0, 0.0], 1), (104, [], 1)]
    rows = base + odd + [(200 + i, base[0][1], 1) for i in range(30)] + [(None, base[1][1], 1), (3, base[3][1], 1)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13(spark, str(tmp_path)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and {r.n for r in got} == {40}
    same([r for r in got if r.vec_id is not None], plain_version([r[:2] for r in rows if r[0] is not None]))
    assert sum(r.vec_id is None for r in got) == 5 and not {r.vec_id for r in got} & {100, 101, 102, 103, 104}


def test_dimensions_without_variance_and_other_lengths(spark):
    rows = [(i, [float(i % 5), 7.0, float(i % 3), 7.0], i) for i in range(30)] + [(90, [1.0, 2.0], 1)]
    kept = whitening.remaining(spark.createDataFrame(rows, KIND))
    model = whitening.fit(kept)
    assert model.dim == 4 and model.n == 15 and model.identity_error < 1e-12
    got = whitening.project(kept, model).collect()
    assert len(got) == 30 and all(r.whitened[0] is not None and r.whitened[1] is not None and r.whitened[2:] == [None, None] for r in got)
    assert sorted(got[0].row.asDict()) == ["label", "vec_id"]
    one = whitening.remaining(spark.createDataFrame([(1, [1.0, 2.0], 1)], KIND))
    model = whitening.fit(one)
    assert model.n == 1 and [(r.deviation, r.whitened) for r in whitening.project(one, model).collect()] == [(0, [None, None])]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


@pytest.mark.parametrize("big", [1e3, 1e9, 1e30])
def test_large_numbers_stay_exact_or_null(big):
    x = np.array([[0, 5], [whitening.LARGEST, 7], [int(min(big, 1e9)), -3]], np.int64)
    total = [int(s) for s in x.sum(axis=0)]
    model = whitening.Whitening(3, np.array([s // 3 for s in total]), np.array([s % 3 for s in total]), np.ones(1), np.ones((2, 1)), 1.0)
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    assert model.deviations(x) == [w if w < 1 << 63 else None for w in want]
    small = np.array([[1, 2], [3, 9]], np.int64)
    exact = whitening.Whitening(2, np.array([2, 5]), np.array([0, 1]), np.ones(1), np.ones((2, 1)), 1.0)
    assert exact.deviations(small) == [4 + 49, 4 + 49]


def test_blocks_of_few_rows_give_the_same(spark, monkeypatch):
    rows = whitening.remaining(spark.read.parquet(f"{SF}/embeddings.parquet"))
    a = whitening.fit(rows)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 64 * 3)
    b = whitening.fit(rows.repartition(7))
    assert a.n == b.n and (a.whole == b.whole).all() and (a.rest == b.rest).all() and np.allclose(a.values, b.values, rtol=1e-12)
