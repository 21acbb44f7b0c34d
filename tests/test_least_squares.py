"""Systems of least squares and correlations: any number of regimes, ranks, large levels, many columns."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import features, quality, regimes, sampling
from panelspark.operators.crosssection import CrossSection

DAY = dt.date(2020, 1, 1)


def test_pivoted_inverses():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 4, 7):
        full = [(x := rng.standard_normal((20, k))).T @ x for _ in range(5)]
        spread = np.diag(10.0 ** np.arange(0, 3 * k, 3)[:k])
        full.append(spread @ full[0] @ spread)  # columns of very different size are as good as any
        inverse, rank = regimes.pivoted_inverses(np.array(full))
        assert rank.tolist() == [k] * len(full)
        for a, b in zip(full, inverse):
            np.testing.assert_allclose(b, np.linalg.inv(a), rtol=1e-6, atol=1e-9 * np.abs(np.linalg.inv(a)).max())
    x = rng.standard_normal((30, 4))
    x[:, 2] = 0.3 * x[:, 0] - 2 * x[:, 1]
    twin, zero = x.copy(), x.copy()
    twin[:, 3], zero[:, 3] = x[:, 1], 0.0
    inverse, rank = regimes.pivoted_inverses(np.array([x.T @ x, twin.T @ twin, zero.T @ zero, np.zeros((4, 4))]))
    assert rank.tolist() == [3, 2, 2, 0] and np.isnan(inverse).all()


def weights_table(spark, k, n, seed, spoil=None):
    rng = np.random.default_rng(seed)
    w = rng.dirichlet(np.ones(k), n)
    if spoil is not None:
        w = spoil(w)
    names = [f"w{i}" for i in range(k)]
    ic = w @ np.linspace(0.03, -0.04, k) + 0.01 * np.convolve(rng.standard_normal(n + 4), np.ones(5) / 5, "valid")
    rows = [("a", DAY + dt.timedelta(days=i), float(ic[i]), *map(float, w[i])) for i in range(n)]
    return rows, "series string, date date, ic double, " + ", ".join(f"{c} double" for c in names), names, w, ic


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("lags,kernel", [(0, "uniform"), (4, "uniform"), (20, "bartlett")])
def test_regression_equals_the_matrix_sandwich(spark, k, lags, kernel):
    rows, schema, names, w, ic = weights_table(spark, k, 300, k)
    rows += [("a", dt.date(2030, 1, 1), None, *[1.0] * k), ("a", dt.date(2030, 1, 2), 0.1, *[float("nan")] * k)]
    got = {r.term: r for r in regimes.regime_regression(spark.createDataFrame(rows, schema).repartition(4), "ic", lags, kernel, states=names).collect()}
    inverse = np.linalg.inv(w.T @ w)
    coef = inverse @ w.T @ ic
    z = w @ inverse * (ic - w @ coef)[:, None]
    z = np.column_stack([z, z[:, -1] - z[:, 0]])
    estimates = [*coef, coef[-1] - coef[0]]
    for i, term in enumerate([*names, "contrast"]):
        c = z[:, i] - z[:, i].mean()
        lrv = c @ c + sum(2 * (1 if kernel == "uniform" else 1 - j / (lags + 1)) * c[j:] @ c[:-j] for j in range(1, lags + 1))
        if k == 1 and term == "contrast":
            continue
        assert got[term].n == 300 and got[term].estimate == pytest.approx(estimates[i], rel=1e-9)
        if lrv > 0:
            assert got[term].se == pytest.approx(math.sqrt(300 * lrv / 299), rel=1e-8) and got[term].kernel == kernel


def test_regression_recovers_exact_coefficients_and_knows_its_rank(spark):
    def never(w):
        w[:, 1] = 0.0  # no date in the second regime
        return w

    def twins(w):
        w[:, 2] = 0.5 * w[:, 0]
        return w

    table = []
    for name, spoil, n in (("fine", None, 200), ("never", never, 200), ("twins", twins, 200), ("short", None, 3), (None, None, 50)):
        rows, schema, names, w, _ = weights_table(spark, 3, n, 7, spoil)
        exact = w @ np.array([0.02, 0.0, -0.04])
        table += [(name, d, float(exact[i]), *x) for i, (_, d, _, *x) in enumerate(rows)]
    got = regimes.regime_regression(spark.createDataFrame(table, schema), "ic", 4, "uniform", states=names).collect()
    by = {(r.series, r.term): r for r in got}
    assert len(got) == 5 * 4
    for series in ("fine", None):
        assert [by[series, t].estimate for t in (*names, "contrast")] == pytest.approx([0.02, 0.0, -0.04, -0.06], abs=1e-12)
        assert all(by[series, t].se == pytest.approx(0.0, abs=1e-12) for t in names)
    for series, n in (("never", 200), ("twins", 200), ("short", 3)):
        assert all((by[series, t].estimate, by[series, t].se, by[series, t].t, by[series, t].kernel, by[series, t].n) == (None, None, None, "none", n) for t in (*names, "contrast"))


def test_residuals_at_a_level_of_1e8(spark):
    """Prices near 1e8 with variation of a few units, against a centred computation; both plans."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(4):
        x = rng.standard_normal((60, 2))
        y = 3 * x[:, 0] - 2 * x[:, 1] + rng.standard_normal(60)
        level = np.array([1e8, 1e8 + g, 2e8])
        data = np.column_stack([y, x]) + level
        c = data - data.mean(axis=0)
        res = c[:, 0] - c[:, 1:] @ np.linalg.lstsq(c[:, 1:], c[:, 0], rcond=None)[0]
        for i in range(60):
            rows.append((DAY + dt.timedelta(days=g), i, *map(float, data[i])))
            want[DAY + dt.timedelta(days=g), i] = res[i]
    rows += [(DAY, 100, None, 1e8, 2e8), (DAY, 101, 1e8, None, 2e8)]
    rows += [(dt.date(2021, 1, 1), i, 1e8 + i, 1e8 + 0.1, float(i)) for i in range(20)]  # a factor that never varies
    rows += [(dt.date(2022, 1, 1), i, 1e8 + i % 3, 1e8 + i, 7.0 - 2 * (1e8 + i)) for i in range(20)]  # the second follows from the first
    d = spark.createDataFrame(rows, "date date, entity int, y double, a double, b double")
    for xs in (CrossSection(("date",), 100), CrossSection(("date",), None)):
        got = {(r.date, r.entity): r.res for r in xs.factor_neutral(d, "y", ["a", "b"], "res").collect()}
        assert len(got) == len(rows)
        for key, v in want.items():
            assert got[key] == pytest.approx(v, abs=1e-6)
        assert all(v is None for key, v in got.items() if key not in want)


def test_ridge_at_a_level_of_1e8(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 2))
    w = rng.uniform(0.5, 2, 200)
    y = x @ [2.0, -1.0] + 5 + rng.standard_normal(200)
    shifted = x + [1e8, -3e8]
    rows = [(float(a), float(b), float(c), float(v)) for (a, b), c, v in zip(shifted, y, w)] + [(1.0, None, 1.0, 1.0)]
    got = {r.term: r.coef for r in quality.ridge(spark.createDataFrame(rows, "a double, b double, y double, w double"), "y", ["a", "b"], "w", 5.0).collect()}
    mx, my = np.average(shifted, axis=0, weights=w), np.average(y, weights=w)
    c = shifted - mx
    slope = np.linalg.solve((c * w[:, None]).T @ c + 5 * np.eye(2), (c * w[:, None]).T @ (y - my))
    assert [got["a"], got["b"]] == pytest.approx(slope.tolist(), rel=1e-6)
    assert got["intercept"] == pytest.approx(my - mx @ slope, rel=1e-6)


def test_coskewness_at_a_level(spark):
    rng = random.Random(2)
    rows = [("a", DAY + dt.timedelta(days=i), 1e6 + rng.gauss(0, 1) if i % 9 else None, 1e6 + rng.gauss(0, 1) ** 2) for i in range(60)]
    d = spark.createDataFrame(rows, "entity string, date date, ret double, mkt double")
    got = {r.date: r.o for r in features.coskew(d, "o").collect()}
    for i, (_, day, _, _) in enumerate(rows):
        pairs = np.array([(r[2], r[3]) for r in rows[max(0, i - 20):i + 1] if r[2] is not None])
        if len(pairs) < features.need(21):
            assert got[day] is None
            continue
        cx, cy = (pairs - pairs.mean(axis=0)).T
        assert got[day] == pytest.approx((cx * cy * cy).mean() / (cx.std() * cy.var()), rel=1e-6)


def test_correlations_of_many_columns(spark):
    """Blocks that don't divide the columns, several batches, missing cells, columns without variation, large levels."""
    rng = np.random.default_rng(5)
    n, p = 700, 53
    x = rng.standard_normal((n, p)) + 0.5 * rng.standard_normal((n, 1)) + np.where(np.arange(p) % 5 == 0, 1e7, 0)
    x[rng.random((n, p)) < 0.1] = np.nan
    x[:, 7] = 3.25
    x[:, 8] = np.nan
    x[:, 9] = np.where(np.arange(n) < 3, x[:, 9], np.nan)
    names = [f"c.{i}" for i in range(p)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    try:
        wide = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(3)
        got = {(r.a, r.b): r["corr"] for r in sampling.correlation_pairs(wide, names, block=16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {(names[i], names[j]) for i in range(p) for j in range(i, p)}
    for i in range(p):
        for j in range(i, p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) < 2 or a.std() == 0 or b.std() == 0:
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-8)


def test_correlations_don_t_join_rows_with_rows(spark):
    wide = spark.range(10).select(*[F.rand(i).alias(f"c{i}") for i in range(4)])
    assert "Join" not in sampling.correlation_pairs(wide, wide.columns)._jdf.queryExecution().toString()


def test_one_row_aggregates_instead_of_whole_table_windows(spark):
    from panelspark.operators import infer

    rows = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.0), ("y", 2.0), ("z", None), ("a", 2.0)], "tag string, v double")
    for mode, best in (("max", "a"), ("min", "a")):  # three means of 2: the first name wins; no value can't
        d = infer.candidate_winner(rows, "tag", "v", mode)
        assert {r.tag: (r.winner, r.n_candidates) for r in d.collect()} == {t: (t == best, 4) for t in "xyza"}
        assert "Window" not in d._jdf.queryExecution().toString()
    d = infer.selection_table(rows, "tag", "v", "v")
    assert {r.tag: r.within_one_se for r in d.collect()} == {"x": True, "y": True, "a": True, "z": None}
    assert "Window" not in d._jdf.queryExecution().toString()
