"""Trailing windows of whole Arrow batches give the rows of the moving frames, over entities cut by batches, with missing values."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from panelspark.operators import alphas as al
from panelspark.operators import rolling as ts
from panelspark.operators.rolled import roll, rolled

KINDS = {"sum": ts.sum_, "mean": ts.mean, "min": ts.min_, "max": ts.max_, "var": ts.var, "std": ts.std, "skew": ts.skew, "median": ts.median}


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(1), []
    for e in range(25):
        for t in range(rng.choice([1, 2, 50, 300])):
            x = None if rng.random() < 0.15 else (1.1 if t // 20 % 3 == 1 else rng.gauss(0, 1))
            rows.append((e or None, dt.date(2020, 1, 1) + dt.timedelta(t), float("nan") if (e, t) == (7, 1) else x, None if rng.random() < 0.1 else rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "entity long, date date, x double, y double").repartition(5)


def same(got, expected, names):
    a = {(r["entity"], r["date"]): r for r in got.collect()}
    b = {(r["entity"], r["date"]): r for r in expected.collect()}
    assert a.keys() == b.keys() and a
    for k, r in a.items():
        for c in names:
            p, q = r[c], b[k][c]
            assert p == q or (p is not None and q is not None and (abs(p - q) < 1e-9 or (p != p and q != q))), (k, c, p, q)


def test_rolled_equals_moving_frames(spark, panel):
    spec = {f"{k}{w}": roll(k, "x", w) for k in KINDS for w in (1, 5, 20)}
    cols = {f"{k}{w}": fn("x", w) for k, fn in KINDS.items() for w in (1, 5, 20)}
    spec |= {"corr": roll("corr", ("x", "y"), 12), "down": roll("drawdown", "y", 9), "lag": roll("delay", "x", 3)}
    cols |= {"corr": ts.corr("x", "y", 12), "down": ts.drawdown("y", 9), "lag": ts.delay("x", 3)}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 70)
    try:
        same(rolled(panel, **spec), panel.withColumns(cols), spec)
    finally:
        spark.conf.set(size, before)


def test_rolled_takes_columns_named_before(panel):
    got = rolled(panel, l=roll("delay", "x", 1), d=roll("less", ("x", "l")), q=roll("ratio", ("d", "y")), m=roll("mean", "d", 5))
    d = panel.withColumn("l", ts.delay("x", 1)).withColumn("d", ts.delta("x", 1))
    same(got, d.withColumn("m", ts.mean("d", 5)), ["l", "d", "m"])


def test_long_correlations_have_no_aggregate_for_each_row(panel):
    """An adaptive signal's efficacy is taken for whole batches; a moving frame of 60 rows cost 35 microseconds a row."""
    d = al.efficacy(panel, "y", e=("x", 60))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    same(d, panel.withColumn("_l", ts.delay("x", 1)).withColumn("e", ts.corr("_l", "y", 60)), ["e"])
