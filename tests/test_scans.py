"""Recursions over dates: filters with their state, quarters that come late, expanding ranks, exponential means."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import pit, regimes
from panelspark.operators import rolling as ts
from panelspark.streaming import jobs

ARGS = ((0.0, 0.1, -0.2), (0.04, 0.5, 0.1), ((0.9, 0.06, 0.04), (0.2, 0.7, 0.1), (0.05, 0.15, 0.8)), (0.5, 0.3, 0.2))
STATES = ("a", "b", "c")


def walk(values, horizon=1):
    """One series, date by date: each prior is the posterior from ``horizon`` dates back, that many steps ahead."""
    mean, var, chain, first = (np.asarray(v, float) for v in ARGS)
    step, past, out = np.linalg.matrix_power(chain, horizon), [], []
    for v in values:
        prior = past[-horizon] @ step if len(past) >= horizon else first
        logs = -0.5 * (v - mean) ** 2 / var - 0.5 * np.log(2 * np.pi * var)
        joint = prior * np.exp(logs - logs.max())
        past.append(joint / joint.sum())
        out.append((*past[-1], np.log(joint.sum()) + logs.max()))
    return out


def long_series(n=1500, seed=1, name="s", start=dt.date(2015, 11, 20)):
    rng = random.Random(seed)
    return [(name, start + dt.timedelta(days=i + i // 5 * 2), rng.gauss(0, 0.4)) for i in range(n)]


@pytest.mark.parametrize("horizon", [1, 5])
def test_filter_by_blocks_equals_the_walk(spark, horizon):
    rows = long_series() + long_series(3, 2, "short") + long_series(700, 3, None) + [("s", dt.date(2011, 1, 1), None)]
    # values that are all but impossible under every state: the products are rescaled
    rows = [(s, d, 40.0 if v is not None and i % 97 == 0 else v) for i, (s, d, v) in enumerate(rows)]
    d = spark.createDataFrame(rows, "series string, date date, value double").repartition(5)
    got = {}
    for r in regimes.regime_filter(d, *ARGS, states=STATES, horizon=horizon).collect():
        got.setdefault(r.series, []).append((r.date, r.a, r.b, r.c, r.log_c))
    assert set(got) == {"s", "short", None}
    for name, found in got.items():
        own = sorted((day, v) for s, day, v in rows if s == name and v is not None)
        found.sort()
        assert [f[0] for f in found] == [day for day, _ in own]
        np.testing.assert_allclose([f[1:] for f in found], walk([v for _, v in own], horizon), rtol=1e-8, atol=1e-12)


def test_filter_uses_no_target_that_is_not_yet_known(spark):
    """With a target known five dates later, moving one target leaves the next four priors as they are."""
    rows = long_series(12)
    moved = [(s, d, v + 5.0 if i == 6 else v) for i, (s, d, v) in enumerate(rows)]
    run = lambda r: {x.date: (x.a, x.log_c) for x in regimes.regime_filter(
        spark.createDataFrame(r, "series string, date date, value double"), *ARGS, states=STATES, horizon=5).collect()}
    before, after = run(rows), run(moved)
    same = [before[d] == after[d] for _, d, _ in rows]
    assert same == [True] * 6 + [False] + [True] * 4 + [False]


@pytest.mark.parametrize("horizon", [1, 5])
def test_online_filter_goes_on_from_its_state(spark, tmp_path, horizon):
    """Three runs, cut inside the history of five; a repeated date changes nothing and is reported."""
    rows = long_series(40) + long_series(3, 4, "u")
    df = spark.createDataFrame(rows, "series string, date date, value double")
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    days = [d for _, d, _ in rows[:40]]
    with jobs.rocksdb_state(spark):
        for lo, hi in ((days[0], days[2]), (days[2], days[20]), (days[21], days[39])):
            df.where(F.col("date").between(F.lit(lo), F.lit(hi))).write.mode("append").parquet(src)
            stream = spark.readStream.schema(df.schema).parquet(src)
            jobs.online_regime_filter(stream, *ARGS, out, ck, horizon)
    found = spark.read.parquet(out).collect()
    assert [(r.series, r.date, r.f0) for r in sorted(found, key=str) if r.late] == [(n, days[2], None) for n in ("s", "u")]
    want = {(r.series, r.date): r for r in regimes.regime_filter(df, *ARGS, states=STATES, horizon=horizon).collect()}
    got = {(r.series, r.date): r for r in found if not r.late}
    assert set(got) == set(want)
    for key, r in got.items():
        np.testing.assert_allclose([r.f0, r.f1, r.f2, r.log_c], [want[key].a, want[key].b, want[key].c, want[key].log_c], rtol=1e-9)


def test_state_store_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(RuntimeError, match="RocksDB"):
            jobs.online_regime_filter(spark.readStream.format("rate").load(), *ARGS, "x", "y")
        with pytest.raises(ZeroDivisionError), jobs.rocksdb_state(spark):
            assert spark.conf.get(name).endswith("RocksDBStateStoreProvider")
            1 / 0
        assert spark.conf.get(name).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(name, before)


ITEMS = "saleq cogsq ibq atq actq cheq lctq dlcq dlttq ltq ceqq seqq pstkq txditcq ivaoq ivstq mibq oancfq".split()


def quarters(spark, n_companies=4, n=30):
    rng = random.Random(6)
    rows = []
    for g in range(n_companies):
        for i in range(n):
            if rng.random() < 0.1:
                continue  # a quarter that is never reported
            late = rng.choice((0, 0, 0, 200, 500))
            avail = dt.date(2012, 1, 15) + dt.timedelta(days=91 * i + late)
            rows.append((g, 8000 + i, avail, *[None if rng.random() < 0.05 else round(rng.uniform(1, 9), 2) for _ in ITEMS]))
    schema = "gvkey int, fq_index int, avail date, " + ", ".join(f"{c} double" for c in ITEMS)
    return spark.createDataFrame(rows, schema), rows


def test_late_quarters_as_state_equal_the_batch(spark, tmp_path):
    """Any split into batches gives the values of all quarters at once; repeats change nothing; a batch writes only what it touches."""
    q, rows = quarters(spark)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    order = random.Random(1).sample(range(len(rows)), len(rows))
    written = 0
    with jobs.rocksdb_state(spark):
        for part in (order[:60], order[60:61], order[61:] + order[:5]):
            spark.createDataFrame([rows[i] for i in part], q.schema).write.mode("append").parquet(src)
            jobs.late_quarters(spark.readStream.schema(q.schema).parquet(src), ITEMS, out, ck)
            before, written = written, spark.read.parquet(out).count()
            if len(part) == 1:
                g, _, avail, *_ = rows[part[0]]
                later = {rows[i][2] for i in order[:61] if rows[i][0] == g and rows[i][2] >= avail}
                assert written - before == len(later)
    got = {(r.gvkey, r.event): r for r in jobs.latest_values(spark, out).collect()}
    want = pit.fundamental_values(pit.known_quarters(q, ITEMS)).collect()
    assert len(got) == len(want)
    for r in want:
        mine = got[r.gvkey, r.event].asDict()
        for c, v in r.asDict().items():
            assert mine[c] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), (c, r.gvkey, r.event)


def test_a_late_quarter_joins_on_its_own_date(spark, tmp_path):
    empty = [None] * len(ITEMS)
    q, _ = quarters(spark, 1, 1)
    rows = [(1, 1, dt.date(2020, 1, 10), *empty), (1, 2, dt.date(2020, 4, 10), *empty), (1, 3, dt.date(2020, 3, 1), *empty), (1, 4, None, *empty), (None, 5, dt.date(2020, 1, 1), *empty)]
    spark.createDataFrame(rows, q.schema).write.parquet(str(tmp_path / "in"))
    with jobs.rocksdb_state(spark):
        jobs.late_quarters(spark.readStream.schema(q.schema).parquet(str(tmp_path / "in")), ITEMS, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r.event, r.asof_avail) for r in jobs.latest_values(spark, str(tmp_path / "out")).collect())
    assert got == [(dt.date(2020, 1, 10),) * 2, (dt.date(2020, 3, 1),) * 2, (dt.date(2020, 4, 10), dt.date(2020, 3, 1))]


def test_earlier_smaller():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 64, 301):
        for values in (rng.integers(0, 9, n).astype(float), rng.standard_normal(n), np.arange(n) * 1.0, -np.arange(n) * 1.0):
            assert regimes.earlier_smaller(values).tolist() == [int((values[:i] < values[i]).sum()) for i in range(n)]


def test_earlier_smaller_grows_with_the_dates():
    def took(n):
        values = np.random.default_rng(0).standard_normal(n)
        start = time.process_time()
        regimes.earlier_smaller(values)
        return time.process_time() - start

    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.01)


def test_causal_assignment_equals_expanding_quantiles(spark):
    rows = [(s, d, v if i % 50 else None) for i, (s, d, v) in enumerate(long_series(300) + long_series(120, 5, "u") + [("few", dt.date(2020, 1, 1), 0.1)])]
    rows += [("flat", dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.5) for i in range(40)]
    got = {(r.series, r.date): r.regime for r in regimes.causal_vol_assignment(
        spark.createDataFrame(rows, "series string, date date, value double").repartition(3), 6, 0.5, 3, 20).collect()}
    assert len(got) == len(rows) and set(got.values()) == {-1, 0, 1, 2}
    for name in {r[0] for r in rows}:
        own = sorted((d, v) for s, d, v in rows if s == name)
        vols = []
        for i, (d, _) in enumerate(own):
            window = [v for _, v in own[max(0, i - 5):i + 1]]
            vols.append(float(np.std(window, ddof=1)) if len(window) == 6 and None not in window else None)
            so_far = [v for v in vols if v is not None]
            if vols[-1] is None or len(so_far) < 20:
                want = -1
            else:
                want = sum(vols[-1] > np.quantile(so_far, c) + 1e-15 for c in (0.5, 0.75))
            assert got[name, d] == want


def test_exponential_mean_over_years(spark):
    rng = random.Random(3)
    rows = [(e, dt.date(2013, 3, 1) + dt.timedelta(days=step * i), rng.gauss(0, 1) if rng.random() < 0.8 else None)
            for e, step, n in (("day", 1, 900), ("week", 7, 300), ("gap", 500, 9), (None, 3, 200)) for i in range(n)]
    d = spark.createDataFrame(rows, "entity string, date date, x double").withColumn("other", F.lit("kept")).repartition(4)
    for span, need in ((1, 2), (2, 1), (10, 5), (250, 3)):
        keep = 1 - 2 / (span + 1)
        got = {(r.entity, r.date): r.m for r in ts.ewm_mean(d, "x", span, "m", need).collect()}
        assert len(got) == len(rows)
        for name in {r[0] for r in rows}:
            num = den = seen = 0
            for _, day, v in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
                num, den = num * keep, den * keep
                if v is not None:
                    num, den, seen = num + v, den + 1, seen + 1
                want = num / den if seen >= need and den > 0 else None
                assert got[name, day] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-12))


def test_exponential_mean_stays_native(spark):
    d = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "entity string, date date, x double")
    plan = ts.ewm_mean(d, "x", 5, "m")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    crowd = spark.range(600).selectExpr("'a' AS entity", "DATE'2020-01-01' AS date", "1.0D AS x")
    with pytest.raises(Exception, match="more than 520 rows"):
        ts.ewm_mean(crowd, "x", 5, "m").collect()
