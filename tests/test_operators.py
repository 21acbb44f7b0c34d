"""Hand-computed values, refusals and invariants."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import elementwise as e
from panelspark.operators import evaluate as ev
from panelspark.operators import infer, pit, portfolio, regimes, sampling, splits
from panelspark.operators import rolling as ts
from panelspark.operators import tradingcal as tc


def panel(spark, values, entity=1, start=dt.date(2020, 1, 6)):
    rows = [(start + dt.timedelta(days=7 * i), entity, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, entity int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("entity", "date").collect()]


def test_signed_buckets(spark):
    d = spark.createDataFrame([(v,) for v in (0.0, 0.003, -0.003, 0.012, -0.05, 0.0003)], "x double")
    assert [r[0] for r in d.select(e.signed_bucket("x", (0.005, 0.01, 0.02))).collect()] == [0, 0, 0, 2, -3, 0]


def test_normal_functions(spark):
    zs = [-8.0, -3.0, -1.0, 0.0, 0.5, 2.5, 7.5]
    d = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, r in zip(zs, d.select(e.norm_cdf("z")).collect(), strict=True):
        assert r[0] == pytest.approx(NormalDist().cdf(z), abs=1e-14)
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    d = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, r in zip(ps, d.select(e.norm_ppf("p")).collect(), strict=True):
        assert r[0] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_fiscal_period_end(spark):
    d = spark.createDataFrame([(2020, 4, 12), (2020, 1, 6), (2020, 4, 5), (2019, 1, 1)], "y int, q int, m int")
    got = [r[0] for r in d.select(e.period_end("y", "q", "m")).collect()]
    assert got == [dt.date(2020, 12, 31), dt.date(2019, 9, 30), dt.date(2021, 5, 31), dt.date(2019, 4, 30)]


def test_rolling_matches_pandas(spark):
    x = [1.0, None, 3.0, 3.0, 7.0, 2.0, None, 4.0, 9.0, 1.0]
    s = pd.Series(x, dtype=float)
    d = panel(spark, x)
    r = s.rolling(4, min_periods=2)
    expected = {"mean": r.mean(), "std": r.std(), "median": r.median(), "rank": r.rank()}
    got = {"mean": ts.mean("x", 4), "std": ts.std("x", 4), "median": ts.median("x", 4), "rank": ts.rank("x", 4)}
    for k, c in got.items():
        for a, b in zip(column(d.withColumn("o", c), "o"), expected[k], strict=True):
            assert (a is None and math.isnan(b)) or a == pytest.approx(b)
    sk = s.rolling(4, min_periods=3).skew()
    for a, b in zip(column(d.withColumn("o", ts.skew("x", 4, 3)), "o"), sk, strict=True):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b)
    ew = s.ewm(span=3, min_periods=2).mean()
    for a, b in zip(column(ts.ewm_mean(d, "x", 3, "o", 2), "o"), ew, strict=True):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b)


def test_drawdown_and_argmax(spark):
    d = panel(spark, [0.1, -0.2, 0.05, 0.3])
    got = column(d.withColumn("o", ts.drawdown("x", 3)), "o")
    assert got[:2] == [None, None]
    assert got[2] == pytest.approx(math.exp(-0.15) - 1) and got[3] == pytest.approx(0.0)
    assert column(panel(spark, [1, 5, 5, 2]).withColumn("pos", F.row_number().over(ts._w(None))).withColumn(
        "o", ts.argmax("x", 3)), "o") == [0, 0, 0, 1]


def test_volume_z_ignores_a_split(spark):
    before, after = [100.0, 120.0, 90.0, 110.0], [200.0, 240.0, 180.0, 260.0]
    d = panel(spark, before + after).withColumn("f", F.when(F.col("date") < "2020-02-03", 2.0).otherwise(1.0))
    plain = panel(spark, [2 * v for v in before] + after).withColumn("f", F.lit(1.0))
    a, b = (column(p.withColumn("o", ts.volume_z("x", "f", 5, 3)), "o") for p in (d, plain))
    assert a[2:] == pytest.approx(b[2:])


def series(spark, values, name="s"):
    rows = [(name, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date date, ic double")


def test_long_run_variance(spark):
    x = [0.1, 0.3, -0.2, 0.4, 0.0, 0.2]
    m = sum(x) / 6
    c = [v - m for v in x]
    g0 = sum(v * v for v in c) / 5
    g1 = sum(a * b for a, b in zip(c, c[1:])) / 5
    r = ev.long_run_variance(series(spark, x), "ic", 0).first()
    assert r["lrv"] == pytest.approx(g0)
    r = ev.long_run_variance(series(spark, x), "ic", 1, "bartlett").first()
    assert r["lrv"] == pytest.approx(g0 + g1) and r["kernel"] == "bartlett"
    # the uniform estimate of an alternating series is negative and falls back
    r = ev.long_run_variance(series(spark, [1, -1, 1, -1, 1, -1]), "ic", 1, "uniform").first()
    assert r["kernel"] == "bartlett" and r["lrv"] > 0


def test_turnover_and_legs(spark):
    rows = [(dt.date(2020, 1, d), n, float((n * 7 + d * 3) % 5), float(n)) for d in (1, 2, 3) for n in range(5)]
    d = spark.createDataFrame(rows, "date date, entity int, p double, y double")
    b = portfolio.long_short_book(d, "p", "y", 5, bound=100).orderBy("date").collect()
    assert b[0]["turnover"] == pytest.approx(1.0)  # entering a two-sided book
    assert all(r["gross"] == pytest.approx(r["long"] + r["short"]) for r in b)
    st = portfolio.long_short_book(d, "p", "y", 5, 1, "staggered", bound=100).orderBy("date").collect()
    assert [r["turnover"] for r in st] == pytest.approx([r["turnover"] for r in b])


def test_multiple_testing_by_hand(spark):
    d = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "fam string, id int, p double")
    h = [r["adjusted"] for r in infer.holm(d, "p", ("fam",), ["id"]).orderBy("id").collect()]
    assert h == pytest.approx([0.03, 0.06, 0.06, 0.02])
    b = [r["adjusted"] for r in infer.benjamini_hochberg(d, "p", ("fam",), ["id"]).orderBy("id").collect()]
    assert b == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_regime_filter_and_weights(spark):
    s = series(spark, [0.1, -0.5, 0.9, 0.0, 0.05]).withColumnRenamed("ic", "value")
    args = ((0.0, 0.0), (0.04, 0.5), ((0.9, 0.1), (0.2, 0.8)), (0.6, 0.4))
    rows = regimes.regime_filter(s, *args).orderBy("date").collect()
    pred = [0.6, 0.4]
    for r, v in zip(rows, [0.1, -0.5, 0.9, 0.0, 0.05], strict=True):
        dens = [p * math.exp(-v * v / (2 * s2)) / math.sqrt(2 * math.pi * s2) for p, s2 in zip(pred, args[1])]
        assert r["log_c"] == pytest.approx(math.log(sum(dens)))
        f = [x / sum(dens) for x in dens]
        assert r["calm"] == pytest.approx(f[0])
        pred = [f[0] * 0.9 + f[1] * 0.2, f[0] * 0.1 + f[1] * 0.8]
    p = regimes.regime_filter(s, *args)
    w = regimes.gate_weights(p, args[2], "window", 1).collect()
    q = regimes.gate_weights(p, args[2], "predicted").collect()
    assert [r["calm"] for r in w] == pytest.approx([r["calm"] for r in q])
    identity = regimes.gate_weights(p, ((1, 0), (0, 1)), "window", 4).collect()
    assert [r["calm"] for r in identity] == pytest.approx([r["calm"] for r in p.collect()])


def test_equal_weights_give_the_plain_mean(spark):
    s = series(spark, [0.1, 0.2, 0.6]).withColumns({"calm": F.lit(0.5), "stress": F.lit(0.5)})
    for r in regimes.weighted_regime_ic(s, "ic").collect():
        assert r["weighted_ic"] == pytest.approx(0.3) and r["eff_dates"] == pytest.approx(3.0)


def test_stress_episodes(spark):
    s = series(spark, [0.9, 0.9, 0.1, 0.8, 0.9, 0.9, 0.2, 0.9])
    assert regimes.stress_episodes(s, "ic", 0.5, 2).first()["episodes"] == 2


def test_balancing_counts(spark):
    counts = {0: 1000, 1: 50, -1: 30, 2: 20, -2: 80}
    rows = [(k, i) for k, n in counts.items() for i in range(n)]
    d = spark.createDataFrame(rows, "k int, id int")
    b = {r["k"]: r["count"] for r in sampling.balance_signed(d, "k", ("k", "id"), 10_000).groupBy("k").count().collect()}
    assert b == {1: 30, -1: 30, 2: 20, -2: 20}
    z = sampling.downsample_zero(d, "k", 2.0, ("k", "id"), 10_000).where("k = 0").count()
    assert z == 360
    wide = sampling.downsample_zero(d, "k", 2.0, ("k", "id"), None).where("k = 0")
    assert wide.count() == 360


def spells(spark):
    rows = [(1, dt.date(2020, 1, 6), dt.date(2020, 1, 20)), (1, dt.date(2020, 2, 10), dt.date(2020, 2, 17))]
    return spark.createDataFrame(rows, "entity int, spell_start date, spell_end date")


def test_spell_bounds_are_inclusive(spark):
    got = column(pit.in_spell(panel(spark, range(8)), spells(spark)), "date")
    assert got == [dt.date(2020, 1, d) for d in (6, 13, 20)] + [dt.date(2020, 2, d) for d in (10, 17)]


def test_point_in_time_target_guard(spark):
    with pytest.raises(ValueError, match="not over the members"):
        pit.filter_point_in_time(None, panel(spark, [1]), spells(spark), "x", "r", "entities")


def test_rollback_undoes_later_changes(spark):
    current = spark.createDataFrame([(1,), (2,)], "entity int")
    changes = spark.createDataFrame(
        [(2, dt.date(2020, 3, 10), "added"), (3, dt.date(2020, 3, 10), "removed")], "entity int, date date, kind string")
    anchors = spark.createDataFrame(
        [(dt.date(2020, m, 1), dt.date(2020, m, 2)) for m in (2, 3, 4)], "month date, anchor date")
    got = {(r["entity"], r["month"].month) for r in pit.monthly_members(pit.rollback_intervals(current, changes), anchors).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 2), (3, 3)}


def test_ambiguous_link_gives_no_company(spark):
    links = spark.createDataFrame([
        (1, "000010", dt.date(2020, 1, 1), dt.date(2020, 1, 15)), (1, "000011", dt.date(2020, 1, 13), dt.date(9999, 12, 31))],
        "entity int, gvkey string, link_from date, link_thru date")
    d = pit.unique_on_date(panel(spark, range(3)), links, ["entity"], "gvkey", "link_from", "link_thru", "gvkey")
    assert column(d, "gvkey") == ["000010", None, "000011"]
    a = pit.link_ambiguities(links).collect()
    assert len(a) == 1 and (a[0]["overlap_from"], a[0]["overlap_to"]) == (dt.date(2020, 1, 13), dt.date(2020, 1, 15))


def test_late_quarter_joins_on_its_own_date(spark):
    q = spark.createDataFrame([(7, 8080, dt.date(2020, 5, 1), 10.0), (7, 8081, dt.date(2020, 8, 1), 12.0),
                               (7, 8079, dt.date(2020, 9, 1), 9.0)], "gvkey int, fq_index int, avail date, atq double")
    rows = {r["event"]: r for r in pit.known_quarters(q, ["atq"]).collect()}
    assert set(rows[dt.date(2020, 8, 1)]["known"]) == {0, 1}
    last = rows[dt.date(2020, 9, 1)]
    assert set(last["known"]) == {0, 1, 2} and last["known"][2]["atq"] == 9.0 and last["asof_avail"] == dt.date(2020, 8, 1)


def test_staleness_cap(spark):
    ev_ = spark.createDataFrame([(1, dt.date(2020, 1, 6), dt.date(2020, 1, 6), 5.0)], "entity int, event date, asof_avail date, v double")
    got = column(pit.carry_forward(panel(spark, range(4)), ev_, "entity", ["v"], 14), "v")
    assert got == [5.0, 5.0, 5.0, None]


def test_trading_day_lookups(spark):
    cal = splits.calendar(panel(spark, range(4)))
    d = spark.createDataFrame([(dt.date(2020, 1, 5),), (dt.date(2020, 1, 6),), (dt.date(2020, 1, 28),)], "a date")
    got = {r["a"].day: r["o"] for r in pit.nth_trading_day_after(d, cal, "a", 1, "o").collect()}
    assert got == {5: dt.date(2020, 1, 6), 6: dt.date(2020, 1, 13), 28: None}
    on = {r["a"].day: r["o"] for r in pit.place_on_calendar(d, cal, "a", "o").collect()}
    assert on == {5: dt.date(2020, 1, 6), 6: dt.date(2020, 1, 6), 28: None}


def test_pre_test_guard(spark):
    cal = splits.calendar(panel(spark, range(60)))
    with pytest.raises(splits.PreTestViolation):
        splits.pilot_folds(cal, (2020,), 2021, 2)
    with pytest.raises(splits.PreTestViolation):
        splits.pilot_folds(cal, (2021,), 2021, 2)


def test_business_days(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(21)], "d date")
    for n in (1, 3, 5, 7):
        for r in d.select("d", splits.business_days_before("d", n).alias("o")).collect():
            assert pd.Timestamp(r["o"]) == pd.Timestamp(r["d"]) - pd.tseries.offsets.BDay(n), (r["d"], n)


def test_third_friday(spark):
    d = spark.createDataFrame([(dt.date(2020, 5, 20),), (dt.date(2021, 1, 1),)], "d date")
    assert [r[0] for r in d.select(tc.third_friday("d")).collect()] == [dt.date(2020, 5, 15), dt.date(2021, 1, 15)]


def test_trial_log_refuses_bad_rows(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", {"ir": 1.0}, {}), (2, "b", {"ir": float("nan")}, {})],
                              "trial_id int, tag string, metrics map<string,double>, config map<string,string>")
    good = infer.with_provenance(t, target_kind="raw", feature_set="f", fold_scheme="c", sample_window="w")
    with pytest.raises(ValueError, match="missing provenance"):
        infer.append_trials(t, str(tmp_path / "log"))
    with pytest.raises(ValueError, match="non-finite"):
        infer.append_trials(good, str(tmp_path / "log"))
    infer.append_trials(infer.valid_trials(good), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_greedy_prune(spark):
    cand = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", -1.0)], "candidate string, fitness double")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.2), ("b", "c", 0.1)], "a string, b string, corr double")
    assert [r["candidate"] for r in sampling.greedy_prune(cand, pairs, 0.5).collect()] == ["a", "c"]


def test_greedy_prune_looks_at_all_candidates(spark):
    """Behind 600 variants of one signal stand two others; blocks of any size give what one walk gives."""
    cand = [(f"v{i}", 1000.0 - i) for i in range(600)] + [("x", 2.0), ("y", 1.0)]
    pairs = [("v0", f"v{i}", 0.9) for i in range(1, 600)] + [("x", "y", 0.1), ("y", "v0", -0.3)]
    frames = spark.createDataFrame(cand, "candidate string, fitness double"), spark.createDataFrame(pairs, "a string, b string, corr double")
    assert [tuple(r) for r in sampling.greedy_prune(*frames, 0.5).collect()] == [("v0", 1000.0, 0.0), ("x", 2.0, 0.0), ("y", 1.0, 0.3)]
    rng = random.Random(5)
    corr = {(a, b): float(rng.uniform(-1, 1)) for a in range(12) for b in range(a)}
    kept = {}
    for a in range(12):
        worst = max([0.0, *(abs(corr[a, b]) for b in kept)])
        if worst <= 0.5:
            kept[a] = worst
    cand = spark.createDataFrame([(f"{a:02}", 12.0 - a) for a in range(12)], "candidate string, fitness double")
    pairs = spark.createDataFrame([(f"{a:02}", f"{b:02}", c) for (a, b), c in corr.items()], "a string, b string, corr double")
    got = {int(r["candidate"]): r["max_corr"] for r in sampling.greedy_prune(cand, pairs, 0.5, block=3).collect()}
    assert len(kept) > 1 and got == kept


def test_a_balanced_sample_orders_class_zero_and_nonzero_rows_once(spark, monkeypatch):
    """Only the rows that are drawn from are put in order, with the same picks as of each class by itself."""
    d = spark.range(400).select(F.lit("2020-01-02").alias("date"), F.col("id").alias("entity"),
                                F.when(F.col("id") % 5 == 0, 0.1).when(F.col("id") % 5 == 1, -0.1).otherwise(0.0).alias("y"))
    ordered, first = [], sampling._first_of_class
    monkeypatch.setattr(sampling, "_first_of_class", lambda df, *a: (ordered.append(df.count()), first(df, *a))[1])
    got = sampling.balanced_sample(d, "y", (0.05,), 0.5)
    assert sorted(ordered) == [160, 240] and got.columns == ["date", "entity", "y", "y_bucket"]
    rows = {k: {r["entity"] for r in got.where(F.col("y_bucket") == k).collect()} for k in (-1, 0, 1)}
    order = sorted((hashlib.md5(f"2020-01-02|{i}".encode()).hexdigest(), i) for i in range(400) if i % 5 > 1)
    assert rows == {-1: set(range(1, 400, 5)), 0: {i for _, i in order[:80]}, 1: set(range(0, 400, 5))}
    unlabelled = d.select("date", "entity", F.when(F.col("entity") > 3, F.signum("y").cast("int")).alias("k"))
    z = sampling.downsample_zero(unlabelled, "k", 0.0)
    assert {(r["k"], r["count"]) for r in z.groupBy("k").count().collect()} == {(None, 4), (1, 79), (-1, 79)}


def test_file_layouts(spark, tmp_path):
    """Both layouts: date/code.parquet files and symbol.csv files with a duplicate date."""
    from panelspark.sources import files as fl

    for code, t in (("a", [1, 2]), ("b", [1])):
        for kind, frame in (("factor", {"close_time": t, "f1": [float(v) for v in t]}), ("label", {"Time": t[:1], "y": [0.1]})):
            folder = tmp_path / kind / "2020-01-02"
            folder.mkdir(parents=True, exist_ok=True)
            if not (code == "b" and kind == "label"):
                pd.DataFrame(frame).to_parquet(folder / f"{code}.parquet", index=False)
    got = fl.read_partitioned_training(spark, str(tmp_path / "factor"), str(tmp_path / "label"), ["f1"], "y")
    assert sorted((r["date"], r["code"], r["time"], r["y"]) for r in got.collect()) == [
        ("2020-01-02", "a", 1, 0.1), ("2020-01-02", "a", 2, 0.0)]
    (tmp_path / "sym").mkdir()
    (tmp_path / "sym" / "X.csv").write_text("date,close\n2020-01-02,1.0\n2020-01-03,2.0\n2020-01-02,5.0\n")
    rows = fl.read_symbol_cache(spark, str(tmp_path / "sym"), "date date, close double").collect()
    assert sorted((r["symbol"], r["date"].day, r["close"]) for r in rows) == [("X", 2, 5.0), ("X", 3, 2.0)]


def test_symbol_files_are_written_by_their_tasks(spark, tmp_path):
    """One csv per symbol, whole across batches, in line order; a folder for each task and not for each symbol, one for missing symbols."""
    from panelspark.sources import files as fl

    d = spark.range(2000).select(
        F.when(F.col("id") % 40 != 39, F.concat(F.lit("s"), F.col("id") % 40)).alias("symbol"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 80).cast("int")).alias("date"),
        F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("close"), F.lit("a,b").alias("name"), (F.col("id") % 80 >= 40).cast("int").alias("k"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        folders = fl.write_symbol_cache(d, f"file:{tmp_path}/sym", ["date", "close", "name"], ["date", "k"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [p for p in (tmp_path / "sym").rglob("*") if p.is_file()]
    assert len(found) == 40 and len({p.parent for p in found if p.name != "part.csv"}) <= len(folders) < 40
    text = next(p for p in found if p.name == "s7.csv").read_text().splitlines()
    assert text[:4] == ["date,close,name", '2020-01-01,,"a,b"', '2020-01-01,5.875,"a,b"', '2020-01-02,10.875,"a,b"'] and len(text) == 51
    got = {(r["symbol"], r["date"].isoformat()): (r["close"], r["name"]) for r in fl.read_symbol_cache(spark, folders, "date date, close double, name string").collect()}
    last = {(r["symbol"] or "__HIVE_DEFAULT_PARTITION__", r["date"].isoformat()): (r["close"], r["name"]) for r in d.where("k = 1").collect()}
    assert len(last) == 1000 and got == last
    none = fl.write_symbol_cache(d.where("id < 0"), f"file:{tmp_path}/none", ["date", "close"], ["date", "k"])
    assert fl.read_symbol_cache(spark, none, "date date, close double").count() == 0


def test_delimited_header_and_identity(spark, tmp_path):
    from panelspark.sources import files as fl

    (tmp_path / "t.txt").write_text("KYGVKEY|LINKDT|Other\n001234|2020-01-02|x\n")
    r = fl.read_delimited(spark, str(tmp_path / "t.txt"), {"kygvkey": "string", "linkdt": "date"}).first()
    assert r["kygvkey"] == "001234" and r["linkdt"] == dt.date(2020, 1, 2)
    with pytest.raises(ValueError, match="lacks columns"):
        fl.read_delimited(spark, str(tmp_path / "t.txt"), {"nope": "string"})
    d = spark.range(3)
    fl.extract_bundle({"t": d}, str(tmp_path / "b"), {"source": "s", "lo": "1"})
    assert fl.load_extract(spark, str(tmp_path / "b"), "t", {"source": "s", "lo": "1"}).count() == 3
    with pytest.raises(fl.ExtractMismatch, match="lo: 1 != 2"):
        fl.load_extract(spark, str(tmp_path / "b"), "t", {"source": "s", "lo": "2"})


def test_anchor_years_before_the_calendar(spark):
    from panelspark.operators.splits import calendar

    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 6, 7)], "date date")
    cal = calendar(days)
    asks = [dt.date(2016, 5, 1), dt.date(2019, 12, 31), dt.date(2020, 1, 1), dt.date(2020, 1, 3), dt.date(2020, 1, 6), dt.date(2020, 1, 7), dt.date(2020, 2, 1), None]
    rows = spark.createDataFrame([(a,) for a in asks], "anchor date")
    second = {r["anchor"]: r["out"] for r in pit.nth_trading_day_after(rows, cal, "anchor", 2, "out").collect()}
    jan = lambda d: dt.date(2020, 1, d)
    assert second == dict(zip(asks, [jan(2), jan(2), jan(6), jan(7), None, None, None, None]))
    placed = {r["anchor"]: r["out"] for r in pit.place_on_calendar(rows, cal, "anchor", "out").collect()}
    assert placed == dict(zip(asks, [jan(1), jan(1), jan(1), jan(6), jan(6), jan(7), None, None]))


def test_open_intervals_hold_any_date(spark):
    spells = spark.createDataFrame([("a", dt.date(2020, 1, 5), dt.date(9999, 12, 31)), ("b", dt.date(1, 1, 1), dt.date(2020, 1, 1)), ("c", None, dt.date(9999, 12, 31))],
                                   "entity string, spell_start date, spell_end date")
    rows = spark.createDataFrame([("a", dt.date(2101, 1, 15)), ("a", dt.date(2020, 1, 4)), ("b", dt.date(1850, 3, 1)), ("b", dt.date(2020, 1, 2)), ("c", dt.date(2020, 1, 2))], "entity string, date date")
    assert sorted(map(tuple, pit.in_spell(rows, spells).collect())) == [("a", dt.date(2101, 1, 15)), ("b", dt.date(1850, 3, 1))]
    assert "Generate" not in pit.in_spell(rows, spells)._jdf.queryExecution().toString()
    listed = pit.by_month(spells, "spell_start", "spell_end", rows.where("entity = 'a'").agg(F.min("date"), F.max("date")))
    assert listed.where("entity = 'a'").count() == 81 * 12 + 1


def test_panel_folder_with_plain_parts_and_conflict_copies(spark, tmp_path):
    import shutil
    from pathlib import Path

    from panelspark.sources import files as fl

    d = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 2.0), (dt.date(2020, 1, 2), 1, 3.0)], "date date, entity int, value double").coalesce(1)
    d.write.option("compression", "none").parquet(str(tmp_path / "close"))
    part = next(p for p in Path(tmp_path / "close").iterdir() if p.name.endswith("c000.parquet"))
    shutil.copy(part, part.with_name(part.name.replace(".parquet", " 2.parquet")))
    assert sorted(map(tuple, fl.load_panel(spark, str(tmp_path), ["close"]).collect())) == [(dt.date(2020, 1, 1), 1, 2.0), (dt.date(2020, 1, 2), 1, 3.0)]


@pytest.mark.parametrize("big", [2**40, 2**50, 0])
def test_bar_order_of_large_keys(spark, tmp_path, big):
    """Keys that fit a BIGINT with the weekday, keys that don't, negative ones, and both kinds in one bar."""
    from panelspark.sources.tables import daily_bars, weekly_bars

    monday, tuesday = dt.datetime(2020, 1, 6), dt.datetime(2020, 1, 7)
    rows = [(1, monday, big + 5, 9, 10.0, 1.0), (1, monday, big + 5, 10, 300000.0, 1.0), (1, monday, big + 4, 2**30, 200000.0, 1.0), (1, monday, 3, 8, 400000.0, 1.0),
            (2, monday, 3, 1, 1.0, 1.0), (2, monday, -3, 1, 2.0, 1.0), (2, tuesday, -9, 1, 3.0, 1.0), (2, tuesday, 9, 1, 4.0, 1.0),
            (3, tuesday, 2**62, 2, 5.0, 1.0), (3, tuesday, 2**62, 1, 6.0, 1.0), (3, monday, 2**63 - 1, 1, 7.0, 1.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))

    def want(keep):
        groups = {}
        for entity, day, order, line, price, _ in rows:
            groups.setdefault((entity, keep(day)), []).append((day, order, line, price))
        return {k: (min(v)[3], max(v)[3]) for k, v in groups.items()}

    for bars, keep in ((daily_bars, lambda d: d.date()), (weekly_bars, lambda d: monday.date())):
        assert {(r.entity, r.date): (r.open, r.close) for r in bars(spark, str(tmp_path)).collect()} == want(keep)


def test_sweep_equals_all_pairs(spark):
    """Overlapping, nested, empty and open intervals, repeated rows, missing keys and dates."""
    rng = random.Random(9)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    spans = [(rng.choice("abc"), day(a := rng.randrange(300)), day(a + rng.choice((-3, 0, 1, 5, 40)))) for _ in range(40)]
    spans += [("d", day(5), dt.date(9999, 12, 31)), ("e", None, day(9)), ("e", day(9), None), (None, day(0), day(99))]
    rows = [(rng.choice("abcde"), day(rng.randrange(-5, 320)), i) for i in range(400)] + [(None, day(3), 1000), ("a", None, 1001), ("d", dt.date(9999, 12, 31), 1002)]
    rows += rows[:3]
    iv = spark.createDataFrame(spans, "entity string, spell_start date, spell_end date")
    df = spark.createDataFrame(rows, "entity string, date date, i int").repartition(4)
    hit = lambda r: any(k is not None and k == r[0] and r[1] is not None and a is not None and b is not None and a <= r[1] <= b for k, a, b in spans)
    got = pit.membership_flag(df, iv).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*r, hit(r))) for r in rows)
    assert sorted(str(tuple(r)) for r in pit.in_spell(df, iv).collect()) == sorted(str(r) for r in rows if hit(r))


def test_pooled_folds(spark):
    """Every arm's predictions of every fold; with a first year, earlier folds are no part of the pool."""
    from panelspark.operators.quality import pooled_folds

    rows = spark.createDataFrame([("1994-01-03", 1.0, 2.0), ("1996-05-06", 3.0, None)], "date string, a double, b double").withColumn("date", F.to_date("date"))
    got = lambda **k: sorted(((r.date.year, r.arm, r.pred) for r in pooled_folds(rows, {"x": "a", "y": "b"}, ["date"], **k).collect()), key=str)
    assert got() == [(1994, "x", 1.0), (1994, "y", 2.0), (1996, "x", 3.0), (1996, "y", None)]
    assert got(first_year=1996) == [(1996, "x", 3.0), (1996, "y", None)]
