"""The split plan of the cross-section must give the window plan's rows, hot groups and ties included."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators.crosssection import CrossSection, split_order

SMALL, UNKNOWN = CrossSection(("date",), 10_000), CrossSection(("date",), None)


@pytest.fixture(scope="module")
def rows(spark):
    """Three dates; the first holds most rows, half of its values are one tie, some are missing."""
    rng = random.Random(7)
    out = []
    for d, n in ((1, 900), (2, 60), (3, 1)):
        for e in range(n):
            x = None if rng.random() < 0.1 else (0.0 if rng.random() < 0.5 else round(rng.gauss(0, 1), 2))
            out.append((dt.date(2020, 1, d), e, x, e % 4 if e % 7 else None, rng.random()))
    return spark.createDataFrame(out, "date date, entity bigint, x double, grp int, w double").repartition(6).cache()


def same(a, b, cols):
    left = {tuple(r[c] for c in ("date", "entity")): [r[c] for c in cols] for r in a.collect()}
    right = {tuple(r[c] for c in ("date", "entity")): [r[c] for c in cols] for r in b.collect()}
    assert left.keys() == right.keys()
    for k, v in left.items():
        for p, q in zip(v, right[k], strict=True):
            assert p == q or (p is not None and q is not None and abs(p - q) < 1e-9), (k, v, right[k])


@pytest.mark.parametrize("method", ["rank_avg", "rank_pct", "rank_centered", "rank_to_unit", "rank_dense12", "tent",
                                    "zscore", "scale12", "rank_ordinal", "harmonic_mean", "unit_gross", "shrink_balance"])
def test_split_plan_equals_window_plan(rows, method):
    a = getattr(SMALL, method)(rows, "x", "out")
    b = getattr(UNKNOWN, method)(rows, "x", "out")
    same(a, b, ["out"])


def test_split_quantiles_winsor_and_groups(rows):
    same(SMALL.winsor(rows, "x", "out", 0.05), UNKNOWN.winsor(rows, "x", "out", 0.05), ["out"])
    same(SMALL.demean(rows, "x", "out", "grp"), UNKNOWN.demean(rows, "x", "out", "grp"), ["out"])
    same(SMALL.within_or_all(rows, "x", "grp", "out", 5), UNKNOWN.within_or_all(rows, "x", "grp", "out", 5), ["out"])
    same(SMALL.factor_neutral(rows, "x", ["w"], "out"), UNKNOWN.factor_neutral(rows, "x", ["w"], "out"), ["out"])
    q = {"lo": 0.1, "mid": 0.5, "hi": 0.9}
    a = {r["date"]: r for r in SMALL.quantiles(rows, "x", q).collect()}
    for r in UNKNOWN.quantiles(rows, "x", q).collect():
        for k in q:
            assert a[r["date"]][k] == pytest.approx(r[k], abs=1e-12)


def test_whole_table_group(rows):
    whole = CrossSection((), None)
    same(CrossSection((), 10_000).rank_avg(rows, "x", "out"), whole.rank_avg(rows, "x", "out"), ["out"])


def test_split_order_counts_rows_and_distinct_values(spark):
    v = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 2), ("b", 9.0, 4)], "g string, x double, c bigint")
    got = {(r["g"], r["x"]): (r["before"], r["nth"], r["n"]) for r in split_order(v, ["g"], ["x"], "c").collect()}
    assert got == {("a", 1.0): (0, 1, 6), ("a", 2.0): (3, 2, 6), ("a", 5.0): (4, 3, 6), ("b", 9.0): (0, 1, 4)}


def test_split_plan_spreads_a_hot_date(spark):
    """No task of the split plan holds more than a fraction of a date with distinct values."""
    hot = spark.range(40_000).select(F.lit(1).alias("g"), F.xxhash64("id").cast("double").alias("x"))
    o = split_order(hot, ["g"], ["x"], None)
    assert o.agg(F.max("nth")).first()[0] == 40_000
    ranged = hot.repartitionByRange(8, "g", "x").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 20_000


def test_scan_prunes_columns_and_pushes_filters(spark, tmp_path):
    df = spark.range(100).select("id", F.col("id").alias("b"), F.col("id").alias("c"))
    df.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where("id > 5").select("b")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_split_running_corrections(spark):
    """Holm and Benjamini-Hochberg give the same values range by range and in one window."""
    from panelspark.operators import infer

    rng = random.Random(3)
    rows = [("f" if i % 5 else "g", i, rng.random() ** 3) for i in range(500)]
    d = spark.createDataFrame(rows, "fam string, id int, p double").repartition(5).cache()
    for fn in (infer.holm, infer.benjamini_hochberg):
        a = {r["id"]: (r["adjusted"], r["reject"]) for r in fn(d, "p", ("fam",), ["id"], bound=1000).collect()}
        b = {r["id"]: (r["adjusted"], r["reject"]) for r in fn(d, "p", ("fam",), ["id"], bound=None).collect()}
        assert a.keys() == b.keys()
        assert all(abs(a[k][0] - b[k][0]) < 1e-12 and a[k][1] == b[k][1] for k in a)


def test_groups_without_values_and_null_keys(spark):
    """A group whose values are all missing, a group of one row and the group of a missing key come back from both plans."""
    rows = [(dt.date(2020, 1, 1), 1, None, None), (dt.date(2020, 1, 1), 2, None, 3.0), (dt.date(2020, 1, 2), 3, 5.0, None), (None, 4, 1.0, 1.0), (None, 5, 2.0, 8.0)]
    d = spark.createDataFrame(rows, "date date, entity int, x double, y double")
    q = {"lo": 0.25, "hi": 0.5}
    assert sorted(map(str, SMALL.quantiles(d, "x", q).collect())) == sorted(map(str, UNKNOWN.quantiles(d, "x", q).collect()))
    a = sorted(map(str, SMALL.winsor_all(d, ["x", "y"], 0.25).select("entity", "x", "y").collect()))
    assert a == sorted(map(str, UNKNOWN.winsor_all(d, ["x", "y"], 0.25).select("entity", "x", "y").collect()))


def test_ranks_side_by_side_equal_ranks_one_by_one(spark):
    """Ties, NaN, both zeros, missing values and classes, classes of one row, rows that come twice and a missing date."""
    rng = random.Random(11)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), 1.5, -2.0]
    rows = [(dt.date(2020, 1, e % 3 + 1) if e % 50 else None, e // 2, rng.choice(values), rng.gauss(0, 1) if e % 5 else None, e % 9, e % 6 if e % 6 < 5 else None) for e in range(400)]
    rows += [(dt.date(2020, 2, 1), 900, 3.0, None, 1, 7), (dt.date(2020, 2, 2), 901, None, None, None, None)]
    d = spark.createDataFrame(rows, "date date, entity int, a double, b double, c int, g int").withColumn("row", F.monotonically_increasing_id()).cache()
    for to, one in (("unit", SMALL.rank_to_unit), ("centered", SMALL.rank_centered)):
        got = SMALL.ranks_side_by_side(d, ["a", "b", "c"], to, ["b", "a"], "g", 18)
        want = SMALL.within_or_all(SMALL.within_or_all(d, "b", "g", "b_g", 18), "a", "g", "a_g", 18)
        for x in "abc":
            want = one(want, x, "u").drop(x).withColumnRenamed("u", x)
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))


def test_cross_section_inputs_sorts_a_dates_rows_once(spark):
    """The sorts of a task don't add up with the columns: one by class for the means, one by date for all ranks; training tables likewise."""
    from panelspark.operators import features as ft

    cols = ["mom_12_1", "ret_20d", "rvol", "log_me", "be_me"]
    d = spark.range(60).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"), F.col("id").alias("entity"),
                               (F.col("id") % 2).alias("sector"), F.rand(1).alias("me"), *[F.rand(i).alias(c) for i, c in enumerate(cols)])
    out = ft.cross_section_inputs(SMALL, d, cols, [], cols[:4], cols[4:], cols[4:], "sector", "me", range(2), 5)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Sort [") == 0 and plan.count("Window [") == 2 and plan.count("FlatMapGroupsInArrow") == 1
    assert out.count() == 60 and sum(n.startswith("be_me_") for n in out.columns) == 1
    t = ft.training_table(SMALL, d, cols, F.col("me") > 0.1, "sector", "ret_20d", "sector")
    assert t._jdf.queryExecution().sparkPlan().toString().count("FlatMapGroupsInArrow") == 1


def _odd_rows(spark):
    """Ties, NaN, both zeros, missing values and classes, classes of one row, rows that come twice and a missing date, in several tasks."""
    rng = random.Random(11)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), 1.5, -2.0]
    rows = [(dt.date(2020, 1, e % 3 + 1) if e % 50 else None, e // 2, rng.choice(values), rng.gauss(0, 1) if e % 5 else None, e % 9, e % 6 if e % 6 < 5 else None) for e in range(400)]
    rows += [(dt.date(2020, 2, 1), 900, 3.0, None, 1, 7), (dt.date(2020, 2, 2), 901, None, None, None, None)]
    d = spark.createDataFrame(rows, "date date, entity int, a double, b double, c int, g int").withColumn("row", F.monotonically_increasing_id())
    return d.repartition(5).cache()


def _lines(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_split_ranks_and_ends_of_many_columns_equal_the_window_plan(spark, monkeypatch, small):
    """Whole pieces in one range each, and pieces of few rows in ranges of few values."""
    from panelspark.operators import packed

    if small:
        for name, value in (("RANGE_VALUES", 40), ("STEP", 3), ("BLOCK_ROWS", 50)):
            monkeypatch.setattr(packed, name, value)
    d = _odd_rows(spark)
    for to in ("unit", "centered", "pct"):
        a, b = (xs.ranks_side_by_side(d, ["a", "b", "c"], to, ["b", "a"], "g", 18) for xs in (SMALL, UNKNOWN))
        assert a.schema.simpleString() == b.schema.simpleString() and _lines(a) == _lines(b)
    cuts = packed._range_cuts(packed.pack(d, ["date"]), ["date"], [("b", False), ("a", True)], "g")
    assert bool(cuts) == small
    assert _lines(SMALL.winsor_all(d, ["a", "b", "c"], 0.1)) == _lines(UNKNOWN.winsor_all(d, ["a", "b", "c"], 0.1))


def test_only_values_near_a_place_travel_for_a_quantile(spark):
    """The values between which a place lies are a small share of a column, and the place is among them."""
    from panelspark.operators import packed

    d = spark.range(0, 50_000, 1, 4).select(F.lit(1).alias("date"), F.xxhash64("id").cast("double").alias("x"))
    near = packed.value_brackets(d, ["date"], ["x"], [0.01, 0.5]).first()
    ordered = [r[0] for r in d.select("x").orderBy("x").collect()]
    for p, lo, hi in zip((0.01, 0.5), near["_lo"], near["_hi"], strict=True):
        at = int(p * 49_999)
        assert near["_n"] == 50_000 and lo <= ordered[at] and ordered[at + 1] <= hi
        assert sum(lo <= x <= hi for x in ordered) < 1_000


def _no_checkpoint(monkeypatch):
    """Rows are stored as columns, packed or not: a plan that writes wide rows for each column or step fails."""
    from panelspark.operators import crosssection, evaluate

    def refuse(df):
        raise AssertionError(f"whole rows are written: {df.columns}")

    for module in (crosssection, evaluate):
        monkeypatch.setattr(module, "materialize", refuse)


def test_terminals_without_a_bound(spark, monkeypatch):
    """Equal rows, and no step of the split plan writes whole rows once more."""
    from panelspark.operators import features as ft

    _no_checkpoint(monkeypatch)
    d = spark.range(600).select(F.date_add(F.lit("2020-01-01").cast("date"), (7 * F.floor(F.col("id") / 10)).cast("int")).alias("date"), (F.col("id") % 10).alias("entity"),
                                F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("industry"), *[(1 + F.rand(i)).alias(c) for i, c in enumerate(
                                    ["open", "high", "low", "close", "volume", "dollar_volume"])], F.sin("id").alias("mkt")).cache()
    a, b = (ft.terminals(xs, d, year=100) for xs in (SMALL, UNKNOWN))
    assert a.columns == b.columns and b.count() == 600
    same(a, b, ft.TERMINALS)


def test_cross_section_inputs_without_a_bound_deal_rows_once(spark):
    """One join for all ranks, where there was one (and a table of wide rows) for each; equal rows."""
    from panelspark.operators import features as ft

    cols = ["mom_12_1", "ret_20d", "rvol", "log_me", "be_me"]
    d = spark.range(90).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"), F.col("id").alias("entity"),
                               F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("sector"), F.rand(1).alias("me"),
                               *[F.when(F.rand(9 + i) > 0.1, F.round(F.rand(i), 1)).alias(c) for i, c in enumerate(cols)]).cache()
    a, b = (ft.cross_section_inputs(xs, d, cols, [], cols[:4], cols[4:], cols[4:], "sector", "me", range(2), 5) for xs in (SMALL, UNKNOWN))
    assert b._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    assert a.columns == b.columns
    same(a, b, b.columns[2:])


def test_training_table_without_a_bound(spark, monkeypatch):
    from panelspark.operators import features as ft

    _no_checkpoint(monkeypatch)
    d = spark.range(90).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"), F.col("id").alias("entity"),
                               F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("industry"), (F.col("id") % 2).cast("int").alias("stress"),
                               *[F.when(F.rand(9 + i) > 0.1, F.round(F.rand(i), 1)).alias(c) for i, c in enumerate(["vol", "mom", "nr", "u"])]).cache()
    a, b = (ft.training_table(xs, d, ["vol", "mom"], F.col("u") > 0.2, "industry", "nr", "stress") for xs in (SMALL, UNKNOWN))
    assert a.columns == b.columns and b.count() > 30
    same(a, b, ["vol", "mom", "y", "weight"])


def test_run_report_without_a_bound(spark, monkeypatch):
    """Forecasts that tie across the edges of the legs, all of a date's forecasts equal, dates with fewer names than legs; no whole rows are written."""
    from panelspark.operators import evaluate as ev

    d = spark.range(1200).select(F.date_add(F.lit("2020-01-01").cast("date"), (7 * F.floor(F.col("id") / 30)).cast("int")).alias("date"), (F.col("id") % 30).alias("entity"),
                                 F.when(F.rand(1) > 0.1, F.rand(2) - 0.5).alias("r"), F.floor(4 * F.rand(3)).cast("double").alias("s1"),
                                 F.when(F.col("id") >= 300, F.lit(1.0)).when(F.col("id") % 30 < 4, F.rand(4)).alias("s2")).cache()
    d.count()
    a = ev.run_report(d, ["s1", "s2"], "r", 3, (0, 1), 5, bound=10_000).collect()
    real = CrossSection.ordinal
    tied = []
    _no_checkpoint(monkeypatch)

    def ordinal(self, df, *args):
        from panelspark.session import materialize

        tied.append(df.count())
        with monkeypatch.context() as m:
            from panelspark.operators import crosssection
            m.setattr(crosssection, "materialize", materialize)
            return real(self, df, *args)

    monkeypatch.setattr(CrossSection, "ordinal", ordinal)
    b = ev.run_report(d, ["s1", "s2"], "r", 3, (0, 1), 5, bound=None).collect()
    key = lambda r: (r["predictor"], r["lag"])
    assert len(a) == len(b) == 4 and len(tied) == 1 and tied[0] > 0
    for p, q in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert all(x == y or (x is not None and y is not None and abs(x - y) < 1e-9 * max(1, abs(x)) if not isinstance(x, str) else False) for x, y in zip(p, q, strict=True)), (p, q)


def test_stored_columns_leave_no_shuffle_files(spark):
    """Spark removes what was shuffled for a stored table with the write; the session's setting stays."""
    from panelspark import session

    before = spark.conf.get(session._CLEANUP)
    d = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    assert session.materialize_columns(d).count() == 7 and d.count() == 7
    assert spark.conf.get(session._CLEANUP) == before
