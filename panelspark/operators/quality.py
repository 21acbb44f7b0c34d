"""Coverage, data-quality and weight reports: aggregates over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluate import kish


def weight_mass(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(year, ess_dates, ess_rows, mass): Kish sizes and share of the row weight per calendar year."""
    per_date = panel.groupBy("date").agg(F.count(F.lit(1)).alias("c")).join(weights, "date")
    g = per_date.groupBy(F.year("date").alias("year")).agg(
        kish("weight").alias("ess_dates"), kish("weight", "c").alias("ess_rows"),
        F.sum(F.col("weight") * F.col("c")).alias("mass"))
    return g.withColumn("mass", F.col("mass") / F.sum("mass").over(W.partitionBy(F.lit(0))))


def identifier_violations(report: DataFrame, columns, identifiers: DataFrame) -> DataFrame:
    """(column, value): report values that equal an identifier (``identifiers``: one column ``id``)."""
    values = report.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    ids = identifiers.select(F.col("id").cast("string").alias("value")).distinct()
    return values.join(ids, "value", "left_semi").distinct()


def assert_aggregate_only(report: DataFrame, columns, identifiers: DataFrame) -> None:
    bad = identifier_violations(report, columns, identifiers).first()
    if bad is not None:
        raise ValueError(f"column {bad['column']} holds the identifier {bad['value']}")


def coverage_by_year(spells: DataFrame, rows: DataFrame, dates: DataFrame) -> DataFrame:
    """(year, members, with_rows, without_rows, coverage): members of the year that have a row in it.

    A spell is clipped to the year's first and last date; each spell is listed under the years it
    touches, so the join carries an equality on (entity, year).
    """
    years = dates.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    touched = spells.select("entity", "spell_start", "spell_end", F.explode(
        F.sequence(F.year("spell_start"), F.year("spell_end"))).alias("year"))
    members = touched.join(F.broadcast(years), "year").where(  # one row per year
        (F.col("spell_start") <= F.col("b")) & (F.col("spell_end") >= F.col("a"))).select("year", "entity").distinct()
    have = rows.select(F.year("date").alias("year"), "entity").distinct().withColumn("_in", F.lit(1))
    g = members.join(have, ["year", "entity"], "left").groupBy("year").agg(
        F.count(F.lit(1)).alias("members"), F.count("_in").alias("with_rows"))
    return g.withColumns({"without_rows": F.col("members") - F.col("with_rows"),
                          "coverage": F.col("with_rows") / F.col("members")})


def universe_coverage(flagged: DataFrame) -> DataFrame:
    """(date, members, available, share) from rows with ``member`` and ``present`` flags."""
    m, p = F.col("member"), F.col("present")
    return flagged.groupBy("date").agg(
        F.sum(m.cast("bigint")).alias("members"), F.sum((m & p).cast("bigint")).alias("available")
    ).withColumn("share", F.col("available") / F.nullif(F.col("members"), F.lit(0)))


def present_share(panel: DataFrame, features, flags: dict) -> DataFrame:
    """(year, rows, <feature> share present, <flag> rate) overall (year missing) and by year.

    One grouping-sets pass: year is rolled up.
    """
    d = panel.withColumn("year", F.year("date"))
    return d.rollup("year").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features],
        *[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])


def rdq_coverage(quarters: DataFrame) -> DataFrame:
    """(fyearq, firm_quarters, rdq_share, filing_share)."""
    return quarters.groupBy("fyearq").agg(
        F.count(F.lit(1)).alias("firm_quarters"), F.avg(F.col("rdq_date").isNotNull().cast("double")).alias("rdq_share"),
        F.avg(F.col("first_filing").isNotNull().cast("double")).alias("filing_share"))


def early_years(panel: DataFrame, features, flags: dict, quarters: DataFrame, first: int, last: int) -> DataFrame:
    """Calendar-year panel rates beside fiscal-year report coverage, one row per year."""
    if last < first:
        raise ValueError(f"empty range {first}..{last}")
    spark = panel.sparkSession
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    rates = present_share(panel, features, flags).where("year is not null")
    fiscal = rdq_coverage(quarters).withColumnRenamed("fyearq", "year")
    return years.join(rates, "year", "left").join(fiscal, "year", "left")


def build_report(panel: DataFrame) -> DataFrame:
    """One row: rows, dates, entities, names per date (min, median, max), missing and extreme returns."""
    per_date = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    names = per_date.agg(
        F.count(F.lit(1)).alias("dates"), F.min("n").alias("min_names"), F.percentile("n", F.lit(0.5)).alias("median_names"),
        F.max("n").alias("max_names"), F.sum("n").alias("rows"))
    body = panel.agg(
        F.countDistinct("entity").alias("entities"), F.sum(F.col("ret").isNull().cast("bigint")).alias("missing_returns"),
        F.sum((F.col("close") <= 0).cast("bigint")).alias("non_positive_prices"),
        F.sum((F.abs("ret") > 3).cast("bigint")).alias("extreme_returns"))
    return names.withColumn("_k", F.lit(1)).join(F.broadcast(body.withColumn("_k", F.lit(1))), "_k").drop("_k")


def missing_return_split(panel: DataFrame, r: str, member, back: int, h: int) -> DataFrame:
    """(year, category, rows): member rows lost to missing returns, by where the missing one sits.

    A row needs ``back`` returns through its date and ``h`` after it. Rows whose windows run past the
    entity's history are ``other_invalid``; rows that would be valid with every missing return filled
    split into backward only, forward only and both.
    """
    from .rolling import _w

    e = _w(None)
    b, f = e.rowsBetween(-(back - 1), 0), e.rowsBetween(1, h)
    one = F.lit(1)
    d = panel.select(
        "date", "entity", member.alias("_member"),
        (F.count(one).over(b) == back).alias("_b_rows"), (F.count(one).over(f) == h).alias("_f_rows"),
        (F.count(r).over(b) < F.count(one).over(b)).alias("_b_miss"),
        (F.count(r).over(f) < F.count(one).over(f)).alias("_f_miss"))
    whole = F.col("_b_rows") & F.col("_f_rows")
    cat = (
        F.when(~whole, "other_invalid").when(F.col("_b_miss") & F.col("_f_miss"), "c_both")
        .when(F.col("_b_miss"), "a_backward_only").when(F.col("_f_miss"), "b_forward_only").otherwise("panel_rows"))
    return d.where("_member").groupBy(F.year("date").alias("year"), cat.alias("category")).agg(F.count(one).alias("rows"))


def dual_class_per_date(rows: DataFrame) -> DataFrame:
    """(date, companies): companies with two or more members on the date."""
    multi = rows.groupBy("date", "company").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return multi.groupBy("date").agg(F.count(F.lit(1)).alias("companies"))


def keyset_count(period: DataFrame) -> DataFrame:
    """(keyset, firm_quarters): distinct firm-quarters of each keyset."""
    d = period.select("keyset", "gvkey", "fyearq", "fqtr").distinct()
    return d.groupBy("keyset").agg(F.count(F.lit(1)).alias("firm_quarters"))


def sector_rows(panel: DataFrame, r: str, cap: str) -> DataFrame:
    """Complete rows with the previous row's ``cap`` as ``cap_prev``."""
    from .rolling import delay

    d = panel.withColumn("cap_prev", delay(cap, 1))
    return d.dropna(subset=[r, "cap_prev", "sector"])


def sector_returns(rows: DataFrame, r: str, weighting: str, min_names: int) -> DataFrame:
    """(date, sector, ret, names): log of one plus the weighted mean simple return; thin cells missing."""
    if weighting not in ("value", "equal"):
        raise ValueError(f"weighting {weighting!r}: use value or equal")
    w = F.col("cap_prev") if weighting == "value" else F.lit(1.0)
    g = rows.groupBy("date", "sector").agg(
        F.sum(F.col(r) * w).alias("_num"), F.sum(w).alias("_den"), F.count(F.lit(1)).alias("names"))
    mean = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))
    return g.select("date", "sector", F.when(F.col("names") >= min_names, F.log1p(mean)).alias("ret"), "names")


def thin_sectors(counts: DataFrame, sectors, min_names: int) -> DataFrame:
    """(sector, thin_dates, median_names, min_names, fitted): an absent cell counts as 0 names.

    Sectors become columns of one row per date, so absent cells appear without joining calendars.
    """
    names = [str(s) for s in sectors]
    wide = counts.withColumn("sector", F.col("sector").cast("string")).groupBy("date").pivot("sector", names).agg(
        F.max("names")).na.fill(0, names)
    long = wide.unpivot(["date"], [f"`{n}`" for n in names], "sector", "k")
    return long.groupBy("sector").agg(
        F.sum((F.col("k") < min_names).cast("bigint")).alias("thin_dates"),
        F.percentile("k", F.lit(0.5)).alias("median_names"), F.min("k").alias("least_names"),
        (F.min("k") >= min_names).alias("fitted"))


def outlier_report(panel: DataFrame, r: str, in_universe, extreme: float, span: float) -> DataFrame:
    """(entity, extreme_bars, price_span, zero_adv, excluded): repeat offenders and impossible spans."""
    g = panel.groupBy("entity").agg(
        F.sum((F.abs(r) > extreme).cast("bigint")).alias("extreme_bars"),
        (F.max("close") / F.nullif(F.min("close"), F.lit(0.0))).alias("price_span"),
        F.sum((in_universe & F.coalesce(F.col("adv") == 0, F.lit(True))).cast("bigint")).alias("zero_adv"))
    bad = (F.col("extreme_bars") >= 2) | (F.col("price_span") > span)
    g = g.where((F.col("extreme_bars") > 0) | (F.col("price_span") > span) | (F.col("zero_adv") > 0))
    return g.withColumn("excluded", bad)


def panel_validation(panel: DataFrame) -> DataFrame:
    """(check, value, status): nine groups of checks, all from two aggregate passes over the panel."""
    from .rolling import delay, simple_return

    d = panel.withColumns({
        "_r1": simple_return("close", 1), "_r5": simple_return("close", 5), "_prev": delay("date", 1)})
    five = F.lit(1.0)
    for k in range(5):
        five = five * (1.0 + (F.col("_r1") if k == 0 else delay("_r1", k)))
    d = d.withColumn("_c5", five - 1.0)
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("double")
    checks = {
        "rows_without_core_field": (n(F.greatest(*[F.col(c).isNull().cast("int") for c in ("open", "high", "low", "close", "volume")]) == 1), "zero"),
        "duplicate_keys": (n(F.col("date") == F.col("_prev")), "zero"),
        "non_positive_prices": (n(F.least("open", "high", "low", "close") <= 0), "zero"),
        "high_below_low": (n(F.col("high") < F.col("low")), "zero"),
        "close_outside_range": (n((F.col("close") > F.col("high") + 1e-4) | (F.col("close") < F.col("low") - 1e-4)), "warn_zero"),
        "open_inside_range_share": (F.avg(F.col("open").between(F.col("low") - 1e-4, F.col("high") + 1e-4).cast("double")), "near_one"),
        "extreme_returns": (n(F.abs("_r1") > 0.9), "warn_zero"),
        "ret5_max_gap": (F.max(F.abs(F.col("_c5") - F.col("_r5")) / (1.0 + F.abs("_r5"))), "small"),
        "weekday_outside_range": (n(~F.dayofweek("date").between(2, 6)), "zero"),
        "sector_fill_share": (F.avg(F.col("sector").isNotNull().cast("double")), "near_one"),
        "industry_fill_share": (F.avg(F.col("industry").isNotNull().cast("double")), "near_one"),
    }
    one = d.agg(*[c.alias(k) for k, (c, _) in checks.items()])
    moved = panel.groupBy("entity").agg(F.countDistinct("sector").alias("k")).agg(n(F.col("k") > 1).alias("sector_changes"))
    one = one.withColumn("_k", F.lit(1)).join(F.broadcast(moved.withColumn("_k", F.lit(1))), "_k").drop("_k")
    rules = {k: r for k, (_, r) in checks.items()} | {"sector_changes": "zero"}
    long = one.unpivot([], list(rules), "check", "value")
    rule = F.create_map(*[x for k, r in rules.items() for x in (F.lit(k), F.lit(r))])[F.col("check")]
    v = F.col("value")
    ok = (F.when(rule.isin("zero", "warn_zero"), v == 0).when(rule == "near_one", v > 0.7).when(rule == "small", v < 1e-3))
    return long.withColumn("status", F.when(ok, "pass").when(rule == "warn_zero", "warn").otherwise("fail"))


def universe_changes(mask: DataFrame, flag: str = "in_universe") -> DataFrame:
    """(additions, additions_on_anchor, removals): entries by date within the month."""
    from .rolling import delay
    from .universe import month_anchors

    d = mask.withColumn("_prev", delay(F.col(flag).cast("int"), 1))
    a = month_anchors(mask).select(F.col("anchor").alias("date")).withColumn("_anchor", F.lit(1))
    d = d.join(F.broadcast(a), "date", "left")  # one row per month
    add = (F.col("_prev") == 0) & F.col(flag)
    return d.agg(
        F.sum(add.cast("bigint")).alias("additions"), F.sum((add & F.col("_anchor").isNotNull()).cast("bigint")).alias("on_anchor"),
        F.sum(((F.col("_prev") == 1) & ~F.col(flag)).cast("bigint")).alias("removals"))


def prediction_distribution(df: DataFrame, pred: str, levels, bound: int | None = None) -> DataFrame:
    """One row: mean, standard deviation and the listed quantiles of the predictions."""
    from .crosssection import CrossSection

    names = {f"q{str(p).replace('.', '_')}": p for p in levels}
    q = CrossSection((), bound).quantiles(df.select(pred), pred, names)
    m = df.agg(F.avg(pred).alias("mean"), F.stddev_samp(pred).alias("std"))
    return m.withColumn("_k", F.lit(1)).join(F.broadcast(q.withColumn("_k", F.lit(1))), "_k").drop("_k")


def symmetric_thresholds(df: DataFrame, y: str, levels, bound: int | None = None) -> DataFrame:
    """(level, threshold): mean of the absolute lower and upper label quantile at each level."""
    from .crosssection import CrossSection

    names = {}
    for i, p in enumerate(levels):
        names |= {f"lo{i}": p, f"hi{i}": 1.0 - p}
    q = CrossSection((), bound).quantiles(df.select(y), y, names)
    cells = F.array(*[F.struct(F.lit(float(p)).alias("level"),
                               ((F.abs(f"lo{i}") + F.abs(f"hi{i}")) / 2.0).alias("threshold")) for i, p in enumerate(levels)])
    return q.select(F.inline(cells))


def monthly_compounded(daily: DataFrame, r: str, share: float = 0.8) -> DataFrame:
    """(entity, month, ret): compounded simple return of months with enough days."""
    g = daily.groupBy("entity", F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("_d"), F.count(r).alias("_h"), F.sum(F.log1p(r)).alias("_l"))
    return g.select("entity", "month", F.when(F.col("_h") >= F.ceil(share * F.col("_d") - 1e-9), F.expm1("_l")).alias("ret"))


def ridge(df: DataFrame, y: str, xs, weight: str, lam: float) -> DataFrame:
    """(term, coef): weighted ridge, intercept unpenalised.

    Two passes: weighted means (one row, broadcast), then the weighted sums of products about them, combined map-side. The penalty doesn't touch the
    intercept, so the slopes solve the centred p x p system, unrolled as Column expressions, and the means give the intercept.
    """
    from functools import reduce

    from .crosssection import solve_columns

    xs = list(xs)
    names, p = [*xs, y], len(xs)
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, weight, *xs)])
    d = df.where(ok).select(F.col(weight).alias("_w"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(names)], F.lit(1).alias("_k"))
    means = d.agg(*[(F.sum(F.col("_w") * F.col(f"_x{i}")) / F.sum("_w")).alias(f"_m{i}") for i in range(p + 1)]).withColumn("_k", F.lit(1))
    c = d.join(F.broadcast(means), "_k").select("_w", *[f"_m{i}" for i in range(p + 1)], *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_c{i}") for i in range(p + 1)])
    sums = [(F.sum(F.col("_w") * F.col(f"_c{i}") * F.col(f"_c{j}")) + F.lit(float(lam) if i == j else 0.0)).alias(f"_s{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col("_w") * F.col(f"_c{i}") * F.col(f"_c{p}")).alias(f"_t{i}") for i in range(p)]
    one, beta = solve_columns(c.agg(*sums, *[F.max(f"_m{i}").alias(f"_m{i}") for i in range(p + 1)]), p)
    level = F.col(f"_m{p}")
    for i, b in enumerate(beta):
        level = level - F.col(b) * F.col(f"_m{i}")
    cells = F.array(*[F.struct(F.lit(x).alias("term"), F.col(b).alias("coef")) for x, b in zip(xs, beta, strict=True)],
                    F.struct(F.lit("intercept").alias("term"), level.alias("coef")))
    return one.select(F.inline(cells))


def ridge_predict(df: DataFrame, coefs: DataFrame, xs, out: str) -> DataFrame:
    """Add the fitted value; ``coefs`` is the (term, coef) table, p + 1 rows."""
    table = coefs.agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("_b")).withColumn("_k", F.lit(1))
    d = df.withColumn("_k", F.lit(1)).join(F.broadcast(table), "_k")
    fit = F.col("_b")["intercept"]
    for x in xs:
        fit = fit + F.col("_b")[x] * F.col(x)
    return d.withColumn(out, fit).drop("_k", "_b")


def pooled_folds(scored: DataFrame, arms: dict[str, str], keys, first_year: int | None = None) -> DataFrame:
    """The folds' predictions of every arm in long form (``arm``, keys, ``pred``), from one pass over the scored rows.

    ``arms`` names the prediction column of each arm; the folds are rows of one table, told apart by one of the keys. Folds before
    ``first_year`` have no predictions of their own: their rows only train the first fold, so they are no part of the pool.
    """
    if first_year is not None:
        scored = scored.where(F.year("date") >= first_year)
    stacked = F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.col(c).alias("pred")) for arm, c in arms.items()]))
    return scored.select(*keys, stacked.alias("_a")).select(*keys, "_a.arm", "_a.pred")
