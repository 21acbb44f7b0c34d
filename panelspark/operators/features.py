"""Named feature sets: compositions of the per-entity, per-date and point-in-time operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elementwise import zero_to_null
from . import rolling as ts
from .rolled import roll, rolled

#: Columns that identify a row or carry its bar.
IDENTIFIERS = ("date", "entity", "asset", "open", "high", "low", "close", "volume")


def feature_columns(df) -> list[str]:
    """Every column that is neither an identifier, a bar field nor a label (``y_``)."""
    return [c for c in df.columns if c not in IDENTIFIERS and not c.startswith("y_")]


def market_frame(market: DataFrame, horizon: int, w: int = 20) -> DataFrame:
    """(date, ret_1d, ret_20d, vol_20d, fwd) of the market series, one row per calendar date."""
    one = W.partitionBy(F.lit(0)).orderBy("date")
    return market.select(
        "date", F.col("mkt").alias("ret_1d"), ts.sum_("mkt", w, w, one).alias("ret_20d"),
        ts.std("mkt", w, w, one).alias("vol_20d"), ts.forward_sum("mkt", horizon, over=one).alias("fwd"))


def report_days(quarters: DataFrame, cal: DataFrame) -> DataFrame:
    """(entity, date, rdq_date): each report date on the first trading day on or after it, latest wins."""
    from .pit import place_on_calendar

    q = quarters.where("rdq_date is not null").select(F.col("gvkey").alias("entity"), "rdq_date")
    placed = place_on_calendar(q, cal, "rdq_date", "date").where("date is not null")
    return placed.groupBy("entity", "date").agg(F.max("rdq_date").alias("rdq_date"))


def lagged_labels(panel: DataFrame, r: str, horizon: int, lags, bound: int | None = None, keep=()) -> DataFrame:
    """(date, entity, keep, lag, label): forward sums at each execution lag, demeaned on the formation date."""
    from .crosssection import CrossSection

    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_y{k}").alias("y")) for k in lags])
    xs = CrossSection(("date", "lag"), bound)
    d = panel.select("date", "entity", *keep, *[ts.forward_sum(r, horizon, k).alias(f"_y{k}") for k in lags])
    d = d if xs.windowed else xs.store(d)
    return xs.demean(d.select("date", "entity", *keep, F.inline(cells)), "y", "label", stored=True)


def adjust_volume(rows: DataFrame, factors: DataFrame, factor: str, out: str) -> DataFrame:
    """Volume on the adjusted share basis; a row without a factor keeps its own volume."""
    return rows.join(factors, ["entity", "date"], "left").withColumn(
        out, F.col("volume") * F.coalesce(F.col(factor), F.lit(1.0)))


def build_context(market: DataFrame, index: DataFrame, periods: int) -> DataFrame:
    """Full outer join of the market series with an index series, plus |market| and trailing volatility."""
    one = W.partitionBy(F.lit(0)).orderBy("date")
    m = market.select("date", "mkt", F.abs("mkt").alias("abs_mkt"),
                      (ts.std("mkt", 20, 20, one) * F.sqrt(F.lit(float(periods)))).alias("vol"))
    return m.join(index, "date", "full_outer")


def features_long(df: DataFrame, windows=(5, 10, 20, 60)) -> DataFrame:
    """Log return, rolling mean/std/min/max of it, log-volume mean/std and mean residuals per window."""
    d = df.withColumns({"ret_1d": ts.log_return("close"), "log_vol": F.log1p("volume")})
    out = {}
    for w in windows:
        for name, fn in (("mean", ts.mean), ("std", ts.std), ("min", ts.min_), ("max", ts.max_)):
            out[f"ret_1d_{name}_{w}"] = fn("ret_1d", w)
        out[f"log_vol_mean_{w}"] = ts.mean("log_vol", w)
        out[f"log_vol_std_{w}"] = ts.std("log_vol", w)
        out[f"ret_resid_{w}"] = ts.norm("ret_1d", w)
    return d.withColumns(out)


TERMINALS = ("c_ma20", "c_ma60", "hl", "co", "gap", "stoch", "ret1", "ret5", "ret20", "v_ma20", "dv_adv", "vol20",
             "size", "beta60", "amihud", "hi52", "idio")


def terminals(xs, df: DataFrame, market: str = "mkt", group: str = "industry", year: int = 252) -> DataFrame:
    """17 dimensionless inputs, each sanitized and winsorised per date at 1% / 99%."""
    from ..functions.elementwise import div, sanitize

    c, o = F.col("close"), F.col("open")
    prev = ts.delay("close", 1)
    d = df.select("date", "entity", group, "open", "high", "low", "close", "volume", "dollar_volume", market)
    d = d.withColumns({
        "ret1": ts.simple_return("close", 1), "ret5": ts.simple_return("close", 5), "ret20": ts.simple_return("close", 20), "gap": div(o - prev, prev)})
    d = rolled(
        d, adv=roll("mean", "dollar_volume", 60, 20), _hi=roll("max", "high", 20), _lo=roll("min", "low", 20), _m20=roll("mean", "close", 20),
        _m60=roll("mean", "close", 60), _v20=roll("mean", "volume", 20), vol20=roll("std", "ret1", 20), beta60=roll("corr", ("ret1", market), 60),
        _top=roll("max", "close", year, min(120, year // 2)))
    d = d.select(
        "date", "entity", group, "ret1", "ret5", "ret20", "gap", "adv", "vol20", "beta60",
        div(c, "_m20").alias("c_ma20"), div(c, "_m60").alias("c_ma60"), div("high", "low").alias("hl"), div(c - o, o).alias("co"),
        div(c - F.col("_lo"), F.col("_hi") - F.col("_lo")).alias("stoch"), div("volume", "_v20").alias("v_ma20"),
        div("dollar_volume", "adv").alias("dv_adv"), (F.abs("ret1") / zero_to_null("dollar_volume") * 1e9).alias("amihud"), div(c, "_top").alias("hi52"))
    if xs.windowed:
        d = xs.rank_pct(d, "adv", "size")
        d = xs.demean(d, "ret1", "_n", group)
        idio = F.when(F.col(group).isNotNull(), F.col("_n")).otherwise(F.col("ret1"))
        return xs.winsor_all(d.withColumn("idio", idio).select("date", "entity", *[sanitize(t).alias(t) for t in TERMINALS]), TERMINALS, 0.01)
    own = [t for t in TERMINALS if t != "size"]
    clean = {t: sanitize(t) for t in own if t not in ("ret1", "idio")}  # before rows are stored, so that it happens once
    rows = xs.store(d.withColumns({**clean, "_row": F.monotonically_increasing_id()}))
    # the ranks' rows are narrow; the wide ones are dealt once, to meet them
    size = xs.ranks_side_by_side(rows.select(*xs.by, "_row", F.col("adv").alias("size")), ["size"], "pct")
    size = xs.store(size.select(*xs.by, "_row", sanitize("size").alias("size")))
    d = xs.demean(rows, "ret1", "_n", group, stored=True)
    d = d.withColumn("idio", F.when(F.col(group).isNotNull(), F.col("_n")).otherwise(F.col("ret1")))
    d = d.withColumns({t: sanitize(t) for t in ("ret1", "idio")}).select(*dict.fromkeys(["date", "entity", "_row", *xs.by]), *own)
    both = d.join(size.select("_row", "size"), "_row").select(*dict.fromkeys(["date", "entity", *xs.by]), *TERMINALS)
    return xs.winsor_all(both, TERMINALS, 0.01, [(d, own), (size, ["size"])])


def snapshot_and_sequence(df: DataFrame, market: DataFrame) -> DataFrame:
    """The 14 snapshot inputs (full windows) and the 4 sequence channels; ``market`` from market_frame.

    Sequence channels: ret_1d, vol_20d, volume_z_20d, rel_ret_1d.
    """
    m = market.select("date", F.col("ret_1d").alias("mkt_ret_1d"), F.col("ret_20d").alias("mkt_ret_20d"),
                      F.col("vol_20d").alias("mkt_vol_20d"))
    d = df.join(F.broadcast(m), "date", "left")  # one row per date
    d = d.withColumn("_down", F.least("ret", F.lit(0.0))).withColumn("_down", F.when(F.col("ret").isNotNull(), F.col("_down")))
    d = rolled(
        d.withColumns({"ret_1d": F.col("ret"), "_adj": F.col("volume") * zero_to_null("share_factor")}),
        **{f"ret_{w}d": roll("sum", "ret", w, w) for w in (5, 20, 60)}, mom_120d=roll("sum", "ret", 120, 120),
        **{f"vol_{w}d": roll("std", "ret", w, w) for w in (5, 20, 60)}, downside_vol_20d=roll("std", "_down", 20, 20),
        drawdown_60d=roll("drawdown", "ret", 59), _dv=roll("mean", "dollar_volume", 20, 20),
        _vm=roll("mean", "_adj", 20, 20), _vs=roll("std", "_adj", 20, 20))
    d = d.withColumns({
        "dollar_vol_20d": F.log("_dv"),
        "volume_z_20d": F.when(F.col("_vs") > 0, (F.col("_adj") - F.col("_vm")) / F.col("_vs"))}).drop("_adj", "_dv", "_vm", "_vs")
    return d.withColumns({
        "rel_ret_1d": F.col("ret_1d") - F.col("mkt_ret_1d"), "rel_ret_20d": F.col("ret_20d") - F.col("mkt_ret_20d"),
        "rel_vol_20d": F.col("vol_20d") / F.nullif(F.col("mkt_vol_20d"), F.lit(0.0))}).drop("_down")


def need(w: int, share: float = 0.8) -> int:
    """Observations a window of ``w`` needs: the share rounded up."""
    return max(1, math.ceil(share * w - 1e-9))


def momentum(r: str = "ret", fast=(5, 20), start: int = 251, end: int = 21) -> dict:
    """Trailing sums and the start..end momentum (as a sum ending ``end`` rows back)."""
    n = start - end + 1
    f = ts._w(None).rowsBetween(-start, -end)
    mom = F.when(F.count(r).over(f) >= need(n), F.sum(r).over(f))
    return {**{f"ret_{w}d": ts.sum_(r, w, need(w)) for w in fast}, "mom_12_1": mom}


def high_ratio(p: str, w: int = 252):
    return F.col(p) / F.nullif(ts.max_(p, w, need(w)), F.lit(0.0))


def beta_bab(df: DataFrame, out: str, r: str = "ret", m: str = "mkt", overlap: int = 3, corr_w: int = 1260,
             corr_min: int = 750, vol_w: int = 252) -> DataFrame:
    """Correlation of overlapping sums over a long window times the volatility ratio."""
    d = rolled(
        df, _r=roll("sum", r, overlap, overlap), _m=roll("sum", m, overlap, overlap), _corr=roll("corr", ("_r", "_m"), corr_w, corr_min),
        _sr=roll("std", r, vol_w, need(vol_w)), _sm=roll("std", m, vol_w, need(vol_w)))
    ratio = F.col("_sr") / F.nullif(F.col("_sm"), F.lit(0.0))
    return d.withColumn(out, F.col("_corr") * ratio).drop("_r", "_m", "_corr", "_sr", "_sm")


def amihud(df: DataFrame, out: str, r_simple: str, dollar_m: str, w: int = 126) -> DataFrame:
    """Mean absolute return per million traded, over rows with volume."""
    ok = (F.col("volume") > 0) & (F.col(dollar_m) > 0)
    d = df.withColumn("_il", F.when(ok, F.abs(r_simple) / F.nullif(F.col(dollar_m), F.lit(0.0))))
    return d.withColumn(out, ts.mean("_il", w, need(w))).drop("_il")


def seasonality(df: DataFrame, monthly: DataFrame, out: str, first: int = 2, last: int = 5) -> DataFrame:
    """Mean return of the next row's calendar month, ``first``..``last`` years back, all years needed.

    A month's return is listed under the target months it will serve, then one equi-join attaches it.
    """
    years = last - first + 1
    targets = monthly.where("ret is not null").select(
        "entity", "ret", F.explode(F.array(*[F.add_months("month", 12 * k) for k in range(first, last + 1)])).alias("_month"))
    seas = targets.groupBy("entity", "_month").agg(F.avg("ret").alias("_s"), F.count(F.lit(1)).alias("_n"))
    step = F.when(F.weekday("date") >= 4, 7 - F.weekday("date")).otherwise(1)
    d = df.withColumn("_month", F.trunc(F.date_add("date", step), "month"))
    return d.join(seas, ["entity", "_month"], "left").withColumn(
        out, F.when(F.col("_n") >= need(years), F.col("_s"))).drop("_month", "_s", "_n")


def coskew(df: DataFrame, out: str, x: str = "ret", y: str = "mkt", w: int = 21) -> DataFrame:
    """mean(x y^2) / (sx sy^2) with both centred inside the window.

    The window's pairs are kept as an array of at most ``w`` and centred before they are multiplied.
    """
    a, b = ts.pairwise(x, y)
    d = df.withColumn("_p", F.when(a.isNotNull(), F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))))
    d = d.withColumn("_w", F.collect_list("_p").over(ts.frame(w))).withColumn("_n", F.size("_w").cast("double"))

    def total(term):
        return F.aggregate("_w", F.lit(0.0), lambda acc, p: acc + term(p))

    d = d.withColumns({"_mx": total(lambda p: p["x"]) / F.nullif("_n", F.lit(0.0)), "_my": total(lambda p: p["y"]) / F.nullif("_n", F.lit(0.0))})
    cx, cy = lambda p: p["x"] - F.col("_mx"), lambda p: p["y"] - F.col("_my")
    d = d.withColumns({"_sxyy": total(lambda p: cx(p) * cy(p) * cy(p)), "_sxx": total(lambda p: cx(p) * cx(p)), "_syy": total(lambda p: cy(p) * cy(p))})
    scale = F.sqrt(F.col("_sxx") / F.nullif("_n", F.lit(0.0))) * F.col("_syy")
    return d.withColumn(out, F.when(F.col("_n") >= need(w), F.col("_sxyy") / F.nullif(scale, F.lit(0.0)))).drop(
        "_p", "_w", "_n", "_mx", "_my", "_sxyy", "_sxx", "_syy")


def ivol_capm(r: str = "ret", m: str = "mkt", w: int = 21):
    """Residual deviation of the window's regression on the market."""
    k = ts.moments(r, m, w, need(w))
    ssr = F.greatest(k["sxx"] - k["sxy"] * k["sxy"] / F.nullif(k["syy"], F.lit(0.0)), F.lit(0.0))
    return F.sqrt(ssr / F.nullif(k["n"] - 1, F.lit(0)))


def short_block(df: DataFrame, r: str = "ret", vol=(5, 60), w: int = 21, q: int = 5, ratio_w: int = 60,
                ma: int = 50, night: int = 20) -> DataFrame:
    """vol_shock, rskew, rmax, qspread, overnight, ma_gap, var_ratio and ret_vol_corr."""
    spread = F.when((F.col("bid") > 0) & (F.col("bid") <= F.col("ask")),
                    (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2))
    d = df.withColumns({
        "_s": F.expm1(r), "_sp": spread, "_on": F.col(r) - F.log(F.col("close") / F.col("open")),
        "_rq": ts.sum_(r, q, q), "_p": ts.price_index(F.expm1(r)), "_lv": F.when(F.col("volume") > 0, F.log("volume"))})
    z = lambda c: F.nullif(c, F.lit(0.0))
    d = d.withColumns({
        "vol_shock": ts.std(r, vol[0], need(vol[0])) / z(ts.std(r, vol[1], need(vol[1]))),
        "rskew": ts.skew(r, w, need(w)), "rmax1": ts.max_("_s", w, need(w)), "qspread": ts.mean("_sp", w, need(w)),
        "overnight": ts.sum_("_on", night, need(night)), "ma_gap": F.col("_p") / z(ts.mean("_p", ma, need(ma))) - 1.0,
        "var_ratio": ts.var("_rq", ratio_w, need(ratio_w)) / z(q * ts.var(r, ratio_w, need(ratio_w))),
        "ret_vol_corr": ts.corr(r, "_lv", ratio_w, need(ratio_w))})
    return d.drop("_s", "_sp", "_on", "_rq", "_p", "_lv")


def earnings_timing(rows: DataFrame, cal: DataFrame, reports: DataFrame, cycle: int = 364, ahead: int = 5) -> DataFrame:
    """Add ``days_since_earn`` and ``earn_next5`` from report dates known at each row.

    ``reports``: (entity, rdq_date). Days count from the first trading date after the latest report;
    an expected report is ``cycle`` days after a past one and counts when it falls within ``ahead``
    business days (a multiple of five, so a fixed number of calendar days on weekdays).
    """
    from .pit import asof_join, nth_trading_day_after, place_on_calendar, rows_inside

    if ahead % 5:
        raise ValueError("ahead must be a multiple of five business days")
    pos = cal.select("date", "pos")
    r = nth_trading_day_after(place_on_calendar(reports, cal, "rdq_date", "_known"), cal, "rdq_date", 1, "_event")
    ev = r.where("_event is not null").join(F.broadcast(pos.toDF("_event", "ev_pos")), "_event")
    ev = ev.groupBy("entity", "_event").agg(F.max("ev_pos").alias("ev_pos"))
    d = rows.join(F.broadcast(pos), "date", "left")
    d = asof_join(d, ev, "entity", "date", "_event")
    d = d.withColumn("days_since_earn", F.col("pos") - F.col("asof.ev_pos")).drop("asof", "pos")
    known = r.where("_known is not null").groupBy("entity").agg(F.min("_known").alias("_first"))
    days = ahead // 5 * 7
    due = r.select("entity", F.date_add("rdq_date", cycle - days).alias("_a"), F.date_add("rdq_date", cycle - 1).alias("_b")).distinct()
    near = rows_inside(d.select("entity", "date"), due, ["entity"], "date", "_a", "_b").withColumn("_near", F.lit(1.0))
    d = d.join(known, "entity", "left").join(near, ["entity", "date"], "left")
    return d.withColumn("earn_next5", F.when(F.col("date") >= F.col("_first"), F.coalesce("_near", F.lit(0.0)))).drop("_first", "_near")


def valuation_ratios(df: DataFrame, me: str) -> DataFrame:
    """be_me, ni_me and netdebt_me on the day, missing without positive market equity."""
    m = F.when(F.col(me) > 0, F.col(me))
    return df.withColumns({
        "be_me": F.when(F.col("be") > 0, F.col("be") / m), "ni_me": F.col("ni_ttm") / m, "netdebt_me": F.col("netdebt") / m})


def cross_section_inputs(xs, df: DataFrame, ranked, unranked, price_flagged, fund_flagged, within, sector: str,
                         weight: str, sector_codes, min_names: int) -> DataFrame:
    """Per-date inputs: industry signals, unit ranks, within-sector ranks, flags, 0-fill, dummies."""
    from ..functions.elementwise import sector_dummies
    from .crosssection import CrossSection
    from .universe import zero_fill

    s = CrossSection((*xs.by, sector), xs.bound)
    reads = dict.fromkeys(["date", "entity", *xs.by, sector, weight, "mom_12_1", "ret_20d", *ranked, *unranked, *price_flagged, *fund_flagged, *within])
    d = s.store(df.select(*reads))
    d = s.weighted_mean(df.select(*reads) if d is None else d, "mom_12_1", weight, "ind_mom_12_1", stored=True)
    d = s.weighted_mean(d, "ret_20d", weight, "_sr", stored=True)  # joined by group: what it adds up are stored columns
    d = d.withColumn("ret_20d_ind_rel", F.col("ret_20d") - F.col("_sr")).drop("_sr", *{weight} - {*ranked, *unranked, *price_flagged, *fund_flagged, *within})
    names = [*ranked, "ind_mom_12_1", "ret_20d_ind_rel"]
    d = xs.ranks_side_by_side(d.withColumnRenamed(sector, "sector"), names, "unit", within, "sector", min_names).withColumnRenamed("sector", sector)
    cols = [*names, *unranked, *[f"{c}_sector" for c in within]]
    d = zero_fill(d, cols, {"flag_price_missing": list(price_flagged), "flag_fund_missing": list(fund_flagged)})
    return d.select("date", "entity", *cols, *sector_dummies(sector, sector_codes),
                    F.col("flag_price_missing").cast("double").alias("flag_price_missing"),
                    F.col("flag_fund_missing").cast("double").alias("flag_fund_missing"))


def residual_target(df: DataFrame, market_forward: str, r: str = "ret", m: str = "mkt", w: int = 60, h: int = 5,
                    out: str = "fwd_resid") -> DataFrame:
    """Forward sum minus trailing beta times the market's forward sum."""
    return df.withColumn(out, ts.forward_sum(r, h) - ts.beta(r, m, w, w) * F.col(market_forward))


def market_cap(df: DataFrame, shares: str, raw_close: str, out: str = "mktcap") -> DataFrame:
    """Shares carried forward then backward per entity, times the unadjusted close."""
    d = df.withColumn("_f", ts.fill(shares)).withColumn("_f", F.coalesce("_f", ts.back_fill(shares)))
    return d.withColumn(out, F.col(raw_close) * F.col("_f")).drop("_f")


def training_table(xs, df: DataFrame, terms, universe, group: str, next_return: str, stress: str) -> DataFrame:
    """Rank-normalised terms and next-row industry-neutral return, complete rows, event weights.

    A missing feature column is refused, so every window scores the same list.
    """
    from .tradingcal import training_weight

    missing = [t for t in terms if t not in df.columns]
    if missing:
        raise KeyError(f"missing features {missing}")
    d = df.withColumns({"_g": F.col(group), "_y": F.when(universe, F.col(next_return)), **{t: F.when(universe, F.col(t)) for t in terms}})
    d = d.select(*dict.fromkeys(["date", "entity", *xs.by, "_g", *terms, "_y", stress]))
    d = d if xs.windowed else xs.store(d)
    d = xs.demean(d, "_y", "_yn", "_g", stored=True)
    if xs.windowed:
        d = xs.rank_centered(d, "_yn", "y")
        d = xs.ranks_side_by_side(d.select(*dict.fromkeys(["date", "entity", *xs.by, *terms, "y", stress])), terms, "centered")
    else:
        d = d.withColumnRenamed("_yn", "y").select(*dict.fromkeys(["date", "entity", *xs.by, *terms, "y", stress]))
        d = xs.ranks_side_by_side(d, [*terms, "y"], "centered")
    d = d.withColumn("weight", training_weight(stress))
    return d.select("date", "entity", *terms, "y", "weight").dropna(subset=[*terms, "y"])


def score_table(features: DataFrame, predictions: DataFrame, realised: str) -> DataFrame:
    """Keys, prediction and realised return, one row per (date, entity)."""
    p = predictions.select("date", "entity", "y_pred").dropDuplicates(["date", "entity"])
    return features.select("date", "entity", realised).join(p, ["date", "entity"], "left")


def dot_prediction(df: DataFrame, coefs: dict[str, float], out: str = "y_pred") -> DataFrame:
    """Linear score of the rows that have every feature."""
    total = F.lit(coefs.get("intercept", 0.0))
    for c, b in coefs.items():
        if c != "intercept":
            total = total + F.col(c) * b
    return df.withColumn(out, total)


def scoring_returns(rows: DataFrame, cal: DataFrame, last: str, horizon: int) -> DataFrame:
    """(entity, date, r): target returns up to ``horizon`` dates after the last scored date."""
    end = cal.where(F.col("date") <= F.lit(last).cast("date")).agg(F.max("pos").alias("p"))
    keep = cal.where(F.col("pos") <= end.select(F.col("p") + horizon).scalar()).select("date")
    return rows.join(F.broadcast(keep), "date", "left_semi").select("entity", "date", F.coalesce("ret", "fill_ret").alias("r"))
