"""Long-short books, decile backtests and dollar-neutral alpha books.

Turnover never joins a book with its predecessor: every holding adds +w at its formation position
and -w at the position where it is replaced, one aggregation nets the changes per (position, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elementwise import sanitize, zero_to_null
from ..session import materialize
from .crosssection import CrossSection
from .evaluate import quantile_legs
from ..sources.tables import by_entity
from .splits import calendar


def leg_weights(df: DataFrame, pred: str, q: int, bound: int | None = None) -> DataFrame:
    """Rows of the two legs with ``weight`` = +1/leg or -1/leg."""
    legs = quantile_legs(df, pred, q, bound=bound).where("leg <> 0")
    return legs.withColumn("weight", F.col("leg") / F.col("leg_size"))


def _with_position(df: DataFrame) -> DataFrame:
    """Attach the 0-based position of each date among the dates present (calendar-bounded)."""
    cal = calendar(df).select("date", (F.col("pos") - 1).alias("pos"), "n_dates")
    return df.join(F.broadcast(cal), "date")


def turnover(weights: DataFrame, hold: int = 1, scale: float = 0.5, factor: float = 1.0,
             key: str = "pos", size: str = "n_dates") -> DataFrame:
    """(pos, turnover): ``scale`` times the sum of absolute weight changes against the last book.

    ``weights``: (pos, entity, weight, n_dates); a holding formed at pos leaves at pos + hold.
    """
    steps = F.explode(F.array(
        F.struct(F.col(key).alias("p"), (F.col("weight") * factor).alias("dw")),
        F.struct((F.col(key) + hold).alias("p"), (-F.col("weight") * factor).alias("dw")),
    ))
    moves = weights.select("entity", size, steps.alias("m")).select("entity", size, "m.p", "m.dw")
    moves = moves.where(F.col("p") < F.col(size))
    net = moves.groupBy("p", "entity").agg(F.sum("dw").alias("dw"))
    return net.groupBy(F.col("p").alias(key)).agg((F.sum(F.abs("dw")) * scale).alias("turnover"))


def long_short_book(df: DataFrame, pred: str, y: str, q: int, horizon: int = 1,
                    scheme: str = "nonoverlapping", y_daily: str | None = None,
                    bound: int | None = None) -> DataFrame:
    """(date, gross, long, short, turnover), one row per period.

    ``nonoverlapping``: a book on every ``horizon``-th date earning ``y``. ``staggered``: a cohort
    per date at weight 1/h, each date earning the live cohorts' next-day returns (``y_daily``, an
    array of the h next returns). ``horizon`` 1 is the plain daily book.
    """
    if scheme not in ("nonoverlapping", "staggered"):
        raise ValueError(f"unknown scheme {scheme!r}")
    # the legs are written once; gross, turnover and the calendar all read that table
    cols = [c for c in (y, y_daily) if c]
    w = leg_weights(df.where(F.col(pred).isNotNull()), pred, q, bound)
    w = _with_position(materialize(w.select("date", "entity", "leg", "weight", *cols)))
    if scheme == "nonoverlapping":
        w = w.where(F.col("pos") % horizon == 0)
        w = w.withColumn("n_dates", F.ceil(F.col("n_dates") / horizon)).withColumn("pos", F.floor(F.col("pos") / horizon))
        legs = w.groupBy("pos", "date").agg(
            F.avg(F.when(F.col("leg") == 1, F.col(y))).alias("long"),
            (-F.avg(F.when(F.col("leg") == -1, F.col(y)))).alias("short"))
        tno = turnover(w.select("pos", "entity", "weight", "n_dates"))
    else:
        cells = [F.col(y)] if horizon == 1 else [F.col(y_daily)[m] for m in range(horizon)]
        aggs = []
        for m, c in enumerate(cells):
            aggs += [F.avg(F.when(F.col("leg") == 1, c)).alias(f"l{m}"),
                     (-F.avg(F.when(F.col("leg") == -1, c))).alias(f"s{m}")]
        cohorts = w.groupBy("pos", "n_dates").agg(*aggs)
        live = F.explode(F.array(*[
            F.struct((F.col("pos") + m).alias("p"), F.col(f"l{m}").alias("l"), F.col(f"s{m}").alias("s"))
            for m in range(horizon)]))
        pieces = cohorts.select("n_dates", live.alias("c")).where(F.col("c.p") < F.col("n_dates"))
        legs = pieces.groupBy(F.col("c.p").alias("pos")).agg(
            (F.sum("c.l") / horizon).alias("long"), (F.sum("c.s") / horizon).alias("short"))
        legs = legs.join(F.broadcast(w.select("pos", "date").distinct()), "pos")  # one row per date
        tno = turnover(w.select("pos", "entity", "weight", "n_dates"), horizon, factor=1.0 / horizon)
    out = legs.join(tno, "pos", "left")
    return out.select("date", (F.col("long") + F.col("short")).alias("gross"), "long", "short", "turnover")


def portfolio_summary(book: DataFrame, cost_rate: float = 0.0, by=()) -> DataFrame:
    """Mean gross / net, IRs and turnover; traded notional is twice the one-sided turnover."""
    b = book.withColumn("net", F.col("gross") - 2.0 * cost_rate * F.col("turnover"))
    return b.groupBy(*by).agg(
        F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"),
        F.stddev_samp("gross").alias("gross_std"),
        F.coalesce(F.avg("gross") / zero_to_null(F.stddev_samp("gross")), F.lit(0.0)).alias("ir_gross"),
        F.coalesce(F.avg("net") / zero_to_null(F.stddev_samp("net")), F.lit(0.0)).alias("ir_net"),
        F.avg("turnover").alias("mean_turnover"), F.count(F.lit(1)).alias("n_periods"),
    )


def decile_weights(df: DataFrame, pred: str, q: int, bound: int | None = None) -> DataFrame:
    """Rows with ``weight``: +1/k above rank n - n/q, -1/k up to rank n/q, 0 elsewhere.

    Ranks are ordinal (ties by entity); a date with fewer than q names holds nothing.
    """
    xs = CrossSection(("date",), bound)
    d = xs.ordinal(df, pred, "_o", "entity", "_n")
    share = F.col("_n") / q
    top, bottom = F.col("_o") > F.col("_n") - share, F.col("_o") <= share
    n_top, n_bottom = F.col("_n") - F.floor(F.col("_n") - share), F.floor(share)
    w = F.when(F.col("_n") < q, 0.0).when(bottom, -1.0 / n_bottom).when(top, 1.0 / n_top).otherwise(0.0)
    return d.withColumn("weight", w).drop("_o", "_n")


def decile_backtest(df: DataFrame, pred: str, realised: str, q: int = 10, cost_bps: float = 10.0,
                    bound: int | None = None) -> DataFrame:
    """(date, gross, turnover, pnl, equity): daily decile book with full-sum turnover and costs."""
    w = decile_weights(df.where(F.col(pred).isNotNull() & F.col(realised).isNotNull()), pred, q, bound)
    w = _with_position(materialize(w.select("date", "entity", "weight", realised)))
    gross = w.groupBy("pos", "date").agg(F.sum(F.col("weight") * F.col(realised)).alias("gross"))
    held = w.where("weight <> 0").select("pos", "entity", "weight", "n_dates")
    tno = turnover(held, scale=1.0)
    d = gross.join(tno, "pos", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    d = d.withColumn("pnl", F.col("gross") - F.col("turnover") * (cost_bps / 1e4))
    path = W.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("equity", F.exp(F.sum(F.log1p("pnl")).over(path))).drop("pos")


def backtest_summary(bt: DataFrame, cost_bps: float, annualization: int = 252) -> DataFrame:
    vol = F.stddev_samp("pnl") * F.sqrt(F.lit(float(annualization)))
    mean = F.avg("pnl") * annualization
    return bt.agg(
        F.count(F.lit(1)).alias("days"), mean.alias("ann_return"), zero_to_null(vol).alias("ann_vol"),
        (mean / zero_to_null(vol)).alias("sharpe"), F.avg("turnover").alias("avg_daily_turnover"),
        (F.avg("turnover") * (cost_bps / 1e4 * annualization)).alias("ann_cost_drag"),
        F.max_by("equity", "date").alias("final_equity"),
    )


# Scoring thresholds of the alpha fitness.
TRADING_DAYS = 252
MIN_DISPERSION = 1e-4
MIN_TURNOVER = 0.01
MIN_NUMSTK = 100
MIN_EFFECTIVE_N = 50
TVR_FLOOR = 0.05
COST_BPS = 5.0
IR_MIN = 0.07


def calendar_lag(x: str, pos: str, k: int = 1):
    """x of the same entity exactly k calendar positions earlier, missing when absent then."""
    out = None
    for j in range(1, k + 1):
        hit = F.when(F.lag(pos, j).over(by_entity()) == F.col(pos) - k, F.lag(x, j).over(by_entity()))
        out = hit if out is None else F.coalesce(out, hit)
    return out


def alpha_positions(df: DataFrame, alpha: str, universe, industry: str | None, winsor: float | None,
                    bound: int | None = None, stored: bool = False) -> DataFrame:
    """Add ``position``: masked, industry-neutral, (winsorised,) median-neutral, unit gross."""
    xs = CrossSection(("date",), bound)
    d = df.withColumn("_a", F.when(universe, sanitize(alpha)))
    if industry is not None:
        d = xs.demean(d, "_a", "_a2", industry, stored).drop("_a").withColumnRenamed("_a2", "_a")
    if winsor is not None:
        d = xs.winsor(d, "_a", "_a2", winsor).drop("_a").withColumnRenamed("_a2", "_a")
    return xs.unit_gross(d, "_a", "position").drop("_a")


def alpha_series(positions: DataFrame, ret: str, delay: int = 1) -> DataFrame:
    """(date, pnl, tvr, n_pos, eff_n): delayed PnL, turnover and holdings per date."""
    d = _with_position(materialize(positions.select("date", "entity", "position", ret)))
    d = d.withColumn("_held", calendar_lag("position", "pos", delay)).withColumn(
        "_prev", calendar_lag("position", "pos", 1))
    return d.groupBy("date").agg(
        F.sum(F.col("_held") * F.col(ret)).alias("pnl"),
        F.sum(F.abs(F.col("position") - F.col("_prev"))).alias("tvr"),
        F.count("position").alias("n_pos"),
        (1.0 / zero_to_null(F.sum(F.col("position") * F.col("position")))).alias("eff_n"),
    )


def alpha_report(series: DataFrame, trading_days: int = TRADING_DAYS, cost_bps: float = COST_BPS) -> DataFrame:
    """One row: ir, ret, tvr, ir_over_sqrt_tvr, net_ir, max_dd, numstk, ir_daily, days."""
    path = W.partitionBy(F.lit(0)).orderBy("date")
    nav = F.exp(F.sum(F.log1p("pnl")).over(path.rowsBetween(W.unboundedPreceding, 0)))
    d = series.withColumn("nav", nav)
    d = d.withColumn("dd", F.col("nav") / F.max("nav").over(path.rowsBetween(W.unboundedPreceding, 0)) - 1.0)
    net = F.when(F.col("pnl").isNotNull(),
                 F.col("pnl") - 0.5 * cost_bps * 1e-4 * F.coalesce("tvr", F.lit(0.0)))
    root = F.sqrt(F.lit(float(trading_days)))
    g = d.agg(
        (root * F.avg("pnl") / zero_to_null(F.stddev_samp("pnl"))).alias("ir"),
        (trading_days * F.avg("pnl")).alias("ret"), F.avg("tvr").alias("tvr"),
        (root * F.avg(net) / zero_to_null(F.stddev_samp(net))).alias("net_ir"),
        (-F.min(F.when(F.col("pnl").isNotNull(), F.col("dd")))).alias("max_dd"),
        F.avg("n_pos").alias("numstk"), F.count("pnl").alias("days"),
    )
    return g.withColumns({
        "ir_over_sqrt_tvr": F.col("ir") / F.sqrt(F.greatest(F.col("tvr"), F.lit(TVR_FLOOR))),
        "ir_daily": F.col("ir") / root,
    })


def alpha_fitness(df: DataFrame, alpha: str, ret: str, universe, industry: str | None, delay: int = 1,
                  min_numstk: float = MIN_NUMSTK, min_effective_n: float = MIN_EFFECTIVE_N,
                  trading_days: int = TRADING_DAYS, bound: int | None = None) -> DataFrame:
    """One row: ``fitness`` = IR / sqrt(turnover) with the soft gate; -1 for a degenerate alpha.

    The guards (dispersion, effective names, PnL days, holdings, turnover) are aggregates too, so a
    candidate is scored in one job and nothing is collected.
    """
    xs = CrossSection(("date",), bound)
    group = [industry] if industry else []
    df = materialize(df.select("date", "entity", alpha, ret, *group, universe.alias("_u")))
    universe = F.col("_u")
    raw = df.withColumn("_raw", F.when(universe, sanitize(alpha))).withColumn("_abs", F.abs("_raw"))
    spread = xs.quantiles(raw, "_abs", {"_scale": 0.5}, stored=True).join(
        raw.groupBy("date").agg(F.stddev_samp("_raw").alias("_sd"), F.count("_raw").alias("_cells")), "date")
    disp = spread.agg(
        F.percentile(F.coalesce(F.col("_sd") / zero_to_null("_scale"), F.lit(0.0)), F.lit(0.5)).alias("dispersion"),
        F.sum("_cells").alias("cells"))
    s = alpha_series(alpha_positions(df, alpha, universe, industry, 0.01, bound, stored=True), ret, delay)
    root = float(trading_days) ** 0.5
    g = s.agg(
        (F.lit(root) * F.avg("pnl") / zero_to_null(F.stddev_samp("pnl"))).alias("ir"),
        F.avg("tvr").alias("tvr"), F.avg("n_pos").alias("numstk"), F.avg("eff_n").alias("eff_n"),
        F.count("pnl").alias("days"),
    )
    both = g.withColumn("_k", F.lit(1)).join(F.broadcast(disp.withColumn("_k", F.lit(1))), "_k").drop("_k")
    daily = F.col("ir") / root
    score = F.col("ir") / F.sqrt(F.greatest(F.col("tvr"), F.lit(TVR_FLOOR)))
    gate = F.pow(F.greatest(daily, F.lit(0.0)) / IR_MIN, 2)
    bad = (
        (F.col("cells") < 100) | (F.col("dispersion") < MIN_DISPERSION) | F.col("eff_n").isNull()
        | (F.col("eff_n") < min_effective_n) | (F.col("days") < 100) | F.col("ir").isNull()
        | (F.col("numstk") < min_numstk) | F.col("tvr").isNull() | (F.col("tvr") < MIN_TURNOVER)
    )
    fitness = F.when(bad, -1.0).when(daily < IR_MIN, score * gate).otherwise(score)
    return both.withColumn("fitness", fitness)
