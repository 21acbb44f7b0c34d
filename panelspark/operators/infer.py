"""Multiple testing, Sharpe inference and the trial log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elementwise import norm_cdf, norm_ppf, zero_to_null
from ..session import materialize
from .crosssection import CrossSection, split_running
from .evaluate import long_run_variance

#: Fixed value: the Euler-Mascheroni constant.
EULER_GAMMA = 0.5772156649015329


def bonferroni(df: DataFrame, p: str, by, alpha: float = 0.05, bound: int | None = None) -> DataFrame:
    """Add ``adjusted`` = min(1, p N) and ``reject``; N is the family size."""
    d = CrossSection(tuple(by), bound).attach(df, _n=F.count(p))
    d = d.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")
    return d.withColumn("reject", F.col("adjusted") <= alpha)


def _running(df: DataFrame, p: str, by, keys, step, falling: bool, bound: int | None) -> DataFrame:
    """Positions by (p, keys) and the running extreme of the step, in a window for a family proven
    small, else range by range."""
    by = list(by)
    d = df.where(F.col(p).isNotNull())
    if not CrossSection(tuple(by), bound).windowed:
        return split_running(d, by, [p, *keys], step, "_run", falling)
    w = W.partitionBy(*by)
    o = w.orderBy(p, *keys)
    d = d.withColumns({"_i": F.row_number().over(o), "_n": F.count(F.lit(1)).over(w)})
    d = d.withColumn("_step", step(F.col("_i"), F.col("_n")))
    run = (F.min("_step").over(o.rowsBetween(0, W.unboundedFollowing)) if falling
           else F.max("_step").over(o.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("_run", run).drop("_step")


def holm(df: DataFrame, p: str, by, keys, alpha: float = 0.05, bound: int | None = None) -> DataFrame:
    """Step-down: (N - i + 1) p with a running maximum; ``keys`` break ties, missing p are left out."""
    d = _running(df, p, by, keys, lambda i, n: (n - i + 1) * F.col(p), False, bound)
    d = d.withColumn("adjusted", F.least(F.lit(1.0), F.col("_run"))).drop("_run", "_i", "_n")
    return d.withColumn("reject", F.col("adjusted") <= alpha)


def benjamini_hochberg(df: DataFrame, p: str, by, keys, alpha: float = 0.10, bound: int | None = None) -> DataFrame:
    """Step-up: q = running minimum from the largest p of p N / rank; rejects up to the last p below
    its line."""
    d = _running(df, p, by, keys, lambda i, n: F.col(p) * n / i, True, bound)
    hit = F.when(F.col(p) <= F.col("_i") / F.col("_n") * alpha, F.col("_i"))
    d = CrossSection(tuple(by), bound).attach(d, _last=F.max(hit))
    d = d.withColumn("adjusted", F.least(F.lit(1.0), F.col("_run")))
    return d.withColumn("reject", F.coalesce(F.col("_i") <= F.col("_last"), F.lit(False))).drop("_i", "_n", "_run", "_last")


def sharpe_table(series: DataFrame, value: str, lags: int, benchmark: float = 0.0,
                 by=("series",)) -> DataFrame:
    """Per series: Sharpe (population sd), skewness, kurtosis, effective sample size and PSR."""
    v = F.col(value)
    m = series.where(v.isNotNull()).groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.skewness(v).alias("skew"),
        (F.kurtosis(v) + 3.0).alias("kurt"))
    lrv = long_run_variance(series, value, lags, "uniform", by).select(*by, "n", "lrv", "gamma0")
    d = m.join(lrv, list(by)).withColumn("sharpe", F.col("mean") / zero_to_null("sd"))
    n = F.col("n").cast("double")
    ess = n if lags == 0 else F.when(
        F.col("lrv") > 0, F.least(n, n * F.col("gamma0") / F.col("lrv"))).otherwise(n)
    d = d.withColumn("ess", ess)
    return d.withColumn("psr", psr(F.col("sharpe"), F.lit(float(benchmark))))


def psr(sharpe: Column, benchmark: Column) -> Column:
    """P(true Sharpe above the benchmark), from the columns skew, kurt and ess of the row."""
    den = 1.0 - F.col("skew") * sharpe + (F.col("kurt") - 1.0) / 4.0 * sharpe * sharpe
    ok = (den > 0) & (F.col("ess") > 1)
    return F.when(ok, norm_cdf((sharpe - benchmark) * F.sqrt(F.col("ess") - 1.0) / F.sqrt(den)))


def expected_max_sharpe(n: Column, variance: Column) -> Column:
    """Expected best Sharpe of n unskilled trials with the given cross-trial variance (Bailey and Lopez de Prado, 2014):

    sqrt(V) ((1 - gamma) Z^-1(1 - 1/n) + gamma Z^-1(1 - 1/(n e))).
    """
    best = (1.0 - EULER_GAMMA) * norm_ppf(1.0 - 1.0 / n) + EULER_GAMMA * norm_ppf(1.0 - 1.0 / (n * math.e))
    return F.when((n > 1) & (variance != 0), F.sqrt(variance) * best).when(n.isNotNull() & variance.isNotNull(), 0.0)


def _with_one_row(rows: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates over the whole table, combined map-side into one row, on every row of it."""
    rows = materialize(rows)
    one = rows.agg(*[a.alias(k) for k, a in aggs.items()])
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


def deflated_sharpe(table: DataFrame) -> DataFrame:
    """``sharpe_table`` rows of one family: the hurdle from the family and each row's DSR."""
    d = _with_one_row(table, n_trials=F.count("sharpe").cast("double"), sr_variance=F.var_pop("sharpe"))
    d = d.withColumn("hurdle", expected_max_sharpe(F.col("n_trials"), F.col("sr_variance")))
    return d.withColumn("dsr", psr(F.col("sharpe"), F.col("hurdle")))


# ------------------------------------------------------------------ trial log

#: Provenance keys every trial must carry, and the reserved tag suffix.
PROVENANCE_KEYS = ("target_kind", "feature_set", "fold_scheme", "sample_window")
SELECTION_SUFFIX = "#selection"


def with_provenance(trials: DataFrame, **values: str) -> DataFrame:
    """Add the provenance entries to the ``config`` map of every trial."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return trials.withColumn("config", F.map_concat("config", F.create_map(*pairs)))


def trial_problems(trials: DataFrame) -> DataFrame:
    """Trials that may not be logged, each with its ``problem``."""
    keys = F.map_keys("config")
    missing = F.exists(F.array(*[F.lit(k) for k in PROVENANCE_KEYS]), lambda k: ~F.array_contains(keys, k))
    bad = F.exists(F.map_values("metrics"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    problem = (
        F.when(missing, "missing provenance").when(F.contains("tag", F.lit(SELECTION_SUFFIX)), "reserved tag")
        .when(bad, "non-finite metric"))
    return trials.withColumn("problem", problem).where("problem is not null")


def valid_trials(trials: DataFrame) -> DataFrame:
    return trials.join(trial_problems(trials).select("trial_id"), "trial_id", "left_anti")


def append_trials(trials: DataFrame, path: str) -> None:
    """Append trials to the log table; refuses any invalid row before writing one."""
    bad = trial_problems(trials).select("trial_id", "problem").first()
    if bad is not None:
        raise ValueError(f"trial {bad['trial_id']}: {bad['problem']}")
    trials.write.mode("append").parquet(path)


def select_best(trials: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """One selection row per tag: winner, its metric, the candidate count and its provenance."""
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be max or min, got {mode!r}")
    m = F.col("metrics")[metric]
    d = trials.where(~F.contains("tag", F.lit(SELECTION_SUFFIX)) & m.isNotNull())
    order = F.struct(m if mode == "max" else -m, -F.col("trial_id"))
    return d.groupBy("tag").agg(
        F.max_by("trial_id", order).alias("selected_trial_id"), F.max_by(m, order).alias("metric"),
        F.count(F.lit(1)).alias("n_candidates"), F.max_by("config", order).alias("config"),
    ).select(F.concat("tag", F.lit(SELECTION_SUFFIX)).alias("tag"), "selected_trial_id", "metric", "n_candidates", "config")


def across_seeds(rows: DataFrame, by, value: str) -> DataFrame:
    """(by, mean, sd, n): mean and sample deviation over the seeds that report a value."""
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.count(value).alias("n"))


def candidate_winner(rows: DataFrame, candidate: str, value: str, mode: str = "max") -> DataFrame:
    """Per candidate mean and sd over seeds and folds, with the winner flagged and the count; ties go to the first name.

    Candidates without any value can't win.
    """
    g = across_seeds(rows, (candidate,), value)
    key = F.struct((-F.col("mean") if mode == "max" else F.col("mean")).alias("m"), F.col(candidate).alias("c"))
    d = _with_one_row(g, _best=F.min(F.when(F.col("mean").isNotNull(), key)), n_candidates=F.count(F.lit(1)))
    return d.withColumn("winner", F.coalesce(F.col(candidate).eqNullSafe(F.col("_best.c")) & F.col("_best").isNotNull(), F.lit(False))).drop("_best")


def selection_table(rows: DataFrame, setting: str, fold: str, loss: str) -> DataFrame:
    """(setting, mean_loss, sd_loss, runs, se, within_one_se): settings within one standard error of
    the best mean loss are marked."""
    g = rows.groupBy(setting).agg(
        F.avg(loss).alias("mean_loss"), F.coalesce(F.stddev_samp(loss), F.lit(0.0)).alias("sd_loss"),
        F.count(loss).alias("runs"))
    g = g.withColumn("se", F.col("sd_loss") / F.sqrt(F.nullif("runs", F.lit(0))))
    d = _with_one_row(g, _b=F.min(F.when(F.col("mean_loss").isNotNull(), F.struct("mean_loss", "se"))))
    return d.withColumn("within_one_se", F.col("mean_loss") <= F.col("_b.mean_loss") + F.col("_b.se")).drop("_b")


def selection_deviations(chosen: DataFrame, given: DataFrame) -> DataFrame:
    """(field, chosen, given) for chosen settings that the given settings set differently."""
    d = chosen.join(given, "field", "left")
    return d.where(~F.col("chosen").eqNullSafe(F.col("given")))


def fingerprint(df: DataFrame, entity: str = "entity", date: str = "date", value: str = "ret") -> DataFrame:
    """One row: rows, dates, entities, date range and an order-free checksum of the target."""
    text = F.concat_ws("|", date, F.col(entity).cast("string"), F.round(F.col(value) * 1e6).cast("bigint").cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(date).alias("dates"),
        F.countDistinct(entity).alias("entities"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"), F.sum(h).cast("string").alias("checksum"))


def predictive_scores(probs: DataFrame, folds: DataFrame, worst: int, by=("series",)) -> DataFrame:
    """Per candidate and fold: the sum of one-step log densities on the fold's dates, and the part
    of its ``worst`` dates."""
    d = probs.join(F.broadcast(folds.select("test_year", "date")), "date")  # one row per date
    w = W.partitionBy(*by, "test_year").orderBy("log_c", "date")
    d = d.withColumn("_k", F.row_number().over(w))
    return d.groupBy(*by, "test_year").agg(
        F.sum("log_c").alias("score"), F.sum(F.when(F.col("_k") <= worst, F.col("log_c"))).alias("worst"),
        F.count(F.lit(1)).alias("dates"))
