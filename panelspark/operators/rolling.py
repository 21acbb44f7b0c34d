"""Per-entity (time-series) operators as Column expressions.

Every builder takes the window ``over`` (None: partition by ``entity``, order by ``date``). All
expressions of one select share that spec, so Spark shuffles and sorts the panel once. Panels hold
one row per (entity, date); one window partition is therefore bounded by the calendar.
"""

from __future__ import annotations

from math import comb

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.elementwise import col, div, zero_to_null
from ..sources.tables import by_entity


def default_min_obs(w: int) -> int:
    return max(2, w // 2)


def _w(over):
    return by_entity() if over is None else over


def frame(w: int, over=None):
    return _w(over).rowsBetween(-(w - 1), 0)


def _rolled(agg: Column, x, w: int, min_obs: int | None, over) -> Column:
    f = frame(w, over)
    need = default_min_obs(w) if min_obs is None else min_obs
    return F.when(F.count(col(x)).over(f) >= need, agg.over(f))


def mean(x, w, min_obs=None, over=None) -> Column:
    return _rolled(F.avg(col(x)), x, w, min_obs, over)


def sum_(x, w, min_obs=None, over=None) -> Column:
    return _rolled(F.sum(col(x)), x, w, min_obs, over)


def max_(x, w, min_obs=None, over=None) -> Column:
    return _rolled(F.max(col(x)), x, w, min_obs, over)


def min_(x, w, min_obs=None, over=None) -> Column:
    return _rolled(F.min(col(x)), x, w, min_obs, over)


def std(x, w, min_obs=None, over=None) -> Column:
    return _rolled(F.stddev_samp(col(x)), x, w, min_obs, over)


def var(x, w, min_obs=None, over=None) -> Column:
    return _rolled(F.var_samp(col(x)), x, w, min_obs, over)


def quantile(x, w, q=0.5, min_obs=None, over=None) -> Column:
    return _rolled(F.percentile(col(x), F.lit(q)), x, w, min_obs, over)


def median(x, w, min_obs=None, over=None) -> Column:
    return quantile(x, w, 0.5, min_obs, over)


def skew(x, w, min_obs=None, over=None) -> Column:
    """Bias-corrected sample skewness (Spark's aggregate is the population form)."""
    f = frame(w, over)
    n = F.count(col(x)).over(f)
    need = max(3, default_min_obs(w) if min_obs is None else min_obs)
    g = F.skewness(col(x)).over(f)
    return F.when(n >= need, g * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))


def delay(x, n, over=None) -> Column:
    return F.lag(col(x), n).over(_w(over))


def delta(x, n, over=None) -> Column:
    return col(x) - delay(x, n, over)


def simple_return(x, n=1, over=None) -> Column:
    return div(x, delay(x, n, over)) - 1.0


def log_return(x, over=None) -> Column:
    return F.log(col(x)) - F.log(delay(x, 1, over))


def diff(x, n, over=None) -> Column:
    """n-th discrete difference: the alternating binomial sum of lags."""
    out = col(x)
    for k in range(1, n + 1):
        out = out + F.lit(float((-1) ** k * comb(n, k))) * delay(x, k, over)
    return out


def fill(x, over=None) -> Column:
    return F.last(col(x), ignorenulls=True).over(_w(over).rowsBetween(W.unboundedPreceding, 0))


def back_fill(x, over=None) -> Column:
    return F.first(col(x), ignorenulls=True).over(_w(over).rowsBetween(0, W.unboundedFollowing))


def zscore(x, w, min_obs=None, over=None) -> Column:
    return (col(x) - mean(x, w, min_obs, over)) / zero_to_null(std(x, w, min_obs, over))


def norm(x, w, min_obs=None, over=None) -> Column:
    return col(x) - mean(x, w, min_obs, over)


def std_normalized(x, w, min_obs=None, over=None) -> Column:
    return col(x) / zero_to_null(std(x, w, min_obs, over))


def rank(x, w, min_obs=None, pct: bool = False, over=None) -> Column:
    """Average-tie rank of today's value among the window's values."""
    x = col(x)
    values = F.collect_list(x).over(frame(w, over))
    n = F.size(values)
    below = F.size(F.filter(values, lambda v: v < x))
    ties = F.size(F.filter(values, lambda v: v == x))
    r = below + (ties + 1) / 2.0
    if pct:
        r = r / n
    need = default_min_obs(w) if min_obs is None else min_obs
    return F.when(x.isNotNull() & (n >= need), r)


def corr(a, b, w, min_obs=None, over=None) -> Column:
    """Pearson correlation over the rows of the window where both are present.

    Written with covariance and deviations: ``corr`` itself raises on a constant window under ANSI.
    """
    a, b = pairwise(a, b)
    f = frame(w, over)
    need = default_min_obs(w) if min_obs is None else min_obs
    ok = (
        (F.count(a).over(f) >= max(2, need))
        & (F.max(a).over(f) > F.min(a).over(f))
        & (F.max(b).over(f) > F.min(b).over(f))
    )
    scale = zero_to_null(F.stddev_pop(a).over(f) * F.stddev_pop(b).over(f))
    return F.when(ok, F.covar_pop(a, b).over(f) / scale)


def pairwise(a, b) -> tuple[Column, Column]:
    """Both columns, each missing where the other is."""
    a, b = col(a), col(b)
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def beta(y, x, w, min_obs=None, over=None) -> Column:
    """Slope of y on x over the window's complete pairs."""
    y, x = pairwise(y, x)
    f = frame(w, over)
    need = w if min_obs is None else min_obs
    ok = (F.count(y).over(f) >= max(2, need)) & (F.max(x).over(f) > F.min(x).over(f))
    return F.when(ok, F.covar_samp(y, x).over(f) / zero_to_null(F.var_samp(x).over(f)))


def moments(x, y, w, min_obs=None, over=None) -> dict[str, Column]:
    """Pairwise-complete n, means and centred sums Sxx, Syy, Sxy of a window."""
    a, b = pairwise(x, y)
    f = frame(w, over)
    n = F.count(a).over(f)
    need = default_min_obs(w) if min_obs is None else min_obs
    ok = n >= need
    return {
        "n": F.when(ok, n),
        "mean_x": F.avg(a).over(f),
        "mean_y": F.avg(b).over(f),
        "sxx": F.when(ok, F.var_pop(a).over(f) * n),
        "syy": F.when(ok, F.var_pop(b).over(f) * n),
        "sxy": F.when(ok, F.covar_pop(a, b).over(f) * n),
    }


def harmonic_mean(x, w, min_obs=None, over=None) -> Column:
    inv = 1.0 / zero_to_null(x)
    f = frame(w, over)
    need = default_min_obs(w) if min_obs is None else min_obs
    return F.when(F.count(inv).over(f) >= need, F.count(inv).over(f) / zero_to_null(F.sum(inv).over(f)))


def argmax(x, w, pos="pos", over=None) -> Column:
    """Rows since the window's maximum; the latest of equal maxima counts.

    ``pos`` is the row-number column of the same window spec.
    """
    x, pos = col(x), col(pos)
    best = F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), pos.alias("p")))).over(frame(w, over))
    return pos - best["p"]


def weighted_lags(x, weights, over=None) -> Column:
    """Weighted mean of x, lag 1 of x, ...; ``weights`` starts with today's weight."""
    total = float(sum(weights))
    out = None
    for k, wt in enumerate(weights):
        term = (col(x) if k == 0 else delay(x, k, over)) * F.lit(wt / total)
        out = term if out is None else out + term
    return out


def linear_weights(w: int) -> list[int]:
    return list(range(w, 0, -1))


def drawdown(ret, w, over=None) -> Column:
    """Drawdown of the window's compounded path at its last row; missing if any return is.

    With cumulative sums c_1..c_w the value is exp(c_w - max(0, max c)) - 1.
    """
    f = frame(w, over)
    values = F.collect_list(col(ret)).over(f)
    path = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("peak")),
        lambda s, r: F.struct((s["c"] + r).alias("c"), F.greatest(s["peak"], s["c"] + r).alias("peak")),
        lambda s: F.exp(s["c"] - s["peak"]) - 1.0,
    )
    return F.when(F.count(col(ret)).over(f) == w, path)


def volume_z(volume, share_factor, w, min_obs=None, over=None) -> Column:
    """z-score of today's volume with every volume on today's share basis.

    Rescaling all window volumes by the same 1 / F_t leaves a z-score unchanged, so the z-score of
    volume * factor is the split-invariant value.
    """
    v = col(volume) * zero_to_null(share_factor)
    s = std(v, w, min_obs, over)
    return F.when(s > 0, (v - mean(v, w, min_obs, over)) / s)


def forward_sum(x, h, lag: int = 0, over=None) -> Column:
    """Sum over rows t+lag+1 .. t+lag+h, missing if any of them is."""
    f = _w(over).rowsBetween(1 + lag, h + lag)
    return F.when(F.count(col(x)).over(f) == h, F.sum(col(x)).over(f))


def forward_log_return(close, h, over=None) -> Column:
    return F.log(F.lead(col(close), h).over(_w(over))) - F.log(col(close))


def forward_returns(x, h, lag: int = 0, over=None) -> Column:
    """Array of the next h values (missing entries stay NULL)."""
    return F.array(*[F.lead(col(x), k + lag).over(_w(over)) for k in range(1, h + 1)])


def forward_any(flag, h, over=None) -> Column:
    """True when any of the next h rows carries the flag."""
    f = _w(over).rowsBetween(1, h)
    return F.coalesce(F.max(col(flag).cast("int")).over(f) == 1, F.lit(False))


def price_index(ret_simple, over=None) -> Column:
    """Cumulative product of 1 + r over the rows that have r; missing on a row without."""
    r = col(ret_simple)
    total = F.sum(F.coalesce(F.log1p(r), F.lit(0.0))).over(_w(over).rowsBetween(W.unboundedPreceding, 0))
    return F.when(r.isNotNull(), F.exp(total))


def running_max(x, over=None) -> Column:
    return F.max(col(x)).over(_w(over).rowsBetween(W.unboundedPreceding, 0))


def nav_drawdown(nav, over=None) -> Column:
    return col(nav) / running_max(nav, over) - 1.0


def sequence_window(fields, w, over=None, pad: bool = False) -> Column:
    """The last w rows of the fields as an array of arrays, oldest first.

    Short histories are missing, or front-padded with the earliest row when ``pad``.
    """
    item = F.array(*[F.coalesce(col(f), F.lit(float("nan"))) for f in fields])
    rows = F.collect_list(item).over(frame(w, over))
    if pad:
        return F.concat(F.array_repeat(rows[0], w - F.size(rows)), rows)
    return F.when(F.size(rows) == w, rows)


def rate(x, k, over=None) -> Column:
    return div(x, delay(x, k, over))


def mean_residual(x, k, over=None) -> Column:
    """x minus the mean of the k earlier rows (today excluded)."""
    return col(x) - F.avg(col(x)).over(_w(over).rowsBetween(-k, -1))


def ewm_mean(df, x: str, span: int, out: str, min_obs: int | None = None,
             entity: str = "entity", date: str = "date"):
    """Exponentially weighted mean, span w, weights (1 - a)^age with a = 2 / (w + 1).

    A missing value ages both sums and contributes to neither. The recursion is a scan by blocks of an entity's years: inside a block the sums
    of values over their decay, scaled back, are plain running sums; the blocks' last sums, decayed over the rows between, give what each
    block inherits. An entity's rows are spread over its years, and nothing leaves the JVM. Panels hold one row for each date, so a
    block has at most 366 rows, far from the range of a double; a block of more than ``_BLOCK_ROWS`` rows ends the query.
    """
    need = default_min_obs(span) if min_obs is None else min_obs
    keep = 1.0 - 2.0 / (span + 1.0)
    df = df.drop(out)
    if span == 1:
        seen = F.count(x).over(W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, 0))
        return df.withColumn(out, F.when(seen >= need, F.col(x).cast("double")))
    over = W.partitionBy(entity, "_block").orderBy(date)
    run = over.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.trunc(date, "year")).withColumn("_pos", F.row_number().over(over))
    small = F.when(F.col("_pos") <= _BLOCK_ROWS, F.col("_pos")).otherwise(F.raise_error(F.lit(f"more than {_BLOCK_ROWS} rows of one entity in a year")).cast("int"))
    grown, left = F.pow(F.lit(1.0 / keep), small), F.pow(F.lit(keep), F.col("_pos"))
    value = F.col(x).cast("double")
    rows = rows.withColumns({
        "_num": left * F.coalesce(F.sum(value * grown).over(run), F.lit(0.0)),
        "_den": left * F.coalesce(F.sum(F.when(value.isNotNull(), grown)).over(run), F.lit(0.0)),
        "_seen": F.count(x).over(run)})
    ends = rows.groupBy(entity, "_block").agg(
        F.max("_pos").alias("n"), F.max_by("_num", "_pos").alias("num"), F.max_by("_den", "_pos").alias("den"), F.max("_seen").alias("seen"))
    earlier = F.collect_list(F.struct("n", "num", "den", "seen")).over(
        W.partitionBy(entity).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    nothing = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(0).cast("long").alias("seen"))
    inherited = F.aggregate(earlier, nothing, lambda a, b: F.struct(
        (a["num"] * F.pow(F.lit(keep), b["n"]) + b["num"]).alias("num"), (a["den"] * F.pow(F.lit(keep), b["n"]) + b["den"]).alias("den"), (a["seen"] + b["seen"]).alias("seen")))
    ends = ends.select(F.col(entity).alias("_e"), F.col("_block").alias("_b"), inherited.alias("_in"))
    joined = rows.join(ends, F.col(entity).eqNullSafe(F.col("_e")) & F.col("_block").eqNullSafe(F.col("_b")))
    num, den = F.col("_num") + F.col("_in.num") * left, F.col("_den") + F.col("_in.den") * left
    mean_ = F.when((F.col("_seen") + F.col("_in.seen") >= need) & (den > 0), num / den)
    return joined.select(*df.columns, mean_.alias(out))


#: Rows of an entity's year: the shortest span, 2, grows by 3 a row, so this many stay below 1e250.
_BLOCK_ROWS = 520
