"""Regime probabilities at given parameters and everything scored against them.

A date series has one row per date, so per-series windows and arrays are bounded by the calendar;
many series (sectors, candidates, entities) run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.elementwise import col, hard_split, p_value, zero_to_null
from ..session import materialize
from .evaluate import kish, long_run_variances, overlap_kernels, safe_corr

CALM_STRESS = ("calm", "stress")


def _add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def date_level_series(panel: DataFrame, value: Column, calendar_dates: DataFrame | None = None) -> DataFrame:
    """(date, value): the mean over each date; with a calendar, every date must have a finite value."""
    s = panel.groupBy("date").agg(F.avg(value).alias("value"))
    if calendar_dates is not None:
        s = calendar_dates.select("date").join(s, "date", "left")
        bad = F.col("value").isNull() | F.isnan("value")
        s = s.withColumn("value", F.when(bad, F.raise_error(F.lit("missing or non-finite date value")))
                         .otherwise(F.col("value")))
    return s


def regime_filter(series: DataFrame, means, variances, transition, initial, states=CALM_STRESS,
                  by=("series",), order: str = "date", value: str = "value", horizon: int = 1) -> DataFrame:
    """(by, order, <states>, log_c): filtered probabilities and one-step log predictive density.

    With a target known ``horizon`` dates later a date's prior is the posterior from ``horizon`` of its series' dates back, taken as
    many steps ahead; the first ``horizon`` dates start from the initial distribution.

    The recursion is a product of K x K matrices, so it is scanned by blocks: a series' year is one row of arrays, the product over a
    block is taken for all blocks of an Arrow batch at once, the starts of a series' blocks follow from these products, and all blocks
    are filtered from their starts side by side. A long series is spread over its years. ``order`` is a date; K and ``horizon`` are small literals.
    """
    if horizon < 1:
        raise ValueError(f"the filter needs a horizon >= 1, got {horizon}")
    mean, variance, first = (np.asarray(v, dtype=float) for v in (means, variances, initial))
    ahead, k = np.linalg.matrix_power(np.asarray(transition, dtype=float), horizon), len(states)
    schema = series.schema
    keys = [T.StructField(c, schema[c].dataType) for c in by]
    block = F.trunc(order, "year").alias("_block")
    plain = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias(value), block)
    blocks = plain.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("v")))).alias("_rows"))
    products = blocks.select(*by, "_block", F.transform("_rows", lambda r: r["v"]).alias("_v")).mapInArrow(
        _block_products(mean, variance, ahead, horizon), T.StructType([*keys, T.StructField("_block", T.DateType()), T.StructField("_n", T.LongType()), T.StructField("_product", T.ArrayType(T.DoubleType()))]))
    starts = products.groupBy(*by).applyInArrow(
        _block_starts(first, horizon), T.StructType([*keys, T.StructField("_block", T.DateType()), T.StructField("_start", T.ArrayType(T.DoubleType()))]))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_block")])
    both = blocks.alias("l").join(starts.alias("r"), same).select(*[f"l.{c}" for c in by], "_rows", "_start")
    fields = [*keys, T.StructField(order, schema[order].dataType), *[T.StructField(c, T.DoubleType()) for c in (*states, "log_c")]]
    return both.mapInArrow(_filter_blocks(mean, variance, ahead, horizon, by, k), T.StructType(fields)).toDF(*by, order, *states, "log_c")


def _likelihoods(values: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities of each value under each state over the largest of them, and the logarithm of that one."""
    logs = -0.5 * ((values[..., None] - mean) ** 2 / variance + np.log(2.0 * math.pi * variance))
    peak = logs.max(axis=-1)
    return np.exp(logs - peak[..., None]), peak


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column as a rectangle, zeros behind, with the lengths and the mask of what is there."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    there = np.arange(int(sizes.max(initial=0))) < sizes[:, None]
    out = np.zeros(there.shape)
    out[there] = column.flatten().to_numpy(zero_copy_only=False)
    return out, sizes, there


def _block_products(mean, variance, ahead, horizon: int):
    """For each block and each of the ``horizon`` chains inside it, the product of its steps: rows scaled apart, with the logarithm of their scale."""
    k = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, there = _padded(batch.column("_v"))
            n = len(sizes)
            weight = _likelihoods(values, mean, variance)[0]
            product, scale = np.tile(np.eye(k), (n, horizon, 1, 1)), np.zeros((n, horizon, k))
            for t in range(values.shape[1]):
                live, chain = there[:, t], t % horizon
                step = (product[live, chain] * weight[live, t][:, None, :]) @ ahead
                top = step.max(axis=2)
                product[live, chain] = step / np.where(top > 0, top, 1.0)[:, :, None]
                scale[live, chain] += np.log(np.where(top > 0, top, 1.0))
            flat = np.concatenate([product, scale[..., None]], axis=3).reshape(n, -1)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            kept = [c for c in batch.schema.names if c != "_v"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sizes), arrays], names=[*kept, "_n", "_product"])
    return products


def _block_starts(initial, horizon: int):
    """The priors with which each chain enters each block of a series, in the order of the block's own rows."""
    k = len(initial)

    def starts(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        chains, offset, out = np.tile(initial, (horizon, 1)), 0, []
        for n, flat in zip(table.column("_n").to_pylist(), table.column("_product").to_pylist()):
            turn = (offset + np.arange(horizon)) % horizon
            out.append(chains[turn].ravel().tolist())
            parts = np.asarray(flat).reshape(horizon, k, k + 1)
            for chain in range(min(horizon, n)):
                rows, scale = parts[chain, :, :k], parts[chain, :, k]
                weighted = chains[turn[chain]] * np.exp(scale - scale.max())
                after = weighted @ rows
                chains[turn[chain]] = after / after.sum()
            offset += n
        return table.drop_columns(["_n", "_product"]).append_column("_start", pa.array(out, pa.list_(pa.float64())))
    return starts


def _filter_blocks(mean, variance, ahead, horizon: int, by, k: int):
    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_rows")
            inside = rows.flatten()
            dates = inside.field("at")
            values, sizes, there = _padded(pa.ListArray.from_arrays((rows.offsets.to_numpy() - rows.offsets[0].as_py()).astype(np.int32), inside.field("v")))
            n = len(sizes)
            prior = batch.column("_start").flatten().to_numpy(zero_copy_only=False).reshape(n, horizon, k).copy()
            weight, peak = _likelihoods(values, mean, variance)
            posterior, total = np.empty((*values.shape, k)), np.empty(values.shape)
            for t in range(values.shape[1]):
                joint = prior[:, t % horizon] * weight[:, t]
                total[:, t] = joint.sum(axis=1)
                posterior[:, t] = joint / total[:, t, None]
                prior[:, t % horizon] = posterior[:, t] @ ahead
            again = pa.array(np.repeat(np.arange(n), sizes))
            found = [*[batch.column(c).take(again) for c in by], dates, *[pa.array(posterior[there][:, i]) for i in range(k)], pa.array((np.log(total) + peak)[there])]
            yield pa.RecordBatch.from_arrays(found, names=[f"c{i}" for i in range(len(found))])
    return filtered


def gate_weights(probs: DataFrame, transition, kind: str, horizon: int = 1, states=CALM_STRESS) -> DataFrame:
    """Replace the filtered probabilities by the gate's weights.

    ``filtered``: xi; ``predicted``: xi A; ``window``: the mean of xi A^j over j = 1..h. The matrix
    is a literal, so every kind is one linear combination per state.
    """
    a = np.asarray(transition, dtype=float)
    if kind == "filtered":
        m = np.eye(len(a))
    elif kind == "predicted":
        m = a
    elif kind == "window":
        if horizon < 1:
            raise ValueError(f"window weights need a horizon >= 1, got {horizon}")
        m = sum(np.linalg.matrix_power(a, j) for j in range(1, horizon + 1)) / horizon
    else:
        raise ValueError(f"unknown gate weight {kind!r}")
    mixed = {n: _add([F.col(o) * float(m[j][i]) for j, o in enumerate(states)]) for i, n in enumerate(states)}
    return probs.withColumns(mixed)


def regime_summary(probs: DataFrame, states=CALM_STRESS, threshold: float = 0.5, by=("series",)) -> DataFrame:
    """Per series: dates, share most likely and mean probability of each state, stress share."""
    best = F.greatest(*[F.col(s) for s in states])
    first = F.lit(None).cast("string")
    for s in reversed(states):
        first = F.when(F.col(s) == best, F.lit(s)).otherwise(first)
    d = probs.withColumn("_m", first)
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *[F.avg((F.col("_m") == s).cast("double")).alias(f"share_{s}") for s in states],
        *[F.avg(s).alias(f"mean_{s}") for s in states],
        F.avg((F.col(states[-1]) > threshold).cast("double")).alias("stress_share"),
    )


def trailing_vol(series: DataFrame, w: int, by=("series",), value: str = "value") -> DataFrame:
    spec = W.partitionBy(*by).orderBy("date").rowsBetween(-(w - 1), 0)
    return series.withColumn("vol", F.when(F.count(value).over(spec) == w, F.stddev_samp(value).over(spec)))


def trailing_vol_state(series: DataFrame, w: int, by=("series",), value: str = "value") -> DataFrame:
    """Add ``vol``, ``threshold`` (median of the series' vols) and ``state`` (1 above it)."""
    d = trailing_vol(series, w, by, value)
    d = d.withColumn("threshold", F.percentile("vol", F.lit(0.5)).over(W.partitionBy(*by)))
    return d.withColumn("state", F.when(F.col("vol").isNotNull(), (F.col("vol") > F.col("threshold")).cast("int")))


def earlier_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the number of earlier ones that are strictly smaller, by merging sorted blocks: O(T log^2 T), no step for each value.

    Blocks of 1, 2, 4 ... values: each value of a right half counts the smaller ones of the left half beside it.
    """
    n = len(values)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    found, place = np.zeros(n, np.int64), np.arange(n)
    size = 1
    while size < n:
        # by pair of blocks, then rank; of equal ones the right half first, so that a left one counts only for larger ones
        order = np.lexsort((place // size % 2 == 0, ranks, place // (2 * size)))
        left = (place[order] // size % 2 == 0).astype(np.int64)
        before = np.cumsum(left)
        pair = place[order] // (2 * size)
        begin = np.searchsorted(pair, pair)
        before -= np.where(begin > 0, before[begin - 1], 0)
        right = left == 0
        found[order[right]] += before[right]
        size *= 2
    return found


def causal_vol_assignment(series: DataFrame, w: int, calm_share: float, k: int, min_history: int,
                          by=("series",), value: str = "value") -> DataFrame:
    """Add ``regime`` by trailing volatility against expanding quantiles; -1 until there is history.

    A volatility is among those that its quantile is taken of, so it lies above the interpolated quantile at c exactly if more
    than floor((n - 1) c) of the n volatilities so far are smaller: one rank a date replaces all cuts. Ranks come from
    merged sorted blocks, a series' dates as one Arrow table of key, date and volatility (bounded by the calendar).
    """
    d = trailing_vol(series, w, by, value)
    cuts = np.array([calm_share + j * (1.0 - calm_share) / (k - 1) for j in range(k - 1)])

    def assign(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        vol = table.column("vol").to_numpy()
        there = ~np.isnan(vol)
        n = np.arange(1, int(there.sum()) + 1)
        level = (earlier_smaller(vol[there])[:, None] > np.floor((n[:, None] - 1) * cuts)).sum(axis=1)
        regime = np.full(len(vol), -1)
        regime[there] = np.where(n >= min_history, level, -1)
        return table.append_column("regime", pa.array(regime.astype(np.int32)))

    return d.groupBy(*by).applyInArrow(assign, T.StructType([*d.schema.fields, T.StructField("regime", T.IntegerType())]))


def runs(df: DataFrame, flag: Column, by, order: str = "date") -> DataFrame:
    """(by, start, end, length): maximal runs of consecutive rows carrying the flag."""
    o = W.partitionBy(*by).orderBy(order)
    d = df.withColumn("_f", flag).withColumn("_i", F.row_number().over(o))
    d = d.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(o))
    return d.groupBy(*by, "_g").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length")).drop("_g")


def stress_episodes(df: DataFrame, p: str, threshold: float, min_days: int, by=("series",)) -> DataFrame:
    """(by, episodes): number of runs above the threshold lasting at least ``min_days``."""
    found = runs(df, F.col(p) > threshold, by).where(F.col("length") >= min_days)
    counts = found.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"))
    return df.select(*by).distinct().join(counts, list(by), "left").select(
        *by, F.coalesce("episodes", F.lit(0)).alias("episodes"))


def missing_gaps(df: DataFrame, value: str, by=("entity",), order: str = "date") -> DataFrame:
    """(by, first_missing, last_missing, length, next_value): runs of missing rows and the value right after."""
    o = W.partitionBy(*by).orderBy(order)
    d = df.withColumns({"_next": F.lead(value).over(o), "_i": F.row_number().over(o)})
    d = d.where(F.col(value).isNull()).withColumn("_g", F.col("_i") - F.row_number().over(o))
    return d.groupBy(*by, "_g").agg(
        F.min(order).alias("first_missing"), F.max(order).alias("last_missing"),
        F.count(F.lit(1)).alias("length"), F.max_by("_next", order).alias("next_value")).drop("_g")


# ------------------------------------------------------------------ transitions


def transition_counts(states: DataFrame, state: str, by=("series",)) -> DataFrame:
    """(by, src, dst, n, rate): one-step transition counts and row-normalised rates."""
    nxt = F.lead(state).over(W.partitionBy(*by).orderBy("date"))
    pairs = states.where(F.col(state).isNotNull()).select(*by, F.col(state).alias("src"), nxt.alias("dst"))
    n = pairs.where("dst is not null").groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(*by, "src")))


def persistence(transitions: DataFrame, by=("series",)) -> DataFrame:
    """(by, src, stay_prob, expected_duration); the duration of an absorbing state is missing."""
    g = transitions.groupBy(*by, "src").agg(
        F.sum(F.when(F.col("src") == F.col("dst"), F.col("rate")).otherwise(0.0)).alias("stay_prob"))
    return g.withColumn("expected_duration", 1.0 / zero_to_null(1.0 - F.col("stay_prob")))


def stationary_two_state(transitions: DataFrame, by=("series",)) -> DataFrame:
    """(by, p0): long-run share of state 0 of a two-state chain."""
    def rate(a, b):
        return F.sum(F.when((F.col("src") == a) & (F.col("dst") == b), F.col("rate")).otherwise(0.0))

    return transitions.groupBy(*by).agg((rate(1, 0) / zero_to_null(rate(0, 1) + rate(1, 0))).alias("p0"))


# ------------------------------------------------------------------ IC by regime


def weighted_regime_ic(d: DataFrame, ic: str, states=CALM_STRESS, by=("series",)) -> DataFrame:
    """(by, regime, weighted_ic, eff_dates): sum w IC / sum w and Kish's effective dates."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (ic, *states)])
    long = d.where(ok).select(*by, ic, *states).unpivot([*by, ic], list(states), "regime", "w")
    return long.groupBy(*by, "regime").agg(
        (F.sum(F.col("w") * F.col(ic)) / zero_to_null(F.sum("w"))).alias("weighted_ic"),
        kish("w").alias("eff_dates"))


#: A pivot below this share of its column's own sum of squares (columns scaled alike) counts as zero.
RANK_TOLERANCE = 1e-12


def pivoted_inverses(grams: np.ndarray, tolerance: float = RANK_TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """``inverses, ranks`` of a stack of Gram matrices by elimination on the largest remaining diagonal entry.

    Columns are scaled to unit sums of squares first, so the test is one of direction, not of size: the elimination of a matrix ends
    where no remaining column keeps a share above ``tolerance`` of itself, and the number of steps is its rank. Inverses of matrices
    without full rank are not numbers.
    """
    n, k = grams.shape[:2]
    size = np.sqrt(np.maximum(np.einsum("nii->ni", grams), 0.0))
    scale = np.where(size > 0, size, 1.0)
    a = grams / scale[:, :, None] / scale[:, None, :]
    done, rank, every = np.zeros((n, k), bool), np.zeros(n, np.int64), np.arange(n)
    for _ in range(k):
        left = np.where(done, -np.inf, np.einsum("nii->ni", a))
        at = left.argmax(axis=1)
        go = left[every, at] > tolerance
        row, pivot = a[every, at], np.where(go, left[every, at], 1.0)
        swept = a - row[:, :, None] * row[:, None, :] / pivot[:, None, None]
        line = row / pivot[:, None]
        # a swept column holds the inverse's entries with the sign that later steps need
        line[every, at] = -1.0 / pivot
        swept[every, at, :] = line
        swept[every, :, at] = line
        a = np.where(go[:, None, None], swept, a)
        done[every, at] |= go
        rank += go
    inverse = -a / scale[:, :, None] / scale[:, None, :]
    return np.where((rank == k)[:, None, None], inverse, np.nan), rank


def _solve_grams(k: int, by):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sums = batch.column("_sums").flatten().to_numpy(zero_copy_only=False).reshape(n, k, k + 1)
            inverse, rank = pivoted_inverses(sums[:, :, :k])
            coef = (inverse @ sums[:, :, k:])[:, :, 0]
            flat = np.concatenate([inverse.reshape(n, -1), coef], axis=1)
            solved = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], batch.column("_n"), pa.array(rank), solved], names=[*by, "_n", "_rank", "_solved"])
    return solve


def regime_regression(d: DataFrame, ic: str, lags: int, kernel: str, states=CALM_STRESS,
                      by=("series",)) -> DataFrame:
    """(by, term, estimate, se, t, kernel, n): IC on the regime weights without intercept."""
    out = regime_regressions(d, ic, {"x": (lags, kernel)}, states, by)
    return out.toDF(*[c.removesuffix("_x") for c in out.columns])


def regime_regressions(d: DataFrame, ic: str, choices: dict[str, tuple[int, str]], states=CALM_STRESS,
                       by=("series",)) -> DataFrame:
    """(by, term, estimate, n, se_<name>, t_<name>, kernel_<name> ...) for several error choices and any number of regimes.

    Terms are the regimes and ``contrast`` (last minus first). Standard errors come from the scalar
    series a'(X'X)^-1 x_t e_t: each term's series goes through the same long-run variance. A series whose weights do not
    span all regimes (the rank of X'X is below their number), or with no more dates than regimes, is undefined: its terms have no
    estimate, and the kernel ``none``.

    The Gram sums of a series are combined map-side into one row, factored there, and joined back to its dates.
    """
    k, by = len(states), tuple(by)
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in (ic, *states)])
    rows = materialize(d.where(ok).select(*by, "date", F.col(ic).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(states)]))
    cells = [F.sum(F.col(f"_x{min(i, j)}") * F.col(f"_x{max(i, j)}")) if j < k else F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(k) for j in range(k + 1)]
    grams = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array(*cells).alias("_sums"))
    keys = [T.StructField(c, rows.schema[c].dataType) for c in by]
    solved = materialize(grams.mapInArrow(_solve_grams(k, by), T.StructType(
        [*keys, T.StructField("_n", T.LongType()), T.StructField("_rank", T.LongType()), T.StructField("_solved", T.ArrayType(T.DoubleType()))])))
    good = (F.col("_rank") == k) & (F.col("_n") > k)
    names = [(name, np.eye(k)[i]) for i, name in enumerate(states)] + [("contrast", np.eye(k)[-1] - np.eye(k)[0])]

    fine = solved.where(good).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_solved")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    joined = rows.join(fine, same)
    inverse, coef = lambda i, j: F.col("_solved")[i * k + j], lambda i: F.col("_solved")[k * k + i]
    joined = joined.withColumn("_e", F.col("_y") - _add([coef(i) * F.col(f"_x{i}") for i in range(k)]))

    def z(a):
        return _add([F.col(f"_x{i}") * _add([inverse(i, j) * float(a[j]) for j in range(k)]) for i in range(k)]) * F.col("_e")

    def estimate(a):
        return _add([coef(i) * float(a[i]) for i in range(k)])

    long = joined.select(*by, "date", F.explode(F.array(*[
        F.struct(F.lit(n).alias("term"), z(a).alias("z"), estimate(a).alias("estimate")) for n, a in names])).alias("x"))
    # the estimate is one value per term, so it travels as a grouping key
    lrv = long_run_variances(long.select(*by, "date", "x.*"), "z", choices, (*by, "term", "estimate"))
    out, none = [*by, "term", "estimate", "n"], []
    for name in choices:
        v = F.col(f"lrv_{name}")
        se = F.when(v >= 0, F.sqrt(F.col("n") * v))
        out += [se.alias(f"se_{name}"), (F.col("estimate") / zero_to_null(se)).alias(f"t_{name}"), f"kernel_{name}"]
        none += [F.lit(None).cast("double").alias(f"se_{name}"), F.lit(None).cast("double").alias(f"t_{name}"), F.lit("none").alias(f"kernel_{name}")]
    undefined = solved.where(~good).select(*by, F.explode(F.array(*[F.lit(n) for n, _ in names])).alias("term"), F.lit(None).cast("double").alias("estimate"), F.col("_n").alias("n"), *none)
    return lrv.select(*out).unionByName(undefined)


def split_table(ics: DataFrame, weights: dict[tuple[str, str], DataFrame], h: int, nw_min_lag: int) -> DataFrame:
    """Every split of every series: ``weights`` maps (split, weight_kind) to (date, calm, stress).

    One row per term with Hansen-Hodrick and Newey-West errors.
    """
    stacked = None
    for (split, kind), w in weights.items():
        one = w.select("date", *CALM_STRESS).withColumns({"split": F.lit(split), "kind": F.lit(kind)})
        stacked = one if stacked is None else stacked.unionByName(one)
    keys = ("split", "kind", "series")
    d = ics.join(F.broadcast(stacked), "date")  # one row per date and split
    kernels = overlap_kernels(h, nw_min_lag)
    choices = {"hh": kernels["hansen_hodrick"], "nw": kernels["newey_west"]}
    t = regime_regressions(d, "ic", choices, by=keys)
    t = t.withColumnRenamed("se_hh", "se").withColumnRenamed("t_hh", "t").withColumnRenamed("kernel_hh", "kernel")
    return t.drop("kernel_nw").withColumn("h", F.lit(h))


def assign_families(table: DataFrame, primary_signals, primary_kind: str) -> DataFrame:
    """Contrast rows with ``family``, one- or two-sided ``p``, adjusted p-values.

    Primary (soft weights of the primary kind, named series): Holm, one-sided. Exploratory (the same
    specification, other series): Benjamini-Hochberg. Robustness: raw p-values.
    """
    from .infer import benjamini_hochberg, holm

    spec = (F.col("split") == "soft") & (F.col("kind") == primary_kind)
    primary = spec & F.col("series").isin(list(primary_signals))
    family = F.when(primary, "primary").when(spec, "exploratory").otherwise("robustness")
    t = table.where("term = 'contrast'").withColumn("family", family)
    t = t.withColumn("p", F.when(F.col("family") == "primary", p_value("t", "less")).otherwise(p_value("t")))
    keys = ["split", "kind", "series"]
    t = holm(t, "p", ("family",), keys).withColumnsRenamed({"adjusted": "_ha", "reject": "_hr"})
    t = benjamini_hochberg(t, "p", ("family",), keys).withColumnsRenamed({"adjusted": "_ba", "reject": "_br"})
    pick = lambda a, b: F.when(F.col("family") == "primary", a).when(F.col("family") == "exploratory", b)
    return t.withColumns({"adjusted": pick(F.col("_ha"), F.col("_ba")), "reject": pick(F.col("_hr"), F.col("_br"))}).drop(
        "_ha", "_hr", "_ba", "_br")


def sector_measures(sector: DataFrame, market: DataFrame, p: str, threshold: float, min_days: int) -> DataFrame:
    """Per sector against the market's stress probability on common dates."""
    m = market.select("date", F.col(p).alias("_m"))
    d = sector.join(F.broadcast(m), "date")  # one row per date
    on, calm = (F.col(p) > threshold).cast("double"), F.col("_m") <= threshold
    g = d.groupBy("series").agg(
        F.count(F.lit(1)).alias("dates"), F.avg(on).alias("share_stressed"),
        F.avg(F.when(calm, on).otherwise(0.0)).alias("share_stressed_while_calm"),
        F.avg(F.when(calm, on)).alias("p_stress_given_calm"), safe_corr(p, "_m").alias("corr_with_market"))
    return g.join(stress_episodes(sector, p, threshold, min_days), "series")


def co_stress(sector: DataFrame, p: str, threshold: float, names) -> DataFrame:
    """(a, b, share): share of common dates both series are stressed; the diagonal is the own share.

    Series become columns of one row per date, so all pairs are aggregates of a single pass.
    """
    names = [str(n) for n in names]
    wide = sector.groupBy("date").pivot("series", names).agg(F.max((F.col(p) > threshold).cast("double"))).dropna()
    pairs = [(a, b) for a in names for b in names]
    one = wide.agg(*[F.avg(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "share")
    parts = F.split("pair", r"\|")
    return long.select(parts[0].alias("a"), parts[1].alias("b"), "share")


def regime_alignment(util: DataFrame, context: DataFrame, shares, columns, stress_col: str) -> DataFrame:
    """(share, column, corr, high, low): utilisation against context columns, and its mean in the top
    and bottom tercile of ``stress_col``."""
    d = util.join(F.broadcast(context), "date", "left")  # one row per date
    cuts = d.agg(F.percentile(stress_col, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_c"))
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(cuts.withColumn("_k", F.lit(1))), "_k")
    long = d.unpivot([*columns, "_c"] if stress_col in columns else [*columns, stress_col, "_c"],
                     list(shares), "share", "u")
    return long.groupBy("share").agg(
        *[safe_corr("u", c).alias(f"corr_{c}") for c in columns],
        F.avg(F.when(F.col(stress_col) >= F.col("_c")[1], F.col("u"))).alias("high"),
        F.avg(F.when(F.col(stress_col) <= F.col("_c")[0], F.col("u"))).alias("low"))


# ------------------------------------------------------------------ mixture scoring


def mixture_scores(df: DataFrame, y: str, mus, sigmas, priors) -> DataFrame:
    """Add ``nll`` and one responsibility ``r{k}`` per component, in the log domain.

    ``mus`` are columns; ``sigmas`` literals; ``priors`` columns (a zero prior drops out).
    """
    half = 0.5 * math.log(2.0 * math.pi)
    logs = []
    for m, s, p in zip(mus, sigmas, priors, strict=True):
        resid = F.col(y) - col(m)
        ll = F.lit(-half - math.log(s)) - resid * resid / (2.0 * s * s)
        logs.append(F.when(col(p) > 0, F.log(col(p)) + ll))
    d = df.withColumns({f"_a{i}": a for i, a in enumerate(logs)})
    names = [f"_a{i}" for i in range(len(logs))]
    d = d.withColumn("_peak", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    total = _add([F.coalesce(F.exp(F.col(n) - F.col("_peak")), F.lit(0.0)) for n in names])
    d = d.withColumn("_lse", F.col("_peak") + F.log(total))
    d = d.withColumn("nll", -F.col("_lse")).withColumns(
        {f"r{i}": F.when(F.col("_lse").isNotNull(), F.coalesce(F.exp(F.col(n) - F.col("_lse")), F.lit(0.0)))
         for i, n in enumerate(names)})
    return d.drop(*names, "_peak", "_lse")


def weight_diagnostics(df: DataFrame, shares) -> DataFrame:
    """One row: mean entropy (nats), utilisation of each share, sharpness."""
    ent = -_add([F.when(F.col(s) > 0, F.col(s) * F.log(F.col(s))).otherwise(0.0) for s in shares])
    return df.agg(
        F.avg(ent).alias("entropy"), *[F.avg(s).alias(f"util_{s}") for s in shares],
        F.avg(F.greatest(*[F.col(s) for s in shares])).alias("sharpness"))


def output_pairs(df: DataFrame, cols) -> DataFrame:
    """(a, b, corr, rms_distance) of every pair of output columns, aggregated in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("corr"),
                 F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).alias("rms_distance"))
        for a, b in pairs]).alias("x"))
    return one.select(F.inline("x"))


def quantile_bin_means(df: DataFrame, r: str, g: str, probs, bound: int | None = None) -> DataFrame:
    """(bin, mean_r): mean of ``r`` within bins of ``g`` cut at its quantiles over all rows.

    Bin 0 is up to the first edge, the last above the last edge. The whole-table quantiles take the
    split plan unless the row count is proven small.
    """
    from .crosssection import CrossSection

    names = {f"_q{i}": p for i, p in enumerate(probs)}
    d = df.where(F.col(r).isNotNull() & F.col(g).isNotNull()).select(r, g)
    edges = CrossSection((), bound).quantiles(d, g, names)
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(edges.withColumn("_k", F.lit(1))), "_k")
    b = _add([(F.col(g) > F.col(n)).cast("int") for n in names])
    return d.groupBy(b.alias("bin")).agg(F.avg(r).alias("mean_r"))


def regime_balanced_loss(df: DataFrame, loss: str, weights) -> DataFrame:
    """One row: weighted mean loss where every regime carries the same total weight."""
    means = df.agg(*[F.avg(w).alias(f"_m_{w}") for w in weights]).withColumn("_k", F.lit(1))
    d = df.withColumn("_k", F.lit(1)).join(F.broadcast(means), "_k")
    v = _add([F.col(w) / zero_to_null(F.col(f"_m_{w}")) for w in weights])
    return d.agg((F.sum(v * F.col(loss)) / zero_to_null(F.sum(v))).alias("balanced_loss"))


def fold_gains(scores: DataFrame, by=("fold",)) -> DataFrame:
    """Per fold: NLL of the full, base and single-Gaussian scores and the gains between them."""
    g = scores.groupBy(*by).agg(
        F.avg("nll_full").alias("nll_full"), F.avg("nll_base").alias("nll_base"),
        F.avg("nll_single").alias("nll_single"), F.count(F.lit(1)).alias("rows"))
    return g.withColumns({
        "nll_improvement": F.col("nll_base") - F.col("nll_full"),
        "nll_variance_gain": F.col("nll_single") - F.col("nll_base"),
        "nll_total_gain": F.col("nll_single") - F.col("nll_full"),
    })


def vol_hard_weights(states: DataFrame, state: str = "state") -> DataFrame:
    calm, stress = hard_split(F.col(state).cast("double"), 0.5)
    return states.select("date", calm.alias("calm"), stress.alias("stress"))


def probs_hard_weights(probs: DataFrame, threshold: float = 0.5) -> DataFrame:
    calm, stress = hard_split("stress", threshold)
    return probs.select("date", calm.alias("_c"), stress.alias("_s")).toDF("date", "calm", "stress")
