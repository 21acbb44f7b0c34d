"""Cross-sectional operators: one group is one date (or date x sector, or the whole table).

Two physical plans give the same rows:

* **window plan**, when the caller proves that no group exceeds ``MAX_GROUP_ROWS`` (the ``bound``, for
  example the footer row count of the entity dimension): Window functions partitioned by the group;
  several operators on one group share a shuffle.
* **split plan**, otherwise: group moments are map-side combined aggregates joined back, and order
  statistics come from range-partitioned value counts. A group holding a third of all rows is
  spread over many tasks; ties collapse to one row before anything is sorted. No rows are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.elementwise import col, zero_to_null
from ..session import materialize, materialize_columns
from . import packed

#: A group up to this many rows may be sorted by a single task.
MAX_GROUP_ROWS = 1_000_000


def _fresh(df: DataFrame, base: str) -> str:
    name = base
    while name in df.columns:
        name += "_"
    return name


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL, keeping the left side's key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"{k}__r")
    if not keys:
        keys = [_fresh(left, "one__")]
        left, renamed = left.withColumn(keys[0], F.lit(1)), renamed.withColumn(f"{keys[0]}__r", F.lit(1))
        out = left.join(renamed, F.col(keys[0]) == F.col(f"{keys[0]}__r"), how)
        return out.drop(keys[0], f"{keys[0]}__r")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"{k}__r" for k in keys])


def split_order(values: DataFrame, by: list[str], order: list[str], count: str | None) -> DataFrame:
    """Add ``before`` (rows ordered earlier in the group), ``nth``, ``n`` (group size) and ``last`` (the highest ``nth``), exactly.

    ``values`` is range-partitioned by (group, order), written once, and each range is numbered on
    its own; offsets come from one small row per (range, group). With ``count`` a row stands for
    that many rows; ``nth`` numbers the rows themselves (a dense rank for distinct values).
    """
    weight = F.col(count) if count else F.lit(1)
    spread = [*by, *order]
    # distinct values have no equal keys, rows may
    ranged = (materialize_columns if count else materialize)(values.repartitionByRange(*spread).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_k"))
    parts = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = parts.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *by, "_part",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
        F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_k0"),
        F.sum("_w").over(parts).alias("n"), F.sum("_k").over(parts).alias("last"),
    )
    inside = W.partitionBy(*by, "_part").orderBy(*order)
    numbered = ranged.withColumn(
        "_before", F.coalesce(F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_nth", F.row_number().over(inside))
    joined = _null_safe(numbered, sizes, [*by, "_part"])
    return joined.select(
        *values.columns,
        (F.col("_before") + F.col("_w0")).alias("before"),
        (F.col("_nth") + F.col("_k0")).alias("nth"),
        "n", "last",
    )


def split_running(values: DataFrame, by: list[str], order: list[str], step, out: str, falling: bool = False) -> DataFrame:
    """Add ``_i`` (position), ``_n`` (group size) and the running extreme of ``step(i, n)`` in order.

    Running maximum from the first row on, or with ``falling`` the running minimum from the last row
    back. Each range works on its own; ranges exchange one extreme per group.
    """
    ranged = materialize(values.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    parts = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.select(
        *by, "_part", F.coalesce(F.sum("_k").over(
            parts.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_k0"),
        F.sum("_k").over(parts).alias("_n"))
    inside = W.partitionBy(*by, "_part").orderBy(*order)
    d = _null_safe(ranged.withColumn("_nth", F.row_number().over(inside)), sizes, [*by, "_part"])
    d = d.withColumn("_i", F.col("_nth") + F.col("_k0")).drop("_nth", "_k0")
    d = d.withColumn("_step", step(F.col("_i"), F.col("_n")))
    best, worse = (F.min, F.least) if falling else (F.max, F.greatest)
    frame = inside.rowsBetween(0, W.unboundedFollowing) if falling else inside.rowsBetween(W.unboundedPreceding, 0)
    other = parts.orderBy("_part")
    other = other.rowsBetween(1, W.unboundedFollowing) if falling else other.rowsBetween(W.unboundedPreceding, -1)
    edges = d.groupBy(*by, "_part").agg(best("_step").alias("_e"))
    edges = edges.select(*by, "_part", best("_e").over(other).alias("_e"))
    d = _null_safe(d.withColumn("_own", best("_step").over(frame)), edges, [*by, "_part"])
    return d.withColumn(out, worse("_own", F.coalesce("_e", "_own"))).drop("_own", "_e", "_step", "_part")


@dataclass(frozen=True)
class CrossSection:
    """Grouping keys plus a proven bound on the rows of one group (None: unknown)."""

    by: tuple[str, ...] = ("date",)
    bound: int | None = None

    @property
    def windowed(self) -> bool:
        return self.bound is not None and self.bound <= MAX_GROUP_ROWS

    def _window(self):
        return W.partitionBy(*self.by) if self.by else W.partitionBy(F.lit(0))

    # ------------------------------------------------------------------ group aggregates

    def attach(self, df: DataFrame, stored: bool = False, **aggs: Column) -> DataFrame:
        """Add group aggregates to every row (``aggs``: output name -> aggregate Column).

        The split plan reads the rows twice. It writes them once, unless the caller says that they are ``stored``: a projection of a table or
        of a checkpoint. Then the groups' facts are written too, so that Spark knows their size and need not deal the rows anew to join a small table.
        """
        if self.windowed:
            w = self._window()
            return df.select("*", *[a.over(w).alias(k) for k, a in aggs.items()])
        rows = df if stored else materialize(df)
        table = rows.groupBy(*self.by).agg(*[a.alias(k) for k, a in aggs.items()])
        return _null_safe(rows, materialize_columns(table) if stored else table, list(self.by))

    # ------------------------------------------------------------------ ranks

    def ranks(self, df: DataFrame, x: str, prefix: str = "r", stored: bool = False, base: DataFrame | None = None) -> DataFrame:
        """Add ``<prefix>_lt`` (values below), ``_eq`` (ties incl. own), ``_n`` (values), ``_dense``, ``_top`` (distinct values).

        NULL inputs get NULL in all five. Everything rank-like is arithmetic on these. The split plan orders the distinct values of the group; rows
        only meet their value's facts. ``base`` holds the same rows' values of ``x`` in stored form: several ranks of one table need one writing.
        """
        lt, eq, n, dense, top = (f"{prefix}_{s}" for s in ("lt", "eq", "n", "dense", "top"))
        if self.windowed:
            w = self._window()
            ordered = w.orderBy(F.col(x).asc_nulls_last())
            # the peers of a row: a range frame of the same sort, so ties cost no second sort
            tie = ordered.rangeBetween(W.currentRow, W.currentRow)
            has = F.col(x).isNotNull()
            d = df.select(
                "*",
                F.when(has, F.rank().over(ordered) - 1).alias(lt),
                F.when(has, F.count(F.lit(1)).over(tie)).alias(eq),
                F.when(has, F.count(F.col(x)).over(w)).alias(n),
                F.when(has, F.dense_rank().over(ordered)).alias(dense),
            )
            return d.select("*", F.when(F.col(dense).isNotNull(), F.max(dense).over(w)).alias(top))
        df = df if stored or base is not None else materialize(df)
        counts = self._value_counts(df if base is None else base, x)
        ordered = split_order(counts, list(self.by), [x], "_eq").select(
            *self.by, x, F.col("before").alias(lt), F.col("_eq").alias(eq),
            F.col("n").alias(n), F.col("nth").alias(dense), F.col("last").alias(top),
        )
        return _null_safe(df, ordered, [*self.by, x])

    def store(self, df: DataFrame) -> DataFrame | None:
        """The rows in stored form, where this cross-section takes the split plan; else nothing."""
        return None if self.windowed else materialize_columns(df)

    def _value_counts(self, df: DataFrame, x: str) -> DataFrame:
        return df.where(F.col(x).isNotNull()).groupBy(*self.by, x).agg(F.count(F.lit(1)).alias("_eq"))

    def rank_avg(self, df: DataFrame, x: str, out: str, base: DataFrame | None = None) -> DataFrame:
        return self._derive(df, x, out, lambda lt, eq, n, d: lt + (eq + 1) / 2.0, base)

    def rank_pct(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Average-tie rank / n, in (0, 1]."""
        return self._derive(df, x, out, lambda lt, eq, n, d: (lt + (eq + 1) / 2.0) / n)

    def rank_centered(self, df: DataFrame, x: str, out: str) -> DataFrame:
        return self._derive(df, x, out, lambda lt, eq, n, d: (lt + (eq + 1) / 2.0) / n - 0.5)

    def rank_to_unit(self, df: DataFrame, x: str, out: str, base: DataFrame | None = None) -> DataFrame:
        """Average rank mapped to [-1, 1]; a single value gets 0."""
        return self._derive(
            df, x, out,
            lambda lt, eq, n, d: F.when(n == 1, 0.0).otherwise(
                2.0 * (lt + (eq + 1) / 2.0 - 1.0) / F.nullif(n - 1, F.lit(0)) - 1.0),
            base,
        )

    def rank_dense12(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Dense rank scaled to [1, 2]."""
        df = self.ranks(df, x, "_r")
        return df.withColumn(
            out, 1.0 + (F.col("_r_dense") - 1) / F.nullif(F.col("_r_top") - 1, F.lit(0))
        ).drop("_r_lt", "_r_eq", "_r_n", "_r_dense", "_r_top")

    def tent(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """1 - 2 |pct rank - 0.5|: highest for the middle of the cross-section."""
        return self._derive(
            df, x, out, lambda lt, eq, n, d: 1.0 - 2.0 * F.abs((lt + (eq + 1) / 2.0) / n - 0.5))

    def _derive(self, df, x, out, fn, base=None) -> DataFrame:
        df = self.ranks(df, x, "_r", base=base)
        names = ["_r_lt", "_r_eq", "_r_n", "_r_dense"]
        return df.withColumn(out, fn(*[F.col(c) for c in names])).drop(*names, "_r_top")

    def ordinal(self, df: DataFrame, x: str, out: str, tie: str = "entity", n: str | None = None) -> DataFrame:
        """Row number by (x, tie) among the rows that have x; optionally the group's count ``n``."""
        extra = [] if n is None else [n]
        if self.windowed:
            w = self._window()
            has = F.col(x).isNotNull()
            cols = [F.when(has, F.row_number().over(w.orderBy(F.col(x).asc_nulls_last(), F.col(tie)))).alias(out)]
            if n:
                cols.append(F.count(F.col(x)).over(w).alias(n))
            return df.select("*", *cols)
        df = materialize(df)
        part = df.where(F.col(x).isNotNull())
        ranked = split_order(part, list(self.by), [x, tie], None)
        ranked = ranked.withColumnRenamed("nth", out)
        ranked = ranked.withColumnRenamed("n", n) if n else ranked.drop("n")
        rest = df.where(F.col(x).isNull())
        if n:
            rest = CrossSection(self.by, None)._join_counts(rest, df, x, n)
        return ranked.drop("before", "last").unionByName(
            rest.withColumn(out, F.lit(None).cast("bigint")).select(*df.columns, *extra, out)
            if n else rest.withColumn(out, F.lit(None).cast("bigint")), allowMissingColumns=False,
        )

    def _join_counts(self, rest, df, x, n):
        table = df.groupBy(*self.by).agg(F.count(F.col(x)).alias(n))
        return _null_safe(rest, table, list(self.by))

    def rank_ordinal(self, df: DataFrame, x: str, out: str, tie: str = "entity") -> DataFrame:
        """Ordinal rank / (n - 1) - 0.5, ties in row order."""
        df = self.ordinal(df, x, "_o", tie, "_on")
        return df.withColumn(
            out, F.when(F.col("_on") > 1, (F.col("_o") - 1) / F.nullif(F.col("_on") - 1, F.lit(0)) - 0.5)
            .when(F.col("_o").isNotNull(), 0.0)
        ).drop("_o", "_on")

    # ------------------------------------------------------------------ quantiles

    def quantiles(self, df: DataFrame, x: str, probs: dict[str, float], stored: bool = False) -> DataFrame:
        """One row per group: linearly interpolated quantiles (exact), ``probs``: name -> level."""
        if self.windowed:
            q = F.percentile(F.col(x), F.array(*[F.lit(float(p)) for p in probs.values()]))
            table = df.groupBy(*self.by).agg(q.alias("_q"))
            return table.select(*self.by, *[F.col("_q")[i].alias(k) for i, k in enumerate(probs)])
        df = df.select(*self.by, x) if stored else materialize(df.select(*self.by, x))
        table = self._ordered_quantiles(split_order(self._value_counts(df, x), list(self.by), [x], "_eq"), x, probs)
        # a group without values has no value counts, but is a group all the same
        return _null_safe(df.select(*self.by).distinct(), table, list(self.by)) if self.by else table

    def _ordered_quantiles(self, ordered: DataFrame, x: str, probs: dict[str, float]) -> DataFrame:
        """The quantiles of each group that has values, from its values in order with their counts."""
        aggs = []
        for k, p in probs.items():
            pos = (F.col("n") - 1) * F.lit(float(p))
            last = F.col("before") + F.col("_eq") - 1
            aggs += [
                F.min(F.when(last >= F.floor(pos), F.col(x))).alias(f"{k}_lo"),
                F.min(F.when(last >= F.ceil(pos), F.col(x))).alias(f"{k}_hi"),
            ]
        table = ordered.groupBy(*self.by).agg(F.max("n").alias("_n"), *aggs)
        frac = {k: ((F.col("_n") - 1) * F.lit(float(p))) % 1 for k, p in probs.items()}
        return table.select(*self.by, *[
            (F.col(f"{k}_lo") * (1 - frac[k]) + F.col(f"{k}_hi") * frac[k]).alias(k) for k in probs])

    def with_quantiles(self, df: DataFrame, x: str, probs: dict[str, float], stored: bool = False) -> DataFrame:
        if self.windowed:
            q = F.percentile(F.col(x), F.array(*[F.lit(float(p)) for p in probs.values()]))
            out = df.withColumn("_q", q.over(self._window()))
            return out.select(*df.columns, *[F.col("_q")[i].alias(k) for i, k in enumerate(probs)])
        df = df if stored else materialize(df)
        return _null_safe(df, self.quantiles(df, x, probs, stored=True), list(self.by))

    # ------------------------------------------------------------------ derived operators

    def zscore(self, df, x, out) -> DataFrame:
        df = self.attach(df, _m=F.avg(x), _s=F.stddev_samp(x))
        return df.withColumn(out, (F.col(x) - F.col("_m")) / zero_to_null("_s")).drop("_m", "_s")

    def scale12(self, df, x, out) -> DataFrame:
        """Min-max to [1, 2]."""
        df = self.attach(df, _lo=F.min(x), _hi=F.max(x))
        return df.withColumn(
            out, 1.0 + (F.col(x) - F.col("_lo")) / zero_to_null(F.col("_hi") - F.col("_lo"))
        ).drop("_lo", "_hi")

    def winsor(self, df, x, out, p: float, remove_extreme: bool = False, stored: bool = False) -> DataFrame:
        """Clip to the p and 1 - p quantiles, or set the extremes to zero."""
        df = self.with_quantiles(df, x, {"_lo": p, "_hi": 1.0 - p}, stored)
        x_, lo, hi = F.col(x), F.col("_lo"), F.col("_hi")
        if remove_extreme:
            value = F.when(x_.isNull(), None).when((x_ < lo) | (x_ > hi), 0.0).otherwise(x_)
        else:
            value = F.when(x_.isNotNull(), F.greatest(F.least(x_, hi), lo))
        return df.withColumn(out, value).drop("_lo", "_hi")

    def winsor_all(self, df, xs, p: float, parts=None) -> DataFrame:
        """Clip several columns in place: a group's columns side by side, or by ends that come from the few values around them.

        ``parts``: (stored table, columns) that hold the columns for the split plan, where ``df`` joins them and isn't stored itself.
        """
        if self.windowed:
            schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in xs else f.dataType) for f in df.schema.fields])
            return df.groupBy(*self.by).applyInArrow(_clip_columns(list(xs), p), schema)
        if parts is None:
            df = materialize_columns(df)
            parts = [(df, list(xs))]
        wide = materialize_columns(self._ends(parts, p))
        d = _null_safe(df, wide, list(self.by))
        clip = {x: F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.col(f"_q_{x}")[1]), F.col(f"_q_{x}")[0])) for x in xs}
        return d.withColumns(clip).drop(*[f"_q_{x}" for x in xs])

    def _ends(self, parts, p: float) -> DataFrame:
        """One row per group: ``_q_<column>``, the p and 1 - p quantiles (exact), from stored tables with columns of the same groups.

        Summaries of what each task holds say between which values a place lies; only these values are counted and put in order.
        """
        keys, probs, tables = list(self.by), [p, 1.0 - p], []
        for table, xs in parts:
            near = materialize_columns(packed.value_brackets(table, keys, xs, probs))
            long = table.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_x"), F.col(x).cast("double").alias("_v")) for i, x in enumerate(xs)])))
            met = _null_safe(long.where("_v is not null"), near, [*keys, "_x"])
            cells = F.array(*[F.when(F.col("_v") <= F.col("_hi")[t], F.struct(F.lit(t).alias("_t"), F.when(F.col("_v") >= F.col("_lo")[t], F.col("_v")).alias("_v")))
                              for t in range(len(probs))])
            cell = [*keys, "_x", "_n", "_t"]
            counts = met.select(*keys, "_x", "_n", F.inline(F.array_compact(cells))).groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_eq"))
            counts = materialize_columns(counts)
            below = counts.where("_v is null").select(*[c for c in cell if c != "_n"], F.col("_eq").alias("_below"))
            ordered = split_order(counts.where("_v is not null"), cell, ["_v"], "_eq")
            ordered = _null_safe(ordered, below, [c for c in cell if c != "_n"])
            pos = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in probs]), F.col("_t") + 1)
            last = F.coalesce("_below", F.lit(0)) + F.col("before") + F.col("_eq") - 1
            ends = ordered.groupBy(*cell).agg(F.min(F.when(last >= F.floor(pos), F.col("_v"))).alias("_a"), F.min(F.when(last >= F.ceil(pos), F.col("_v"))).alias("_b"))
            value = F.col("_a") * (1 - pos % 1) + F.col("_b") * (pos % 1)
            at = lambda i, t: F.max(F.when((F.col("_x") == i) & (F.col("_t") == t), F.col("_end")))
            tables.append(ends.select(*keys, "_x", "_t", value.alias("_end")).groupBy(*keys).agg(
                *[F.array(*[at(i, t) for t in range(len(probs))]).alias(f"_q_{x}") for i, x in enumerate(xs)]))
        if keys:  # a group without values has no value counts, but is a group all the same
            tables.insert(0, parts[0][0].select(*keys).distinct())
        return reduce(lambda a, b: _null_safe(a, b, keys), tables)

    def remove_middle(self, df, x, out, share: float) -> DataFrame:
        """Keep only the two tails of (1 - share) / 2 by percentile rank."""
        tail = round((1.0 - share) / 2.0, 12)
        df = self.rank_pct(df, x, "_pct")
        keep = (F.col("_pct") <= tail) | (F.col("_pct") > 1.0 - tail)
        return df.withColumn(out, F.when(keep, F.col(x))).drop("_pct")

    def demean(self, df, x, out, group: str | None = None, stored: bool = False) -> DataFrame:
        """x minus the group mean; with ``group``, within it, and missing where it is missing."""
        g = self if group is None else CrossSection((*self.by, group), self.bound)
        df = g.attach(df, stored, _m=F.avg(x))
        value = F.col(x) - F.col("_m")
        if group is not None:
            value = F.when(F.col(group).isNotNull(), value)
        return df.withColumn(out, value).drop("_m")

    def booksize(self, df, x, out, size: float) -> DataFrame:
        """Long and short books each scaled to ``size``."""
        df = self._books(df, x)
        v = F.col(x)
        return df.withColumn(
            out, F.when(v > 0, v * size / zero_to_null("_long"))
            .when(v < 0, v * size / zero_to_null("_short")).otherwise(v)
        ).drop("_long", "_short")

    def shrink_balance(self, df, x, out) -> DataFrame:
        """Scale the larger book down to the smaller."""
        df = self._books(df, x)
        v, small = F.col(x), F.least("_long", "_short")
        return df.withColumn(
            out, F.when(v > 0, v * small / zero_to_null("_long"))
            .when(v < 0, v * small / zero_to_null("_short")).otherwise(v)
        ).drop("_long", "_short")

    def poslimit(self, df, x, out, limit: float) -> DataFrame:
        """Cap one name's share of its own book."""
        df = self._books(df, x)
        v = F.col(x)
        cap = F.when(v > 0, F.col("_long")).otherwise(F.col("_short")) * limit
        return df.withColumn(
            out, F.when(v.isNotNull(), F.signum(v) * F.least(F.abs(v), cap))).drop("_long", "_short")

    def _books(self, df, x) -> DataFrame:
        v = F.col(x)
        return self.attach(
            df,
            _long=F.sum(F.when(v > 0, v).otherwise(0.0)),
            _short=F.sum(F.when(v < 0, -v).otherwise(0.0)),
        )

    def harmonic_mean(self, df, x, out) -> DataFrame:
        inv = 1.0 / zero_to_null(x)
        df = self.attach(df, _n=F.count(inv), _s=F.sum(inv))
        return df.withColumn(out, F.col("_n") / zero_to_null("_s")).drop("_n", "_s")

    def weighted_mean(self, df, x, weight, out, stored: bool = False) -> DataFrame:
        """sum(w x) / sum(w) over rows that have both; missing when the weights sum to zero."""
        ok = F.col(x).isNotNull() & F.col(weight).isNotNull()
        df = self.attach(
            df, stored,
            _num=F.sum(F.when(ok, F.col(x) * F.col(weight))),
            _den=F.sum(F.when(ok, F.col(weight))),
        )
        value = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))
        for k in self.by:
            value = F.when(F.col(k).isNotNull(), value)
        return df.withColumn(out, value).drop("_num", "_den")

    def eligible_demean(self, df, y, eligible, out) -> DataFrame:
        """y minus its mean over the group's eligible rows."""
        df = self.attach(df, _m=F.avg(F.when(col(eligible), F.col(y))))
        return df.withColumn(out, F.col(y) - F.col("_m")).drop("_m")

    def unit_gross(self, df, x, out) -> DataFrame:
        """Subtract the median, divide by the sum of absolute values.

        In the split plan both facts of a group come from its values in order with their counts; the rows are read once more.
        """
        if self.windowed:
            df = self.with_quantiles(df, x, {"_med": 0.5}).withColumn("_c", F.col(x) - F.col("_med"))
            df = self.attach(df, _g=F.sum(F.abs("_c")))
            return df.withColumn(out, F.col("_c") / zero_to_null("_g")).drop("_med", "_c", "_g")
        df = materialize(df)
        ordered = split_order(self._value_counts(df, x), list(self.by), [x], "_eq")
        medians = self._ordered_quantiles(ordered, x, {"_med": 0.5})
        gross = _null_safe(ordered, medians, list(self.by)).groupBy(*self.by).agg(
            F.max("_med").alias("_med"), F.sum(F.abs(F.col(x) - F.col("_med")) * F.col("_eq")).alias("_g"))
        d = _null_safe(df, gross, list(self.by))
        return d.withColumn(out, (F.col(x) - F.col("_med")) / zero_to_null("_g")).drop("_med", "_g")

    def at_least(self, df, names: int) -> DataFrame:
        """Rows of groups with at least ``names`` rows."""
        return self.attach(df, _k=F.count(F.lit(1))).where(F.col("_k") >= names).drop("_k")

    def within_or_all(self, df, x, group, out, min_names: int, base: DataFrame | None = None) -> DataFrame:
        """Unit rank inside ``group`` when it has enough values, else over the whole date."""
        inside = CrossSection((*self.by, group), self.bound)
        if base is None:
            base = self.store(df)
            df = df if base is None else base
        df = inside.ranks(df, x, "_i", base=base)
        df = self.rank_to_unit(df, x, "_all", base)
        lt, eq, n = F.col("_i_lt"), F.col("_i_eq"), F.col("_i_n")
        unit = F.when(n == 1, 0.0).otherwise(
            2.0 * (lt + (eq + 1) / 2.0 - 1.0) / F.nullif(n - 1, F.lit(0)) - 1.0)
        use = F.col(group).isNotNull() & (n >= min_names)
        return df.withColumn(out, F.when(use, unit).otherwise(F.col("_all"))).drop(
            "_i_lt", "_i_eq", "_i_n", "_i_dense", "_i_top", "_all")

    def ranks_side_by_side(self, df, xs, to, within=(), group: str | None = None, min_names: int = 1) -> DataFrame:
        """Ranks of several columns in place (``to``: ``unit``, ``centered`` or ``pct``); a task sorts a bounded group's rows once, and not for each column.

        For each column of ``within`` there is also ``<column>_<group>``: its unit rank inside ``group`` when that has enough values, else over all rows.
        The split plan deals the rows once for all columns, see ``packed``.
        """
        scale = {"unit": _unit, "centered": _centered, "pct": _pct}[to]
        fields = [T.StructField(f.name, T.DoubleType() if f.name in xs else f.dataType) for f in df.schema.fields]
        fields += [T.StructField(f"{c}_{group}", T.DoubleType()) for c in within]
        if self.windowed:
            return df.groupBy(*self.by).applyInArrow(_rank_columns(list(xs), scale, list(within), group, min_names), T.StructType(fields))
        columns = list(dict.fromkeys([*xs, *within]))
        if not all(isinstance(df.schema[c].dataType, packed.ORDERED) for c in columns):
            return self._ranks_one_by_one(df, xs, to, within, group, min_names)

        def finish(known):
            out = {}
            for x in xs:
                has, *facts = known[x, False]
                out[x] = packed.spread(has, scale(*facts))
            for x in within:
                (has, *facts), (classed, *own) = known[x, False], known[x, True]
                rank, use = _unit(*facts), classed[has]
                rank[use] = np.where(own[2] >= min_names, _unit(*own), rank[use])
                out[f"{x}_{group}"] = packed.spread(has, rank)
            return out

        names = {*xs, *(f"{c}_{group}" for c in within)}
        rows = packed.pack(df, list(self.by))
        ranked = packed.ranked(rows, list(self.by), [*[(c, False) for c in columns], *[(c, True) for c in within]], finish, [f for f in fields if f.name in names], group if within else None)
        return ranked.select(*[f.name for f in fields])

    def _ranks_one_by_one(self, df, xs, to, within, group, min_names) -> DataFrame:
        """The same for values of types without a 64-bit order."""
        rank = {"unit": self.rank_to_unit, "centered": self.rank_centered, "pct": self.rank_pct}[to]
        names = df.columns
        for c in within:
            df = self.within_or_all(df, c, group, f"{c}_{group}", min_names)
        for c in xs:
            df = rank(df, c, "_u").drop(c).withColumnRenamed("_u", c)
        return df.select(*names, *[f"{c}_{group}" for c in within])

    def factor_neutral(self, df, y, factors, out) -> DataFrame:
        """Residual of the group's least-squares regression of y on an intercept and the factors.

        Two passes of group aggregates: means over the complete rows, then sums of products of what is left, so that nothing is lost to the level of
        the inputs. The tiny systems are solved with Gaussian elimination unrolled as Column expressions. A factor without variation of
        its own (next to the ones before it) leaves the group without residuals.
        """
        ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *factors)])
        names = [y, *factors]
        df = df.withColumn("_ok", ok)
        df = self.attach(df, _k=F.count(F.when(F.col("_ok"), 1)), **{f"_m{i}": F.avg(F.when(F.col("_ok"), F.col(c))) for i, c in enumerate(names)})
        df = df.withColumns({f"_c{i}": F.when(F.col("_ok"), F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(names)})
        p = len(factors)
        sums = {f"_s{i}_{j}": F.sum(F.col(f"_c{i + 1}") * F.col(f"_c{j + 1}")) for i in range(p) for j in range(i, p)}
        sums |= {f"_t{i}": F.sum(F.col(f"_c{i + 1}") * F.col("_c0")) for i in range(p)}
        df = self.attach(df, **sums)
        df, beta = solve_columns(df, p, [F.col("_k") * F.col(f"_m{i + 1}") * F.col(f"_m{i + 1}") for i in range(p)])
        fit = sum((F.col(b) * F.col(f"_c{i + 1}") for i, b in enumerate(beta)), F.lit(0.0))
        return df.withColumn(out, F.col("_c0") - fit).drop(
            *sums, *beta, "_ok", "_k", *[f"_m{i}" for i in range(p + 1)], *[f"_c{i}" for i in range(p + 1)], *[c for c in df.columns if c.startswith("_ge")])


def _unit(lt: np.ndarray, eq: np.ndarray, n) -> np.ndarray:
    return np.where(n == 1, 0.0, 2.0 * (lt + (eq + 1) / 2.0 - 1.0) / np.maximum(n - 1, 1) - 1.0)


def _pct(lt: np.ndarray, eq: np.ndarray, n) -> np.ndarray:
    return (lt + (eq + 1) / 2.0) / n


def _centered(lt: np.ndarray, eq: np.ndarray, n) -> np.ndarray:
    return _pct(lt, eq, n) - 0.5


def _numbered(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries are there, and of these: the number of each one's value in order (NaN is one value, the highest) and the count of each value."""
    has = c.is_valid().to_numpy()
    _, at, counts = np.unique(c.drop_null().to_numpy(), return_inverse=True, return_counts=True)
    return has, at, counts


def _rank_columns(xs: list[str], to, within: list[str], group: str | None, min_names: int):
    """For the rows of one bounded group: each column's ranks, and the unit ranks inside the rows' classes where these have enough values."""

    def run(t: pa.Table) -> pa.Table:
        ranks, more = {}, {}
        for x in {*xs, *within}:
            has, at, counts = _numbered(t[x])
            facts = ((np.cumsum(counts) - counts)[at], counts[at], np.int64(len(at)))
            if x in xs:
                ranks[x] = packed.spread(has, to(*facts))
            if x in within:
                known, code, classes = _numbered(t[group])
                own = np.full(len(has), -1)
                own[known] = code
                own = own[has]
                # numbers of (class, value) in order; those of a class follow each other, missing classes come first
                pairs, at, eq = np.unique((own + 1) * len(counts) + at, return_inverse=True, return_counts=True)
                size = np.bincount(own + 1, minlength=len(classes) + 1)
                lt = (np.cumsum(eq) - eq)[at] - (np.cumsum(size) - size)[own + 1]
                use = (own >= 0) & (size[own + 1] >= min_names)
                more[f"{x}_{group}"] = packed.spread(has, np.where(use, _unit(lt, eq[at], size[own + 1]), _unit(*facts)))
        for x, v in ranks.items():
            t = t.set_column(t.schema.get_field_index(x), x, v)
        for x in within:
            t = t.append_column(f"{x}_{group}", more[f"{x}_{group}"])
        return t

    return run


def _clip_columns(xs: list[str], p: float):
    """For the rows of one bounded group: each column cut to its interpolated p and 1 - p quantiles, a missing value stays missing."""

    def level(v: np.ndarray, q: float) -> float:
        at = (len(v) - 1) * q
        lo, hi = int(np.floor(at)), int(np.ceil(at))
        return float(v[lo] if lo == hi or v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi])

    def run(t: pa.Table) -> pa.Table:
        for x in xs:
            c = t[x].cast(pa.float64())
            lost, v = c.is_null().to_numpy(), c.fill_null(0.0).to_numpy()
            if not lost.all():
                order = np.sort(v[~lost])
                v = np.maximum(np.fmin(v, level(order, 1.0 - p)), level(order, p))
            t = t.set_column(t.schema.get_field_index(x), x, pa.array(v, mask=lost))
        return t

    return run


#: A pivot below the first share of its own diagonal entry, or an entry below the second share of the squares of its level, counts as zero.
PIVOT_SHARE, LEVEL_SHARE = 1e-12, 1e-27


def solve_columns(df: DataFrame, p: int, levels: list[Column] | None = None) -> tuple[DataFrame, list[str]]:
    """Solve the symmetric p x p system held in ``_s{i}_{j}`` / ``_t{i}`` columns; returns ``_b{i}``.

    p is a small literal (the number of regressors), so elimination unrolls into p levels of
    projections that stay in generated code. Pivots are judged against their column: the part that earlier columns don't explain has to be more
    than rounding of the whole, and with ``levels`` (sums of squares of what was subtracted in centring) more than rounding of these.
    """
    a = [[f"_s{min(i, j)}_{max(i, j)}" for j in range(p)] + [f"_t{i}"] for i in range(p)]

    def pivot(k: int) -> Column:
        value, own = F.col(a[k][k]), F.col(f"_s{k}_{k}")
        real = value > PIVOT_SHARE * own
        if levels is not None:
            real = real & (own > LEVEL_SHARE * levels[k])
        return F.when(real, value)

    for k in range(p):
        new, names = [], {}
        for i in range(k + 1, p):
            for j in range(k + 1, p + 1):
                name = f"_ge{k}_{i}_{j}"
                expr = F.col(a[i][j]) - F.col(a[i][k]) / pivot(k) * F.col(a[k][j])
                new.append(expr.alias(name))
                names[(i, j)] = name
        df = df.select("*", *new)
        for (i, j), name in names.items():
            a[i][j] = name
    beta = [f"_b{i}" for i in range(p)]
    for i in reversed(range(p)):
        rhs = F.col(a[i][p])
        for j in range(i + 1, p):
            rhs = rhs - F.col(a[i][j]) * F.col(beta[j])
        df = df.withColumn(beta[i], rhs / pivot(i))
    return df, beta
