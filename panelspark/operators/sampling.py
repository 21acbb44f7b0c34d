"""Deterministic sampling, balancing and de-duplication.

Random order is the md5 of the row key, so a sample is the same on every run and every retry. Picks
of "k of a class" use the split plan of ``CrossSection``, so one class holding most rows is never
sorted by a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir
from .crosssection import CrossSection, _null_safe


def hash_order(*keys: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def hash_bucket(buckets: int, *keys: str) -> Column:
    """Bucket 0..n-1 from the first 28 bits of the key's md5."""
    return (F.conv(F.substring(hash_order(*keys), 1, 7), 16, 10).cast("bigint") % buckets).cast("int")


def _first_of_class(df: DataFrame, by: list[str], cap: str, keys, bound: int | None) -> DataFrame:
    """The first ``cap`` rows (a column) of each class in hash order; ``cap`` NULL keeps all."""
    d = df.withColumn("_h", hash_order(*keys)).withColumn("_key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    d = CrossSection(tuple(by), bound).ordinal(d, "_h", "_o", "_key")
    return d.where(F.col(cap).isNull() | (F.col("_o") <= F.col(cap))).drop("_h", "_key", "_o", cap)


def _capped_zeros(df: DataFrame, label: str, multiple: float, keys, bound: int | None) -> DataFrame:
    """Class 0 of stored rows, at most ``multiple`` times the number of nonzero rows; only its rows are put in order."""
    total = df.agg(F.floor(F.sum((F.col(label) != 0).cast("bigint")) * F.lit(float(multiple))).alias("_cap"))
    d = _null_safe(df.where(F.col(label) == 0).withColumn("_zero", F.lit(1)), F.broadcast(total), [])
    return _first_of_class(d, ["_zero"], "_cap", keys, bound).drop("_zero")


def downsample_zero(df: DataFrame, label: str, multiple: float, keys=("date", "entity"),
                    bound: int | None = None) -> DataFrame:
    """Cap class 0 at ``multiple`` times the number of nonzero rows."""
    df = materialize(df)
    rest = df.where(F.col(label).isNull() | (F.col(label) != 0))
    return rest.unionByName(_capped_zeros(df, label, multiple, keys, bound))


def balance_signed(df: DataFrame, label: str, keys=("date", "entity"), bound: int | None = None) -> DataFrame:
    """For every level |k| >= 1 keep as many +k as -k rows; class 0 is left out."""
    return _balanced_signs(materialize(df.where(F.col(label) != 0)), label, keys, bound)


def _balanced_signs(d: DataFrame, label: str, keys, bound: int | None) -> DataFrame:
    level = F.abs(F.col(label)).alias("_lvl")
    n = d.groupBy(level).agg(
        F.least(F.sum((F.col(label) > 0).cast("bigint")), F.sum((F.col(label) < 0).cast("bigint"))).alias("_cap"))
    d = _null_safe(d.withColumn("_lvl", F.abs(F.col(label))), F.broadcast(n), ["_lvl"])  # one row per level: a shuffle would put a level into one task
    return _first_of_class(d, [label], "_cap", keys, bound).drop("_lvl")


def balanced_sample(df: DataFrame, y: str, thresholds, multiple: float, keys=("date", "entity"),
                    limit: float = 0.2, bound: int | None = None) -> DataFrame:
    """Extreme labels dropped, signed buckets, class 0 capped, signs balanced."""
    from ..functions.elementwise import signed_bucket

    d = materialize(df.where(F.abs(y) < limit).withColumn("y_bucket", signed_bucket(y, thresholds)))
    zeros = _capped_zeros(d, "y_bucket", multiple, keys, bound)
    return zeros.unionByName(_balanced_signs(d.where("y_bucket <> 0"), "y_bucket", keys, bound))


def replay_subset(df: DataFrame, round_col: str, share: int, keys=("date", "entity")) -> DataFrame:
    """Training rows per round plus a hash-chosen 1/``share`` of the previous round's rows."""
    carried = df.where(hash_bucket(share, *keys) == 0).withColumn(round_col, F.col(round_col) + 1)
    last = df.agg(F.max(round_col))
    carried = carried.where(F.col(round_col) <= last.scalar())
    return df.withColumn("replayed", F.lit(False)).unionByName(carried.withColumn("replayed", F.lit(True)))


def dedupe(df: DataFrame, keys, order, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in ``order``, chosen by aggregation with partial results."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max if last else F.min)(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(k)


def holidays(dates: DataFrame) -> DataFrame:
    """Weekdays between the first and last date that are not in the calendar."""
    span = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return days.join(dates.select("date").distinct(), "date", "left_anti")


#: Columns of one block of the correlation matrix.
CORRELATION_BLOCK = 128


def correlation_pairs(wide: DataFrame, cols, block: int = CORRELATION_BLOCK) -> DataFrame:
    """(a, b, corr): pairwise-complete correlations of the columns over the rows, each pair once and with itself.

    The matrix is made by blocks: an Arrow batch of rows is cut into blocks of ``block`` columns, each block travels once for every other one, and
    a pair of blocks gives all its sums as masked matrix products (about the columns' means, so levels don't matter). Partial sums of the
    batches are added up for each pair of columns. What is written grows with the columns squared and with the rows, not with their product.
    A missing or non-finite value counts as missing; a column that doesn't vary over a pair's rows has no correlation.
    """
    cols = list(cols)
    n_blocks = -(-len(cols) // block)
    rows = materialize(wide.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, len(cols)))
        return np.where(np.isfinite(x), x, np.nan)

    def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(cols)), np.zeros(len(cols))
        for batch in batches:
            x = matrix(batch)
            total, count = total + np.nansum(x, axis=0), count + np.isfinite(x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(cols), dtype=np.int32), "total": total, "n": count})

    sums = rows.mapInArrow(column_sums, "i int, total double, n double").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    means = np.zeros(len(cols))
    for r in sums.collect():  # one row for each column
        means[r["i"]] = r["total"] / r["n"] if r["n"] else 0.0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            x = matrix(batch) - means
            for i in range(n_blocks):
                own = np.ascontiguousarray(x[:, i * block:(i + 1) * block]).tobytes()
                low, high = [min(i, j) for j in range(n_blocks)], [max(i, j) for j in range(n_blocks)]
                yield pa.RecordBatch.from_pydict({
                    "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()), "batch": pa.array([(part << 32) + number] * n_blocks, pa.int64()),
                    "is_high": pa.array([i > j for j in range(n_blocks)]), "cells": pa.array([own] * n_blocks, pa.binary())})

    def products(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        width = lambda i: min(block, len(cols) - i * block)
        sides = {s: np.frombuffer(c, np.float64).reshape(-1, width(high if s else low)) for s, c in zip(table.column("is_high").to_pylist(), table.column("cells").to_pylist())}
        x, y = sides[False], sides.get(True, sides[False])
        there_x, there_y = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        found = {"n": there_x.T @ there_y, "sx": x.T @ there_y, "sy": there_x.T @ y, "sxx": (x * x).T @ there_y, "syy": there_x.T @ (y * y), "sxy": x.T @ y}
        a, b = np.meshgrid(low * block + np.arange(width(low)), high * block + np.arange(width(high)), indexing="ij")
        once = (a <= b).ravel()
        return pa.table({"i": pa.array(a.ravel()[once].astype(np.int32)), "j": pa.array(b.ravel()[once].astype(np.int32)), **{k: v.ravel()[once] for k, v in found.items()}})

    moments = ("n", "sx", "sy", "sxx", "syy", "sxy")
    pieces = rows.mapInArrow(cut, "low int, high int, batch long, is_high boolean, cells binary")
    parts = pieces.groupBy("low", "high", "batch").applyInArrow(products, "i int, j int, " + ", ".join(f"{m} double" for m in moments))
    g = parts.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in moments])
    n = F.nullif("n", F.lit(0.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    varies = (vx > VARIES * F.col("sxx")) & (vy > VARIES * F.col("syy"))
    corr = F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in cols])
    return g.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), corr.alias("corr"))


#: A column whose squares about the pair's mean are a smaller share than this of its squares doesn't vary.
VARIES = 1e-13


#: So many candidates are walked on the driver at a time.
BLOCK = 500


def greedy_prune(candidates: DataFrame, pairs: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """(candidate, fitness, max_corr): accept by descending fitness while |corr| to the accepted stays within the limit.

    Accepting is sequential, so the candidates are walked in blocks of the best undecided ones until none is left: the driver sees
    one block and the correlations inside it, Spark then drops whatever is correlated beyond the limit with a newly accepted one.
    A missing correlation counts as none.
    """
    spark = candidates.sparkSession
    path, schema = scratch_dir(spark, "pruned"), "candidate string, fitness double, max_corr double"
    size = F.abs(F.coalesce(F.nanvl(F.col("corr").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("size")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    met = materialize(pairs.select(both, size).groupBy("p.a", "p.b").agg(F.max("size").alias("size")))
    left = materialize(candidates.where("fitness > 0").select("candidate", F.col("fitness").cast("double").alias("fitness"), F.lit(0.0).alias("max_corr")))
    while True:
        chosen = left.orderBy(F.col("fitness").desc(), "candidate").limit(block).collect()
        names = F.broadcast(spark.createDataFrame([(r["candidate"],) for r in chosen], "a string"))
        among = met.join(names, "a", "left_semi").join(names.toDF("b"), "b", "left_semi")
        inside = {(r["a"], r["b"]): r["size"] for r in among.collect()}
        kept: dict[str, tuple[float, float]] = {}
        for name, fitness, worst in chosen:
            worst = max([worst, *(inside.get((name, k), 0.0) for k in kept)])
            if worst <= limit:
                kept[name] = (fitness, worst)
        new = spark.createDataFrame([(k, *v) for k, v in kept.items()], schema)
        new.coalesce(1).write.mode("append").parquet(path)
        if len(chosen) < block:
            return spark.read.schema(schema).parquet(path).orderBy(F.col("fitness").desc(), "candidate")
        near = met.join(F.broadcast(new.select(F.col("candidate").alias("b"))), "b").groupBy(F.col("a").alias("candidate")).agg(F.max("size").alias("size"))
        left = left.join(names.toDF("candidate"), "candidate", "left_anti").join(near, "candidate", "left")
        left = materialize(left.select("candidate", "fitness", F.greatest("max_corr", F.coalesce("size", F.lit(0.0))).alias("max_corr")).where(F.col("max_corr") <= limit))


def qualifies(reports: DataFrame, ir_min: float = 0.07, tvr_max: float = 0.5, names_min: float = 160) -> DataFrame:
    """Candidates that pass the rules: daily IR, turnover, holdings, positive out-of-sample IR."""
    return reports.where(
        (F.col("ir_daily") > ir_min) & (F.col("tvr") < tvr_max) & (F.col("numstk") > names_min) & (F.col("valid_ir") > 0))


def rounds_of_files(files: DataFrame, rounds: int, valid_share: int) -> DataFrame:
    """(date, code, part, round): a hash-chosen validation part and shuffled training rounds."""
    part = F.when(hash_bucket(valid_share, "date", "code") == 0, "valid").otherwise("train")
    return files.select("date", "code", part.alias("part"), hash_bucket(rounds, "code", "date").alias("round"))


