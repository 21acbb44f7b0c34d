"""Audits: no feature value may change when later rows are altered or removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def no_lookahead(rows: DataFrame, build: Callable[[DataFrame], DataFrame], features: list[str], cutoff: str,
                 alter: tuple[str, ...] = ("close",)) -> DataFrame:
    """(feature, cells, changed): cells compared and cells dated up to ``cutoff`` that differ between three builds.

    The features are built on all rows, on the rows up to the cutoff, and on rows whose later values
    are altered; a causal feature counts zero changes.
    """
    cut = F.lit(cutoff).cast("date")
    later = F.col("date") > cut
    altered = rows.withColumns({c: F.when(later, F.col(c) * 3.0 + 1.0).otherwise(F.col(c)) for c in alter})
    full = build(rows).where(F.col("date") <= cut)
    out = None
    for other in (build(rows.where(~later)), build(altered).where(F.col("date") <= cut)):
        o = other.select("date", "entity", *[F.col(f).alias(f"_{f}") for f in features])
        j = full.join(o, ["date", "entity"], "full_outer")
        same = [F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) < 1e-9, F.col(f).isNull() & F.col(f"_{f}").isNull())
                for f in features]
        one = j.agg(F.count(F.lit(1)).alias("cells"),
                    *[F.sum((~s).cast("bigint")).alias(f) for f, s in zip(features, same, strict=True)])
        out = one if out is None else out.unionByName(one)
    total = out.agg(F.sum("cells").alias("cells"), *[F.sum(f).alias(f) for f in features])
    return total.unpivot(["cells"], features, "feature", "changed")
