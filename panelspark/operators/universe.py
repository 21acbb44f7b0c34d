"""Universe masks, zero-fill flags and per-date shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .crosssection import CrossSection


def zero_fill(df: DataFrame, cols: list[str], flags: dict[str, list[str]]) -> DataFrame:
    """Fill ``cols`` with 0 after ranking; each flag is true when any of its columns was missing."""
    marks = {
        name: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in of]) for name, of in flags.items()
    }
    out = df.withColumns(marks)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def universe_halves(xs: CrossSection, df: DataFrame, halves: dict[str, tuple[str, str]]) -> DataFrame:
    """Boolean halves of each date by rank: ``halves`` maps a name to (column, 'low' or 'high')."""
    for name, (c, side) in halves.items():
        df = xs.rank_pct(df, c, "_p")
        inside = F.col("_p") <= 0.5 if side == "low" else F.col("_p") > 0.5
        df = df.withColumn(name, inside).drop("_p")
    return df


def month_anchors(df: DataFrame, date: str = "date") -> DataFrame:
    """(month, anchor): the first date present in each calendar month."""
    return df.groupBy(F.trunc(date, "month").alias("month")).agg(F.min(date).alias("anchor"))


def top_n_mask(xs: CrossSection, df: DataFrame, adv: str, n: int, out: str,
               members: DataFrame | None = None, price: str = "close") -> DataFrame:
    """Top ``n`` names by ``adv`` on each month's first date, held through the month.

    A name is alive between its first and last ``price``: an interior gap keeps it. ``members`` (entity, month)
    restricts the ranking to index members. The anchor table has one row per month and the chosen
    table ``n`` rows per month, so both joins move little data.
    """
    month = F.trunc("date", "month")
    df = materialize(df)
    anchors = month_anchors(df)
    on_anchor = df.join(F.broadcast(anchors.select(F.col("anchor").alias("date"))), "date", "left_semi")
    ranked = on_anchor.where(F.col(adv).isNotNull()).withColumn("month", month)
    if members is not None:
        ranked = ranked.join(members, ["entity", "month"], "left_semi")
    ranked = ranked.select("date", "entity", "month", (-F.col(adv)).alias("_neg"))
    chosen = CrossSection(("date",), xs.bound).ordinal(ranked, "_neg", "_o").where(F.col("_o") <= n)
    chosen = chosen.select("entity", "month", F.lit(True).alias("_in"))
    alive = df.where(F.col(price).isNotNull()).groupBy("entity").agg(
        F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    rows = df.withColumn("month", month).join(chosen, ["entity", "month"], "left").join(alive, "entity", "left")
    inside = F.col("_in").isNotNull() & F.col("date").between(F.col("_lo"), F.col("_hi"))
    return rows.withColumn(out, F.coalesce(inside, F.lit(False))).drop("_in", "_lo", "_hi", "month")


def utilisation_by_date(df: DataFrame, shares: list[str], date: str = "date") -> DataFrame:
    """Mean of each row-level share per date."""
    return df.groupBy(date).agg(*[F.avg(c).alias(c) for c in shares])
