"""Registration of the queries: the Spark callable, its oracle SQL and the output columns.

Output columns are declared once, as text, and both sides are finished the same way:

``name``     passed through
``name~``    double, non-finite becomes NULL, rounded to 8 decimals (``name~4``: 4 decimals)
``name#``    cast to BIGINT
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _split(token: str) -> tuple[str, str, int]:
    if "~" in token:
        name, digits = token.split("~")
        return name, "double", int(digits or 8)
    if token.endswith("#"):
        return token[:-1], "long", 0
    return token, "plain", 0


def finish(df: DataFrame, cols: str) -> DataFrame:
    """Select, round and cast the declared output columns."""
    out = []
    for token in cols.split():
        name, kind, digits = _split(token)
        c = F.col(name)
        if kind == "double":
            c = c.cast("double")
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, digits) + F.lit(0.0))
        elif kind == "long":
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(sql: str, cols: str) -> str:
    """The same finishing for the oracle SQL; a leading WITH clause stays in front."""
    out = []
    for token in cols.split():
        name, kind, digits = _split(token)
        if kind == "double":
            d = f"CAST({name} AS DOUBLE)"
            out.append(f"CASE WHEN isfinite({d}) THEN round({d}, {digits}) + 0.0 END AS {name}")
        elif kind == "long":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM ({sql}) AS result_rows"


def query(name: str, cols: str, sql: str | None = None, prefix: str = ""):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``.

    ``sql`` is the oracle body; ``prefix`` is a ``WITH`` clause put in front of it.
    """

    def wrap(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir), cols)

        text = None if sql is None else f"{prefix}\n{finish_sql(sql, cols)}"
        REGISTRY[name] = Query(name, run, text)
        return fn

    return wrap
